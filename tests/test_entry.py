"""The entry module in a process of its own, where no session is running."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_fresh_import_needs_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 160 and set(s) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-1500:]
    assert "Traceback" not in done.stderr, done.stderr[-1500:]
    assert int(done.stdout) >= (175 if (REPO / "barflow" / "llm").is_dir() else 165)


def test_faulty_optional_part_leaves_the_library(tmp_path):
    """A subpackage that cannot be imported is told on stderr and takes no other query with it."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((REPO / name).read_text())
    package = tmp_path / "barflow"
    package.mkdir()
    for p in (REPO / "barflow").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    gone = run()
    assert gone.returncode == 0 and "Traceback" not in gone.stderr and int(gone.stdout) > 160
    (package / "llm").mkdir()
    (package / "llm" / "__init__.py").write_text("raise RuntimeError('no session')\n")
    broken = run()
    assert broken.returncode == 0 and "no session" in broken.stderr and broken.stdout == gone.stdout
