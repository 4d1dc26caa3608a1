"""The versioned store: corrections, repeated batches, readers and writers at once, files read."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from barflow.sources import store as S

SCHEMA = "symbol string, timeframe string, ts timestamp_ntz, close double"


def bars(spark, rows):
    return spark.createDataFrame([(s, "1h", dt.datetime.fromisoformat(t), c) for s, t, c in rows], SCHEMA)


def got(df):
    return sorted((r.symbol, str(r.ts), r.close) for r in df.collect())


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/store"


def test_correction_wins_and_a_reader_stays_with_its_version(spark, path):
    assert S.commit(bars(spark, [("A", "2024-01-01T10:00", 1.0), ("A", "2024-02-01T10:00", 2.0), ("B", "2024-01-01T10:00", 3.0)]), path) == 1
    before = S.read_store(spark, path)
    assert S.commit(bars(spark, [("A", "2024-01-01T10:00", 9.0)]), path) == 2
    assert got(before) == [("A", "2024-01-01 10:00:00", 1.0), ("A", "2024-02-01 10:00:00", 2.0), ("B", "2024-01-01 10:00:00", 3.0)]
    now = [("A", "2024-01-01 10:00:00", 9.0), ("A", "2024-02-01 10:00:00", 2.0), ("B", "2024-01-01 10:00:00", 3.0)]
    assert got(S.read_store(spark, path)) == now
    assert got(S.read_store(spark, path, 1)) == got(before)
    assert S.compact(spark, path) == 3 and S.compact(spark, path) is None
    assert got(S.read_store(spark, path)) == now and got(S.read_store(spark, path, 2)) == now
    assert S.chosen_files(spark, path).select("version").distinct().count() == 2  # only the month with two versions was merged
    held = S.read_store(spark, path, 3)
    assert S.clean(spark, path, keep=1, older_seconds=0) >= 1
    assert S.versions(spark, path) == [3] and got(held) == now
    with pytest.raises(ValueError):
        S.read_store(spark, path, 1)


def test_odd_rows(spark, path):
    with pytest.raises(ValueError):
        S.read_store(spark, path)
    assert S.commit(bars(spark, []), path) == 1
    assert S.read_store(spark, path).count() == 0
    rows = spark.createDataFrame([(None, None, None, 1.0), (None, None, None, 2.0), ("A", None, dt.datetime(2024, 1, 1), None)], SCHEMA)
    S.commit(rows, path, order=["close"])
    assert sorted((r.symbol or "", r.close or 0) for r in S.read_store(spark, path).collect()) == [("", 2.0), ("A", 0)]


def test_a_batch_counts_once(spark, path):
    one, two = bars(spark, [("A", "2024-01-01T10:00", 1.0)]), bars(spark, [("A", "2024-01-01T10:00", 2.0)])
    assert S.commit(one, path, stream="s", batch=0) == 1
    assert S.commit(two, path, stream="s", batch=1) == 2
    assert S.commit(one, path, stream="s", batch=0) is None and S.commit(two, path, stream="s", batch=1) is None
    assert S.commit(bars(spark, [("B", "2024-01-01T10:00", 5.0)]), path, stream="other", batch=0) == 3
    assert S.commit(one, path, stream="s", batch=0) is None
    assert [x[2] for x in got(S.read_store(spark, path))] == [2.0, 5.0]


def test_two_writers_lose_nothing(spark, path):
    """Both write version after version at the same time; every row of both is in the last one."""
    S.commit(bars(spark, []), path)
    faults = []

    def writer(symbol):
        try:
            for h in range(4):
                S.commit(bars(spark, [(symbol, f"2024-01-01T{h:02d}:00", float(h))]), path)
        except Exception as e:
            faults.append(e)

    threads = [threading.Thread(target=writer, args=(s,)) for s in ("A", "B")]
    [t.start() for t in threads]
    seen = []
    while any(t.is_alive() for t in threads):
        seen.append(len(got(S.read_store(spark, path))))  # each is a whole version
    [t.join() for t in threads]
    assert not faults
    assert seen == sorted(seen)
    assert len(S.versions(spark, path)) == 9
    assert got(S.read_store(spark, path)) == [(s, f"2024-01-01 {h:02d}:00:00", float(h)) for s in "AB" for h in range(4)]


def test_only_files_of_the_range_are_read(spark, path):
    rows = [(s, f"2024-{m:02d}-{d:02d}T10:00", float(m)) for s in ("A", "M", "Z") for m in range(1, 7) for d in (1, 15)]
    S.commit(bars(spark, rows), path)
    some = S.read_store(spark, path, symbols=["A"], timeframe="1h", start=dt.datetime(2024, 3, 2), end=dt.datetime(2024, 4, 1, 10))
    assert got(some) == [("A", "2024-03-15 10:00:00", 3.0), ("A", "2024-04-01 10:00:00", 4.0)]
    months = {r.month for r in S.chosen_files(spark, path, start=dt.datetime(2024, 3, 2), end=dt.datetime(2024, 4, 1, 10)).collect()}
    assert months == {"2024-03", "2024-04"}
    files = lambda df: set(df.inputFiles())
    assert len(files(some)) < len(files(S.read_store(spark, path)))
    assert all("2024-03" in f or "2024-04" in f for f in files(some))


def test_load_bars_prunes_months(spark, tmp_path):
    """A store in folders by timeframe and month: the range reaches the folders, and other months are not listed."""
    from barflow.sources.files import load_bars

    rows = bars(spark, [("A", f"2024-{m:02d}-10T10:00", float(m)) for m in range(1, 13)]).withColumn("month", F.date_format("ts", "yyyy-MM"))
    rows.write.partitionBy("timeframe", "month").parquet(str(tmp_path / "bars"))
    stored = spark.read.parquet(str(tmp_path / "bars"))
    some = load_bars(stored, ["A"], "1h", dt.datetime(2024, 3, 5), dt.datetime(2024, 5, 1))
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "month" in filters and "timeframe" in filters
    assert got(some) == [("A", "2024-03-10 10:00:00", 3.0), ("A", "2024-04-10 10:00:00", 4.0)]
