"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns (email, ip, card, phone) find the base spans.  The field segments a text
into spans of up to MAX_TOKENS tokens, each email, ip, card, phone or secret, and single
tokens of no type.  Candidate spans are number-like (digits with spaces, dots, dashes,
brackets) or word-like (no space, with a digit or an at sign).  Features look at whole
spans: digits, groups, check sum, parts, letters, length, neighbours and a key word
before them; dynamic programming over the bounded spans picks boundaries and types together.

It is trained by maximum likelihood on a bounded sample of places of the texts: with their
base spans, and with planted spans of each type in several forms (other groupings and
separators; a number need not pass its check sum; secrets behind a key word) beside
planted numbers that are nothing.  Places that hold long numbers or codes outside base spans stay
out, as nobody knows what they are.

Defined cases: null and empty texts have no spans; base spans stay as they are; added
spans overlap neither them nor each other; without texts to train on nothing is added;
repeated rows each get a row.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import built, hash_sample, saved, shared, ship, slices

KINDS = ("email", "ip", "card", "phone")
#: Types of the field; the order in which spans are listed.
TYPES = (*KINDS, "secret")
#: Bounds of the training sample in texts and in places of them (at most twice as many), characters beside the digit or at sign of a place, epochs.
TRAIN_TEXTS, TRAIN_PLACES, BESIDE, EPOCHS = 2000, 400, 60, 15
#: Bounds of a span: tokens, digits of a number-like one, characters of a word-like one.
MAX_TOKENS, MAX_DIGITS, MAX_CHARS = 16, 24, 256
#: Starts of candidate spans looked at together.
STARTS = 50_000
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match begins and ends with whole runs of digits; saying so keeps the search linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ANCHOR = re.compile(r"[0-9@]")
LONG_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9]){8,}")
LONG_CODE = re.compile(r"(?=[A-Za-z_+/=-]*[0-9])(?=[0-9_+/=-]*[A-Za-z])[A-Za-z0-9_+/=-]{16,}")
KEYED = re.compile(r"([A-Za-z]{2,20})[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?")
#: Words that planted secrets stand behind.
SECRET_KEYS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "bearer", "credential")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of EMAIL, found from its at signs in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, start) if start < at else done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not ANCHOR.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        number = digits(m[0])
        if 13 <= len(number) <= 19 and luhn(number):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15] if "+" in text else []
    return out


# Candidate spans and their features, for a whole run of texts at once.

#: Classes of tokens: runs of letters and digits, spaces, line ends, each other character by itself.
WORD, SPACE, LINE, OTHER = 0, 1, 2, 3
#: Sizes of the features' value ranges.
RANGES = {
    "bias": 1, "digits": MAX_DIGITS + 2, "at": 3, "dots": 6, "plus": 4, "luhn": 3, "groups": 10, "ip": 2, "longest": 22, "fours": 2, "letters": 4,
    "length": 12, "before": 8, "after": 8, "spaces": 5, "dashes": 6, "key": 66, "odd": 3, "mail": 2, "turns": 12, "zero": 2,
}
OFFSETS = dict(zip(RANGES, np.cumsum([0, *RANGES.values()])[:-1].tolist(), strict=True))
WEIGHTS = sum(RANGES.values())


def bucket(word: str) -> int:
    """1 to 64 by a hash of the word."""
    return 1 + hashlib.blake2b(word.lower().encode(), digest_size=1).digest()[0] % 64


def _sums(x: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(x)]


class Lattice:
    """Tokens of a text with running counts, from which features of any span follow."""

    def __init__(self, text: str):
        self.text = text
        c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        digit = (c >= 48) & (c <= 57)
        letter = ((c | 32) >= 97) & ((c | 32) <= 122) & (c < 128)
        word = digit | letter
        line = (c == 10) | (c == 13)
        space = (c == 32) | (c == 9) | line | ((c >= 11) & (c <= 12))
        new = np.r_[True, ~(word[1:] & word[:-1])] if len(c) else np.zeros(0, bool)
        self.cuts = np.r_[np.flatnonzero(new), len(c)]  # token t is cuts[t] to cuts[t + 1]
        first = self.cuts[:-1]
        kind = np.where(word[first], WORD, np.where(line[first], LINE, np.where(space[first], SPACE, OTHER)))
        is_ = lambda ch: c == ord(ch)
        size = np.diff(self.cuts)
        self.n_digits, self.n_letters = _sums(digit), _sums(letter)
        token_digits = self.n_digits[self.cuts[1:]] - self.n_digits[first]
        self.number = (kind == WORD) & (token_digits == size)
        self.word_token = kind == WORD
        self.c, self.digit, self.word = c, digit, word
        self.chars = {k: _sums(v) for k, v in {
            "at": is_("@"), "dots": is_("."), "dashes": is_("-"), "spaces": is_(" "), "hex": letter & ((c | 32) <= 102),
            "bracket": is_("(") | is_(")"), "turns": np.r_[False, (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])] if len(c) else digit,
            "mail_odd": ~(word | is_("@") | is_(".") | is_("_") | is_("%") | is_("+") | is_("-")), "secret_odd": ~(word | is_("_") | is_("-") | is_("+") | is_("/") | is_("=") | is_(".")),
        }.items()}
        # By token: what number-like and word-like spans may not hold; groups of digits and their values.
        bracket = is_("(") | is_(")") | is_("+") | is_(".") | is_("-") | is_(" ")
        self.not_number = _sums(~(self.number | ((kind != WORD) & bracket[first])))
        self.not_word = _sums((kind == SPACE) | (kind == LINE))
        self.groups = _sums(self.number)
        value = np.zeros(len(first), np.int64)
        short = self.number & (size <= 3)
        value[self.number & ~short] = 999
        for k in range(3):
            at = np.flatnonzero(short & (size > k))
            value[at] = value[at] * 10 + (c[first[at] + k].astype(np.int64) - 48)
        self.big = _sums(self.number & (value > 255))
        self.four = _sums(self.number & (size == 4))
        self.size = np.where(self.number, size, 0)
        # Luhn sums of the digits so far, where digits of even and of odd number count once.
        d = c[digit].astype(np.int64) - 48
        twice = d * 2 - 9 * (d > 4)
        even = np.arange(len(d)) % 2 == 0
        self.luhn = [_sums(np.where(even, d, twice)), _sums(np.where(even, twice, d))]
        self.starts = np.flatnonzero(self.number | self.word_token | ((kind == OTHER) & (is_("+") | is_("("))[first]))
        keys = np.zeros(len(c) + 1, np.int16)
        if "=" in text or ":" in text:
            for m in KEYED.finditer(text):
                keys[m.end()] = bucket(m[1])
        self.keys = keys
        # Class of a character beside a span: 0 none or space, 1 letter, 2 digit, 3 dot, 4 dash or underscore, 5 quote, 6 = or :, 7 other.
        beside = np.full(len(c) + 2, 7, np.int16)
        beside[0] = beside[-1] = 0
        for k, on in ((0, space), (1, letter), (2, digit), (3, is_(".")), (4, is_("-") | is_("_")), (5, is_('"') | is_("'")), (6, is_("=") | is_(":"))):
            beside[1:-1][on] = k
        self.beside = beside

    def candidates(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of boundary numbers of the candidate spans from these tokens, by start."""
        got_i, got_j = [], []
        last = len(self.cuts) - 1
        cuts, digits, at = self.cuts, self.n_digits, self.chars["at"]
        for tokens in range(1, MAX_TOKENS + 1):
            i = starts[starts + tokens <= last]
            j = i + tokens
            a, b = cuts[i], cuts[j]
            n = digits[b] - digits[a]
            number = (self.not_number[j] == self.not_number[i]) & self.number[j - 1] & (n >= 4) & (n <= MAX_DIGITS)
            word = (self.not_word[j] == self.not_word[i]) & self.word_token[i] & self.word_token[j - 1] & (b - a <= MAX_CHARS)
            mail = (at[b] > at[a]) & (self.chars["mail_odd"][b] == self.chars["mail_odd"][a])
            secret = (n > 0) & (b - a >= 12) & (self.n_letters[b] > self.n_letters[a]) & (self.chars["secret_odd"][b] == self.chars["secret_odd"][a])
            ok = number | (word & (mail | secret))
            got_i.append(i[ok])
            got_j.append(j[ok])
            starts = i[(self.not_number[j] == self.not_number[i]) & (n <= MAX_DIGITS) | (self.not_word[j] == self.not_word[i]) & (b - a <= MAX_CHARS)]  # others cannot grow
            if not len(starts):
                break
        i, j = np.concatenate(got_i), np.concatenate(got_j)
        order = np.lexsort((j, i))
        return i[order], j[order]

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Weight numbers of the features of spans, a column each."""
        a, b = self.cuts[i], self.cuts[j]
        count = lambda s, x=None, y=None: s[b if y is None else y] - s[a if x is None else x]
        ch = {k: count(v) for k, v in self.chars.items()}
        n, letters, groups = count(self.n_digits), count(self.n_letters), count(self.groups, i, j)
        end = self.n_digits[b] - 1  # number of the last digit
        odd = (end % 2 == 1).astype(int)
        total = np.where(odd == 0, self.luhn[0][end + 1] - self.luhn[0][end + 1 - n], self.luhn[1][end + 1] - self.luhn[1][end + 1 - n])
        longest = np.zeros(len(i), np.int64)
        for k in range(int((j - i).max()) if len(i) else 0):
            longest = np.maximum(longest, np.where(i + k < j, self.size[np.minimum(i + k, len(self.size) - 1)], 0))
        card = (n >= 13) & (n <= 19)
        ip = (groups == 4) & (ch["dots"] == 3) & (count(self.big, i, j) == 0) & (b - a == n + 3)
        first = self.c[a]
        ats = np.minimum(ch["at"], 2)
        values = {
            "bias": 0, "digits": np.minimum(n, MAX_DIGITS + 1), "at": ats, "dots": np.minimum(ch["dots"], 5), "plus": (first == 43) * 1 + (ch["bracket"] == 2) * 2,
            "luhn": np.where(card, 1 + (total % 10 == 0), 0), "groups": np.minimum(groups, 9), "ip": ip, "longest": np.minimum(longest, 21), "fours": (groups > 1) & (count(self.four, i, j) == groups),
            "letters": (letters > 0) * 1 + ((letters > 0) & (ch["hex"] == letters)) * 1 + ((letters == 0) & (ch["at"] > 0)) * 3,
            "length": np.minimum(np.log2(np.maximum(b - a, 1)) * 2, 11).astype(int), "before": self.beside[a], "after": self.beside[b + 1], "spaces": np.minimum(ch["spaces"], 4), "dashes": np.minimum(ch["dashes"], 5),
            "key": self.keys[a], "odd": np.where(ch["mail_odd"] > 0, 1, np.where(ch["secret_odd"] > 0, 2, 0)), "mail": (ats == 1) & (ch["dots"] > 0), "turns": np.minimum(ch["turns"] // 2, 11), "zero": first == 48,
        }
        return np.stack([np.broadcast_to(np.asarray(v, np.int64), len(i)) + OFFSETS[k] for k, v in values.items()], 1) if len(i) else np.zeros((0, len(RANGES)), np.int64)


def marginals(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of each span with each type; single tokens of no type score 0."""
    total = np.logaddexp.reduce(scores, 1).tolist() if len(spans) else []
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(spans):
        ends[j].append(k)
        starts[i].append(k)

    def log_sum(xs: list[float]) -> float:
        top = max(xs)
        return top + math.log(sum(math.exp(x - top) for x in xs))

    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = log_sum([ahead[j - 1], *(ahead[spans[k][0]] + total[k] for k in ends[j])])
    for i in range(n - 1, -1, -1):
        behind[i] = log_sum([behind[i + 1], *(behind[spans[k][1]] + total[k] for k in starts[i])])
    at = np.array([ahead[i] + behind[j] - ahead[n] for i, j in spans])
    return np.exp(scores + at[:, None])


class Field:
    """Weights of span features for each type, and the dynamic program over spans."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((WEIGHTS, len(TYPES))) if weights is None else weights

    def train(self, samples: list[tuple[str, list[tuple[str, int, int]]]]) -> None:
        """Fit by maximum likelihood on (text, its spans)."""
        made = []
        for text, gold in samples:
            lattice = Lattice(text)
            i, j = lattice.candidates(lattice.starts) if len(lattice.starts) else (np.zeros(0, int), np.zeros(0, int))
            if not len(i):
                continue
            of = {(a, b): TYPES.index(k) for k, a, b in reversed(gold)}
            taken, end = [], -1
            for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                kind = of.get((int(lattice.cuts[x]), int(lattice.cuts[y])))
                if kind is not None and x >= end:
                    taken.append((k, kind))
                    end = y
            # Tokens outside all candidates do not matter: number only the boundaries in use.
            places = np.unique(np.r_[i, j])
            spans = list(zip(np.searchsorted(places, i).tolist(), np.searchsorted(places, j).tolist(), strict=True))
            made.append((len(places) - 1, spans, lattice.features(i, j), taken))
        square = np.full_like(self.weights, 1e-6)
        for _ in range(EPOCHS if made else 0):
            for n, spans, rows, taken in made:
                marginal = marginals(n, spans, self.weights[rows].sum(1))
                for k, kind in taken:
                    marginal[k, kind] -= 1
                slope = np.zeros_like(self.weights)
                np.add.at(slope, rows.ravel(), np.repeat(marginal, rows.shape[1], 0))
                slope += 1e-4 * self.weights
                square += slope * slope
                self.weights -= 0.3 * slope / np.sqrt(square)

    def best(self, text: str) -> list[tuple[str, int, int]]:
        """The spans of the most probable segmentation, by start; spans that score below no type cannot be in it."""
        lattice = Lattice(text)
        found = []
        for k in range(0, len(lattice.starts), STARTS):
            i, j = lattice.candidates(lattice.starts[k : k + STARTS])
            for m in range(0, len(i), 4 * STARTS):
                x, y = i[m : m + 4 * STARTS], j[m : m + 4 * STARTS]
                rows, scores = lattice.features(x, y), np.zeros((len(x), len(TYPES)))
                for column in range(rows.shape[1]):
                    scores += self.weights[rows[:, column]]
                top = scores.max(1)
                good = top > 0
                found += zip(lattice.cuts[y[good]].tolist(), lattice.cuts[x[good]].tolist(), top[good].tolist(), scores[good].argmax(1).tolist(), strict=True)
        found.sort()
        ends, value, choice = [], [0.0], [-1]  # value[k]: best over the first k spans by end
        for k, (end, start, score, _) in enumerate(found):
            with_it = value[bisect_right(ends, start)] + score
            better = with_it > value[k]
            value.append(with_it if better else value[k])
            choice.append(k if better else choice[k])
            ends.append(end)
        out, k = [], len(found)
        while k > 0 and choice[k] >= 0:
            end, start, _, kind = found[choice[k]]
            out.append((TYPES[kind], start, end))
            k = bisect_right(ends, start, hi=choice[k])
        return out[::-1]

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and all spans by kind and start."""
        return self.all_spans([text])[0]

    def all_spans(self, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
        """``spans`` of several texts; they are laid end to end, as no span holds a line end."""
        some = [k for k, t in enumerate(texts) if ANCHOR.search(t)]
        out = [([], [])] * len(texts)
        if not some:
            return out
        offsets = np.cumsum([0, *(len(texts[k]) + 1 for k in some)]).tolist()
        added: list[list[tuple[str, int, int]]] = [[] for _ in some]
        for kind, a, b in self.best("\n".join(texts[k] for k in some)):
            at = bisect_right(offsets, a) - 1
            added[at].append((kind, a - offsets[at], b - offsets[at]))
        order = {k: i for i, k in enumerate(TYPES)}
        for k, more in zip(some, added, strict=True):
            base = base_spans(texts[k])
            taken = sorted((a, b) for _, a, b in base)
            begins, reach = [a for a, _ in taken], []  # largest end so far
            for _, e in taken:
                reach.append(max(e, reach[-1] if reach else 0))
            free = [x for x in more if not (n := bisect_left(begins, x[2])) or reach[n - 1] <= x[1]]
            out[k] = base, sorted([*base, *free], key=lambda x: (order[x[0]], x[1], x[2]))
        return out


# Training texts.

def invented(kind: str, rnd: random.Random) -> str:
    """A span of a type, in one of the forms it is written in."""
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    w = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    if kind == "email":
        return f"{w(rnd.randint(2, 9))}{rnd.choice(['', '.', '_', '-'])}{rnd.choice([w(4), d(2)])}@{w(rnd.randint(3, 8))}{d(rnd.randint(0, 1))}.{rnd.choice(['com', 'org', 'example.com', 'co.uk', 'de'])}"
    if kind == "ip":
        return ".".join(str(rnd.randint(0, 255)) for _ in range(4))
    if kind == "card":
        n = rnd.choice([16, 16, 16, 15])
        return rnd.choice(["", " ", "-"]).join([*(d(4) for _ in range(3)), d(n - 12)])
    if kind == "phone":
        return rnd.choice(["+{0} ({1}) {2}-{3}", "+{0} {1} {2} {3}", "+{0}-{1}-{2}-{3}", "({1}) {2}-{3}", "{1}-{2}-{3}", "+{0}{1}{2}{3}", "{1}.{2}.{3}"]).format(str(rnd.randint(1, 99)), d(3), d(3), d(4))
    chars = rnd.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF"])
    return "".join(rnd.choice(chars) for _ in range(rnd.choice([16, 20, 24, 32, 32, 40, 40, 48, 64])))


def nothing(rnd: random.Random) -> str:
    """A number or a code that is no personal data."""
    n = lambda a, b: rnd.randint(a, b)
    return rnd.choice([
        f"{n(1900, 2099)}", f"{n(0, 9)}.{n(0, 20)}.{n(0, 99)}", f"{n(1900, 2099)}-{n(1, 12):02}-{n(1, 28):02}", f"{n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}", f"{n(1, 999)},{n(0, 999):03},{n(0, 999):03}.{n(0, 99):02}",
        f"{n(1, 99999)}", f"{n(0, 9)}.{n(0, 10**6)}", f"{n(10, 99)}-{n(10, 99)}", f"{n(1, 99)} {n(1, 999)} {n(1, 999)}", f"{n(1, 12)}/{n(1, 28)}/{n(1900, 2099)}", f"ISO{n(1000, 9999)}", f"version{n(1, 9)}.{n(0, 9)}",
        f"{n(1900, 2050)} {n(1900, 2050)} {n(1, 99)}", f"chapter{n(1, 99)}section{n(1, 99)}", f"{n(1, 99)} {n(1, 99)} {n(1, 99)} {n(1, 99)} {n(1, 99)} {n(1, 99)}",
    ])


def lessons(places: list[str], seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans) to learn from: each place as it is, and with planted spans and planted numbers."""
    rnd, out = random.Random(seed), []
    for n, place in enumerate(places):
        base = sorted(base_spans(place), key=lambda x: (x[1], -x[2]))
        clear, end = [], 0
        for x in base:
            if x[1] >= end:
                clear.append(x)
                end = x[2]
        rest = "".join("x" if any(a <= k < b for _, a, b in base) else c for k, c in enumerate(place))
        if not LONG_NUMBER.search(rest) and not LONG_CODE.search(rest):
            out.append((place, clear))
        quiet = ANCHOR.sub("", LONG_NUMBER.sub("", rest)).split(" ")
        kind = TYPES[n % len(TYPES)]
        text, spans = [], []
        for word in (quiet[: rnd.randint(1, 6)], quiet[6:12]):
            text.append(" ".join(word) + rnd.choice([" ", " ", " (", " | "]))
            what = invented(kind, rnd)
            if kind == "secret":
                key = rnd.choice(SECRET_KEYS)
                key = rnd.choice([key, key.upper(), key.title()])
                text.append(f"{key}{rnd.choice([' = ', '=', ': ', ':'])}")
                quote = rnd.choice(['"', "'", ""])
                text.append(quote)
            at = len("".join(text))
            text.append(what)
            spans.append((kind, at, at + len(what)))
            text.append((quote if kind == "secret" else "") + rnd.choice([" ", ", ", ". ", "!! ", "*** ", ") "]))
            text.append(f"{nothing(rnd)} ")
            kind = TYPES[rnd.randrange(len(TYPES))]
        out.append(("".join(text), spans))
    return out


def places(docs: DataFrame, text: str = "text") -> list[str]:
    """A bounded sample of the places that hold digits or at signs, with what stands beside them: of texts chosen by hash, places chosen by hash."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"([^\\n]{{0,{BESIDE}}}[0-9@][^\\n]{{0,{2 * BESIDE}}})"), F.lit(1))
    texts = hash_sample(docs.select(text).filter(F.length(F.translate(text, "0123456789@", "")) < F.length(text)), TRAIN_TEXTS, text)
    rows = saved(texts.select(F.explode(found).alias("place")), "places")
    return sorted(r.place for r in hash_sample(rows, TRAIN_PLACES, "place").collect())


def trained(docs: DataFrame, text: str = "text") -> Field:
    field = Field()
    field.train(lessons(places(docs, text)))
    return field


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_found"]


def find(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_sha256, spans and n_found, the number of all spans (replacing columns of these names)."""
    learned = shared(docs.sparkSession, (field or trained(docs, text)).weights)

    @F.arrow_udf("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_found bigint")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        field = built(learned, Field)
        for column in batches:
            rows = []
            for texts in slices(column):
                for base, every in field.all_spans(texts):
                    kinds = [x[0] for x in base]
                    rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(FOUND)
            yield pa.StructArray.from_arrays([pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, c in zip(FOUND, columns, strict=True)], names=FOUND)

    got = docs.withColumn("_found", look(F.coalesce(F.col(text), F.lit(""))))
    return got.withColumns({c: F.col(f"_found.{c}") for c in FOUND}).drop("_found")


def redact(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; null texts stay null."""
    learned = shared(docs.sparkSession, (field or trained(docs, text)).weights)

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        field = built(learned, Field)
        for column in batches:
            out = []
            for texts in slices(column):
                done = []
                for t, (_, spans) in zip(texts, field.all_spans([t or "" for t in texts]), strict=True):
                    if spans:
                        end, parts = 0, []
                        for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
                            if a >= end:
                                parts += [t[end:a], f"[{kind.upper()}]"]
                            end = max(end, b)
                        t = "".join([*parts, t[end:]])
                    done.append(t)
                out.append(pa.array(done, pa.string()))
            yield pa.concat_arrays(out) if out else pa.array([], pa.string())

    return docs.withColumn(text, clean(F.col(text)))


ship(__name__)
