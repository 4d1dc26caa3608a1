"""Line-first cleaning with DataFrame functions only.

Every line with a word is judged by itself: it must end as a sentence ends, not be
littered with marks, not look like navigation (short items between separators) and not like
boilerplate (rights, links, digits, capitals); fixed English phrases add to both.  Failing lines
go; a document that loses more than MAX_LOSS of its characters in such lines goes too.
Base measures of the whole text come first.

Defined cases: null text is the empty text, without words or lines; it fails the base
rules (fewer than MIN_WORDS words) and is not kept.  Blank lines count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let

SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEATED, MAX_LOSS = 20, 8, 30, 0.5
#: Spaces at a line's end count within its last TAIL characters.
TAIL = 40
#: A line's last character (before spaces), and the share of its characters that may be marks.
ENDS, MARKS, MAX_MARKS = "[.?!:;\"')\\]…”»。]\\s*$", "#*$%&|<>!?", 0.05
#: Boilerplate and navigation lines are shorter than this; a longer one is text that mentions such things.
BOILERPLATE_CHARS, NAVIGATION_CHARS = 160, 80
#: Navigation: so many separators or more, with so few words between two on average.
SEPARATORS, LEAST_SEPARATORS, ITEM_WORDS = "|»«›‹•·→>/\t", 2, 4
#: Boilerplate by its shape: signs of rights, or more than a share of links, digits or (of so many letters) capitals.
RIGHTS, LINK = "[©®™℗]|\\([cC]\\) ?[12][0-9]{3}", "(https?://|www\\.)[^\\x20]+"
MAX_LINKS, MAX_DIGITS, MAX_CAPITALS, CAPITALS_OF = 0.3, 0.3, 0.6, 10
#: Besides shape, fixed phrases of English boilerplate and navigation lines.
BOILERPLATE = (
    "all rights reserved", "copyright", "privacy policy", "cookie policy", "use cookies", "terms of service", "terms of use",
    "licensed under", "enable javascript", "lorem ipsum", "powered by",
)
NAVIGATION = ("sign in", "sign up", "log in", "subscribe now", "read more", "click here", "share this", "back to top", "skip to content")


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words that the text holds twice or more, the first included."""
    hashed = F.transform(ws, lambda w: F.xxhash64(w))

    def keys(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - F.lit(window)), lambda i: F.xxhash64(*[F.get(h, i + F.lit(j) if j else i) for j in range(window)]))

    def covered(k: Column) -> Column:
        """Starts of repeated windows by sorting hashes with their places; then the length they cover together."""
        sorted_keys = F.sort_array(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(sorted_keys, lambda s: F.filter(
            F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - F.lit(1))["h"]) | (x["h"] == F.get(s, i + F.lit(1))["h"]), x["i"].cast("bigint"))), lambda p: p.isNotNull()))
        return let(F.sort_array(starts), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(window).cast("bigint"), F.coalesce(F.get(p, i + F.lit(1)) - x, F.lit(window).cast("bigint")))), F.lit(0).cast("bigint"), lambda n, x: n + x))

    once = lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("bigint")).otherwise(covered(k))
    return F.when(F.size(ws) >= window + 1, let(hashed, lambda h: let(keys(h), once))).otherwise(F.lit(0).cast("bigint"))


def shaped_as_navigation(line: Column) -> Column:
    """Short items between separators, in any language."""
    marks = F.length(line) - F.length(F.translate(line, SEPARATORS, ""))
    gaps = F.length(line) - F.length(F.translate(line, " ", ""))
    return (marks >= LEAST_SEPARATORS) & (gaps + 1 <= ITEM_WORDS * (marks + 1))


def shaped_as_boilerplate(line: Column) -> Column:
    """Signs of rights, or mostly links, digits or capitals, in any language."""
    size = F.length(line)
    links = size - F.length(F.regexp_replace(line, LINK, ""))
    digits = size - F.length(F.translate(line, "0123456789", ""))
    letters, capitals = size - F.length(F.regexp_replace(line, "\\p{L}", "")), size - F.length(F.regexp_replace(line, "\\p{Lu}", ""))
    return line.rlike(RIGHTS) | (links > F.lit(MAX_LINKS) * size) | (digits > F.lit(MAX_DIGITS) * size) | ((letters >= CAPITALS_OF) & (capitals > F.lit(MAX_CAPITALS) * letters))


def good_line(line: Column) -> Column:
    """The three kinds of line rules."""
    low = F.lower(line)
    size = F.length(line)
    punctuation = F.right(line, F.lit(TAIL)).rlike(ENDS) & (size - F.length(F.translate(line, MARKS, "")) <= F.lit(MAX_MARKS) * size)
    boilerplate = (size < BOILERPLATE_CHARS) & (low.rlike("|".join(BOILERPLATE)) | shaped_as_boilerplate(line))
    navigation = (size < NAVIGATION_CHARS) & (low.rlike("|".join(NAVIGATION)) | shaped_as_navigation(line))
    return punctuation & ~boilerplate & ~navigation


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base measures, base_failed, line counts, clean_text and kept (replacing columns of these names)."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_bad_lines", "clean_text", "kept"]
    t = F.coalesce(F.col(text), F.lit(""))
    # Words and lines are columns of their own, so that each is made once.
    parts = docs.drop(*[c for c in made if c != text]).withColumns({
        "_t": t,
        "_words": F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
    })
    good = parts.withColumn("_good", F.filter("_lines", good_line))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x))
    long = lambda c: c.cast("bigint")
    measured = good.withColumns({
        "n_words": long(F.size("_words")),
        "word_chars": long(F.length(F.translate("_t", SPACE, ""))),
        "n_symbols": long(F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))),
        "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "n_repeat_words": repeated_words(F.col("_words")),
        "n_lines": long(F.size("_lines")),
        "n_bad_lines": long(F.size("_lines") - F.size("_good")),
        "_all": chars(F.col("_lines")), "_left": chars(F.col("_good")),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumns({
        "clean_text": F.array_join("_good", "\n"),
        "kept": ~failed & (F.col("_left") >= F.lit(1 - MAX_LOSS) * F.col("_all")),
    }).drop("_t", "_words", "_lines", "_good", "_all", "_left")


SQL = r"""
with parts as (
  select doc_id, coalesce(text, '') as t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
places as (select doc_id, w, unnest(range(1, len(w) - 6)) as i from parts where len(w) >= 9),
keys as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as k from places),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from keys) where c > 1),
cover as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from twice) group by doc_id),
judged as (
  select *, list_filter(lines, lambda x: regexp_matches(right(x, 40), '[.?!:;"'')\]…”»。][\t\n\x0B\f\r ]*$')
      and len(x) - len(regexp_replace(x, '[#*$%&|<>!?]', '', 'g')) <= 0.05 * len(x)
      and not (len(x) < 160 and (regexp_matches(x, '[©®™℗]|\([cC]\) ?[12][0-9]{3}') or len(x) - len(regexp_replace(x, '(https?://|www\.)[^\x20]+', '', 'g')) > 0.3 * len(x)
        or len(x) - len(translate(x, '0123456789', '')) > 0.3 * len(x)
        or (len(x) - len(regexp_replace(x, '\p{L}', '', 'g')) >= 10 and len(x) - len(regexp_replace(x, '\p{Lu}', '', 'g')) > 0.6 * (len(x) - len(regexp_replace(x, '\p{L}', '', 'g'))))
        or regexp_matches(lower(x), 'all rights reserved|copyright|privacy policy|cookie policy|use cookies|terms of service|terms of use|licensed under|enable javascript|lorem ipsum|powered by')))
      and not (len(x) < 80 and ((len(x) - len(translate(x, '|»«›‹•·→>/' || chr(9), '')) >= 2 and len(x) - len(translate(x, ' ', '')) + 1 <= 4 * (len(x) - len(translate(x, '|»«›‹•·→>/' || chr(9), '')) + 1))
        or regexp_matches(lower(x), 'sign in|sign up|log in|subscribe now|read more|click here|share this|back to top|skip to content')))) as good
  from parts),
measured as (
  select j.doc_id, len(w)::bigint as n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
         len(lines)::bigint as n_lines, (len(lines) - len(good))::bigint as n_bad_lines,
         coalesce(list_sum(list_transform(lines, lambda x: len(x))), 0) as all_chars, coalesce(list_sum(list_transform(good, lambda x: len(x))), 0) as left_chars
  from judged j left join cover c using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and left_chars >= 0.5 * all_chars as kept,
       n_lines, n_bad_lines
from measured
"""
