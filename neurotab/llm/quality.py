"""Quality rules, line first (native: built-in column functions only).

Each line of a text is judged on its own; failing lines are removed, and a
document that loses too large a share of its words is rejected.  On top stand
two base rules on the whole text: a least number of words, and a most share of
words in repeated 8-word windows.

Defined results: a null text counts as empty (no words, ``base_failed``); null
or repeated ids are kept as they are, one result row per input row; ``assess``
replaces columns that carry the name of an added one, ``clean`` keeps every
column of its input.  No row leaves its
partition: there is no shuffle, so a hot source or id cannot skew a task.  A very
long text is one row, judged whole; an empty table gives no rows.  Windows of
eight words are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import let, set_aside, words

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
# a line is navigation with this many separators, standing between at least
# every fifth of its words
NAVIGATION_SEPARATORS = "|»›•·"
MIN_SEPARATORS = 3
# a line is noise when over this share of its non-space characters is neither
# letter nor digit
MAX_PUNCTUATION_PCT = 25
# short lines (at most this many characters) naming one of these are boilerplate
BOILERPLATE_CHARS = 200
BOILERPLATE = (
    "cookie", "all rights reserved", "copyright ", "privacy policy", "terms of use", "terms of service", "licensed under",
    "released under the", "subscribe to", "sign up", "log in to", "click here", "read more", "enable javascript", "lorem ipsum",
)
# a document is rejected when its lines lose more than this share of its words
MAX_LOST_PCT = 30


def n_words(text: Column) -> Column:
    return F.size(words(text))


def line_verdict(line: Column) -> Column:
    """True for a line to keep.  Lines without a word are kept (they separate
    paragraphs).  A missing full stop alone does not fail a line: titles and
    list items have none; the punctuation rule looks for lines that consist of it."""
    separators = F.length(F.regexp_replace(line, f"[^{NAVIGATION_SEPARATORS}]+", ""))
    marks = F.length(F.regexp_replace(line, r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", ""))
    chars = F.length(F.replace(line, F.lit(" ")))
    navigation = lambda s: (s >= MIN_SEPARATORS) & (s * 5 >= F.size(words(line)))
    boilerplate = (F.length(line) <= BOILERPLATE_CHARS) & let(F.lower(line), lambda x: reduce(
        lambda a, phrase: a | phrase, [F.contains(x, F.lit(p)) for p in BOILERPLATE]))
    return let(marks, lambda m: ~(
        (m * 100 > chars * MAX_PUNCTUATION_PCT) | ((m >= MIN_SEPARATORS) & let(separators, navigation)) | boilerplate))


def repeat_words(w: Column) -> Column:
    """Number of words inside 8-word windows found twice or more.

    Windows are compared by 64-bit hashes, chained from the words' hashes by
    doubling (1, 2, 4, 8 words), all in the row.  When no hash repeats, the
    answer is 0 without further work; else the windows are sorted by hash,
    positions of equal neighbours are kept, and the lengths they cover are
    summed in position order."""
    def doubled(h: Column, step: int) -> Column:
        return let(h, lambda a: F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y)))

    by_word = F.transform(w, lambda x: F.xxhash64(x))
    windows = let(doubled(doubled(doubled(by_word, 1), 2), 4), lambda h: F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))
    ranked = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def marked(r: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        keep = F.filter(r, lambda x, k: same(F.get(r, k - 1), x) | same(F.get(r, k + 1), x))
        return F.sort_array(F.transform(keep, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x)

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        let(ranked(h), lambda r: let(marked(r), covered))))


def assess(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts, the verdicts and the cleaned text.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long), base_failed, n_lost_words (long), kept, clean_text."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_words", "kept",
             "clean_text"]
    keep = [docs[c] for c in docs.columns if c not in added]
    body = F.coalesce(docs[text], F.lit(""))
    by_words = let(words(body), lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("repeated")))
    word_lines = lambda ls: F.filter(ls, lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    by_lines = let(F.split(body, "\n"), lambda ls: F.struct(
        let(word_lines(ls), lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("dups"),
        let(F.filter(ls, line_verdict), lambda good: F.when(F.size(good) < F.size(ls), F.array_join(good, "\n"))).alias("clean")))
    counted = docs.select(
        *keep, body.alias("_body"), by_words.alias("_w"), by_lines.alias("_l"),
        (F.length(body) - F.length(reduce(lambda t, x: F.replace(t, F.lit(x)), SYMBOLS, body))).cast("long").alias("n_symbols"))
    lost = F.when(F.col("_l.clean").isNull(), F.lit(0)).otherwise(F.col("_w.n") - n_words(F.col("_l.clean")))
    measured = counted.select(
        *[c for c in counted.columns if c not in ("_body", "_w", "_l")],
        F.col("_w.n").cast("long").alias("n_words"), F.col("_w.chars").cast("long").alias("word_chars"), F.col("_l.dups").cast("long").alias("n_dup_lines"),
        F.col("_w.repeated").cast("long").alias("n_repeat_words"), lost.cast("long").alias("n_lost_words"),
        F.coalesce(F.col("_l.clean"), F.col("_body")).alias("clean_text"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    few_lost = F.col("n_lost_words") * 100 <= F.col("n_words") * MAX_LOST_PCT
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & few_lost)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents without their failing lines; same columns as ``docs``
    (an ``n_chars`` column follows the text)."""
    aside, names = set_aside(docs, text)
    out = assess(aside, text).filter("kept")
    columns = []
    for c, n in zip(docs.columns, names, strict=True):
        if c == text:
            columns.append(F.col("clean_text").alias(c))
        elif c == "n_chars":
            columns.append(F.length("clean_text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(n).alias(c))
    return out.select(*columns)
