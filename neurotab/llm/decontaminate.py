"""Benchmark decontamination: a prefix-filtered set join (native: built-in functions only).

Every item is cut into windows of 10 consecutive words (an item of fewer words
is one window), every window into its set of placed 5-word shingles (a shorter
window is one shingle).  A window is contained in a document where all its
shingles stand at their places.

1. One pass over the texts hashes the shingles in the row and keeps those that
   a bit table of all item shingles (a Bloom filter of
   two bits a shingle) lets through, with the words around them.
   Texts without any never leave their partition.
2. The shingles that are left are counted over all documents; the shingles of
   a window are ordered by rarity.  For containment of a share s of m shingles
   the first m - ceil(s m) + 1 of that order are the necessary prefix: a place
   that holds none of them cannot reach the share.  For whole containment that
   is the rarest shingle alone.
3. Prefix shingles are joined by hash.  The place of the shingle in its window
   fixes where the window would start; it has to lie inside the document
   (positional and length bounds).
4. What is left is compared, over a window of the item's own length: word by
   word for whole containment, else shingle by shingle.

The prefix table is broadcast up to ``BROADCAST_BYTES`` (measured); beyond that
the join is shuffled, and Spark splits a very frequent shingle.  Rows are known
by a number written with them, so copies and null ids share no key.  The bit
table has a fixed size; a benchmark of many million windows makes it let more
through, never less.

Defined results: null or empty texts have no words and no hits; items without
words have no windows; repeated items, or rows of one item id, count once;
items with a null id hit like others and are together one item, named by the
empty string; an empty benchmark or documents table gives rows without hits or
no rows; every input row gives one result row.  Columns beside the text are
kept whatever their names are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import let, set_aside, write_scratch

WINDOW = 10
SHINGLE = 5
SIEVE_BITS = 1 << 23
BROADCAST_BYTES = 16 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def item_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A-Z (null: empty array).
    Case is changed in the whole text where it is plain ASCII, else word by word."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", " ")
    cut = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
    return let(body, lambda t: F.when(F.octet_length(t) == F.length(t), cut(F.lower(t))).otherwise(
        F.transform(cut(t), ascii_lower)))


def shingle_hashes(words: Column, k: int) -> Column:
    """64-bit hashes of all runs of ``k`` words, chained from word hashes by
    doubling; place i of the array is the run that starts at word i."""
    def joined(a: Column, b: Column, step: int) -> Column:
        return F.zip_with(a, F.slice(b, step + 1, F.greatest(F.size(b), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    def runs(one: Column, n: int, body) -> Column:
        if n == 1:
            return body(one)
        if n % 2:
            return runs(one, n - 1, lambda h: let(joined(h, one, n - 1), body))
        return runs(one, n // 2, lambda h: let(joined(h, h, n // 2), body))

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda one: runs(
        one, k, lambda h: F.slice(h, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))))


def windows_of(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, words) of every window of every item."""
    cut = items.select(F.coalesce(items[item_id].cast("string"), F.lit("")).alias("item"), item_words(items[text]).alias("w"))
    n = F.least(F.lit(window), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return cut.filter(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, n))).alias("words")).distinct()


def placed_shingles(windows: DataFrame, shingle: int, sizes: list[int]) -> DataFrame:
    """(window, size, place, h) of every shingle of every window."""
    k = F.least(F.lit(shingle), F.size("words"))
    by_size = F.coalesce(*[F.when(k == n, shingle_hashes(F.col("words"), n)) for n in sizes], F.array().cast("array<bigint>"))
    return windows.select("window", k.alias("size"), F.posexplode(by_size).alias("place", "h"))


def probes(h: Column, bits: int) -> list[Column]:
    """The two bits of a hash: from its low and its high half."""
    return [x.bitwiseAND(F.lit(bits - 1)).cast("int") for x in (h, F.shiftright(h, 32))]


def bit_table(hashes: DataFrame, bits: int) -> Column:
    """A scalar: ``bits`` bits in longs, with both bits of every ``h`` set."""
    longs = bits // 64
    places = hashes.select(F.explode(F.array(*probes(F.col("h"), bits))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)))
    rows = places.groupBy(F.shiftright("p", 6).alias("slot")).agg(F.bit_or(bit).alias("set"))
    every = hashes.sparkSession.range(longs).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("bigint").alias("set"))
    filled = every.unionByName(rows).groupBy("slot").agg(F.bit_or("set").alias("set"))
    table = filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "set"))), lambda x: x["set"]).alias("bits"))
    return table.scalar()


def may_be_known(h: Column, table: Column, bits: int) -> Column:
    def is_set(p: Column) -> Column:
        word = F.get(table, F.shiftright(p, 6))
        return F.call_function("shiftright", word, p.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1

    low, high = probes(h, bits)
    return is_set(low) & is_set(high)


def let_through(docs: DataFrame, text: str, table: Column, sizes: list[int], window: int, bits: int) -> DataFrame:
    """``docs`` without the text, with a row number, n_words and, for every
    shingle that the bit table knows, its size, place, hash and the words that
    any window around it can hold (from word ``at``)."""
    def found(w: Column, seen: Column) -> Column:
        def of_size(k: int) -> Column:
            first = lambda i: F.greatest(i - (window - k), F.lit(0))
            places = lambda h: F.filter(
                F.transform(h, lambda x, i: F.when(may_be_known(x, seen, bits), i).otherwise(F.lit(-1))), lambda i: i >= 0)
            return let(shingle_hashes(w, k), lambda h: F.transform(places(h), lambda i: F.struct(
                F.lit(k).alias("size"), i.alias("place"), F.get(h, i).alias("h"), first(i).alias("at"),
                F.slice(w, first(i) + 1, i - first(i) + window).alias("near"))))
        return F.concat(*[of_size(k) for k in sizes])

    nothing = "array<struct<size:int,place:int,h:bigint,at:int,near:array<string>>>"
    rest = [c for c in docs.columns if c != text]
    cut = docs.select(*rest, table.alias("_bits"), item_words(docs[text]).alias("_w"))
    made = let(F.col("_w"), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), (found(w, F.col("_bits")) if sizes else F.array()).cast(nothing).alias("found")))
    return cut.select(*rest, F.monotonically_increasing_id().alias("_row"), made.alias("_m")).select(
        *rest, "_row", F.col("_m.n_words").alias("_n_words"), F.when(F.size("_m.found") > 0, F.col("_m.found")).alias("_found"))


def prefixes(shingles: DataFrame, counts: DataFrame, windows: DataFrame, share: float) -> DataFrame:
    """The necessary prefix shingles of every window, rarest first, with the window's words."""
    from pyspark.sql import Window

    by_rarity = Window.partitionBy("window").orderBy("seen", "h", "place")
    ranked = shingles.join(counts, ["size", "h"], "left").withColumn("seen", F.coalesce("seen", F.lit(0))) \
        .withColumn("rank", F.row_number().over(by_rarity)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("window")))
    return ranked.filter(F.col("rank") <= F.col("m") - F.ceil(F.col("m") * share) + 1) \
        .select("window", "size", "place", "h").join(windows, "window")


def bounded(df: DataFrame, size: Column) -> DataFrame:
    """``df``, marked for broadcast if its measured size is under the bound."""
    return F.broadcast(df) if (df.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST_BYTES else df


def find_spans(seen: DataFrame, first: DataFrame, share: float, shingle: int) -> DataFrame:
    """(row, window, start, end) of every contained window."""
    length = F.size("words")
    placed = seen.withColumnRenamed("place", "pos").join(
        bounded(first, F.octet_length(F.array_join("words", " "))), ["size", "h"]) \
        .withColumn("start", F.col("pos") - F.col("place")) \
        .filter((F.col("start") >= 0) & (F.col("start") + length <= F.col("_n_words")))
    here = F.slice("near", F.col("start") - F.col("at") + 1, length)
    if share >= 1:
        held = here == F.col("words")
    else:
        equal = F.zip_with(here, F.col("words"), lambda a, b: a == b)
        k = F.least(F.lit(shingle), length)
        starts = F.sequence(F.lit(1), length - k + 1)
        whole = let(equal, lambda e: F.filter(starts, lambda i: F.forall(F.slice(e, i, k), lambda x: x)))
        held = F.size(whole) >= F.ceil((length - k + 1) * share)
    return placed.filter(held).select("_row", "window", "start", (F.col("start") + length).alias("end")).distinct()


def covered(spans: Column) -> Column:
    """Number of words in the union of (start, end) spans."""
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["upto"]), F.lit(0))).cast("bigint").alias("n"),
        F.greatest(s["upto"], x["end"]).alias("upto"))
    return F.aggregate(F.sort_array(spans), state, step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, shingle: int = SHINGLE, share: float = 1.0, bits: int = SIEVE_BITS) -> DataFrame:
    """``docs`` without the text, with n_words, n_hit (words inside a contained
    window; long), spans (start and end of the contained windows, in words) and
    items (ids as strings, sorted) of the items whose windows they are.

    ``share`` under 1 also takes windows of which that share of the shingles
    stands at its places."""
    if not 0 < share <= 1 or math.log2(bits) % 1 or bits < 64 or not 1 <= shingle <= window:
        raise ValueError("share in (0, 1], bits a power of two of at least 64, 1 <= shingle <= window")
    pairs = write_scratch(windows_of(items, item_id, item_text, window), "windows")
    windows = write_scratch(pairs.select("words").distinct().withColumn("window", F.monotonically_increasing_id()), "window-ids")
    sizes = sorted(r[0] for r in windows.select(F.least(F.lit(shingle), F.size("words"))).distinct().collect())  # at most ``shingle`` rows
    shingles = write_scratch(placed_shingles(windows, shingle, sizes), "shingles")

    aside, names = set_aside(docs, text)
    rows = write_scratch(let_through(aside, text, bit_table(shingles, bits), sizes, window, bits), "let-through")
    seen = rows.filter(F.col("_found").isNotNull()).select("_row", "_n_words", F.explode("_found").alias("f")).select("_row", "_n_words", "f.*")
    known = shingles.select("size", "h").distinct()
    counts = seen.select("size", "h").groupBy("size", "h").agg(F.count(F.lit(1)).alias("seen")).join(known, ["size", "h"], "left_semi")
    first = write_scratch(prefixes(shingles, counts, windows, share), "prefixes")
    spans = write_scratch(find_spans(seen, first, share, shingle), "spans")

    of_item = pairs.join(windows, "words").select("window", "item")
    named = spans.select("_row", "window").distinct().join(bounded(of_item, F.octet_length("item")), "window") \
        .groupBy("_row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit = spans.groupBy("_row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")).join(named, "_row")

    none = {"spans": F.array().cast("array<struct<start:int,end:int>>"), "items": F.array().cast("array<string>")}
    clean = rows.filter(F.col("_found").isNull()).select(*names_of(names, text), "_n_words", *[v.alias(k) for k, v in none.items()])
    judged = rows.filter(F.col("_found").isNotNull()).join(hit, "_row", "left").select(
        *names_of(names, text), "_n_words", *[F.coalesce(k, v).alias(k) for k, v in none.items()])
    out = clean.unionByName(judged)
    back = [F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True) if n != text and c not in ("n_words", "n_hit", "spans", "items")]
    return out.select(*back, F.col("_n_words").alias("n_words"), covered(F.col("spans")).alias("n_hit"), "spans", "items")


def names_of(names: list[str], text: str) -> list[str]:
    return [n for n in names if n != text]
