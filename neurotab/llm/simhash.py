"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits (majority vote of its shingles' XXH64).  Two
texts are linked when their fingerprints differ in at most ``MAX_BITS`` = 2
bits.  Candidates come from equal keys, not from pairs:

* a fingerprint has three segments of 22, 21 and 21 bits.  Two flipped bits
  touch at most two segments, so one segment i is equal in both (pigeonhole),
  and the segment after it differs in at most two bits;
* every 23-bit word lies within 3 bits of exactly one word of the perfect
  binary Golay code (23, 12).  Its indices are that codeword and, if it is 3
  bits away, the five codewords 4 bits away.  Two words at most 2 bits apart
  always share an index (checked exhaustively in the tests);
* the keys of a fingerprint are (i, segment i, an index of the next segment):
  3 to 18 keys of 36 bits.

Fingerprints that share a key are verified by their bit distance.  Equal
fingerprints are one class throughout.  A key shared by more than
``CROWDED`` classes makes no pairs: its members are grouped by the 44 words at
most one bit from them (outside the equal segment), since two of them are
within two bits exactly if they share such a word.  That is linear and exact.

Defined results: a null or empty text, or one without words, has fingerprint
zero and is linked like any other; texts under three words use the whole
sequence; rows with a null id take part, and a component whose ids are all
null has a null id; repeated rows give repeated result rows; a very long text is
one row and read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import map_batches, set_aside, text_bytes, write_scratch
from neurotab.llm.components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
CROWDED = 128
# Generator polynomial of the Golay code, segment widths.
GOLAY = 0b110001110101
WIDTHS = (22, 21, 21)
STARTS = (0, 22, 43)


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of one text, as an unsigned 64-bit number."""
    import xxhash

    # bytes.lower() changes A-Z alone, bytes.split() splits at the six ASCII spaces
    w = (text or b"").lower().split()
    if not w:
        return 0
    if len(w) < size:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    digest, total, ones = xxhash.xxh64_intdigest, len(w) - size + 1, np.zeros(64, np.int64)
    for at in range(0, total, 1 << 15):  # bounded memory for very long texts
        n = min(1 << 15, total - at)
        shingles = zip(*(w[at + k:at + k + n] for k in range(size)))
        h = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), "<u8", n)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint of every row, as a signed long."""
    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, size) for t in text_bytes(batch.column(1))], np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64)), "text_hash": batch.column(2)}

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(doc_id, text, F.xxhash64(text)), run, f"doc_id {kind}, fp long, text_hash long")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndromes of the upper 12 bits, error words by syndrome [2048, 6]): the
    first error word leads to the nearest codeword, -1 fills unused places."""
    def remainder(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GOLAY << (bit - 11)
        return v

    upper = np.array([remainder(v << 11) for v in range(1 << 12)], np.int64)
    errors = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = int(upper[e >> 11]) ^ (e & 0x7FF)
            # four errors count only where three were needed
            if weight < 4 or errors[s][0].bit_count() == 3:
                errors[s].append(e)
    table = np.full((1 << 11, 6), -1, np.int64)
    for s, es in enumerate(errors):
        table[s, :len(es)] = es
    return upper, table


def golay_indices(v: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """[n, 6] codeword indices (12 bits) near each 23-bit word, -1 where unused."""
    upper, errors = tables
    e = errors[upper[v >> 11] ^ (v & 0x7FF)]
    return np.where(e < 0, -1, (v[:, None] ^ e) >> 11)


def segments(fps: np.ndarray) -> list[np.ndarray]:
    u = fps.view(np.uint64)
    return [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(STARTS, WIDTHS, strict=True)]


def fuzzy_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row numbers): the 3 to 18 keys of each fingerprint."""
    seg, keys, rows = segments(fps), [], []
    for i in range(3):
        near = golay_indices(seg[(i + 1) % 3], tables)
        row, place = np.nonzero(near >= 0)
        keys.append((np.int64(i) << 34) | (seg[i][row] << 12) | near[row, place])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def key_table(classes: DataFrame) -> DataFrame:
    """(key, fp) of every class."""
    def run(batch: pa.RecordBatch) -> dict:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keys, rows = fuzzy_keys(fps, run.tables)
        return {"key": pa.array(keys), "fp": pa.array(fps[rows])}

    run.tables = golay_tables()
    return map_batches(classes.select("fp"), run, "key long, fp long")


def links(classes: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints at most two bits apart;
    every connected set is connected by the links returned."""
    keyed = write_scratch(key_table(classes), "simhash-keys")
    sizes = write_scratch(keyed.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
    shared = write_scratch(keyed.join(sizes, F.col("key") == F.col("k")).select("key", "fp", "n"), "simhash-shared")
    # at most CROWDED members: pairs within one array, verified at once
    few = shared.filter(F.col("n") <= CROWDED).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = lambda x, rest: F.transform(F.filter(rest, lambda y: F.bit_count(x.bitwiseXOR(y)) <= MAX_BITS), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = few.select(F.explode(F.flatten(F.transform("fps", lambda x, i: near(x, F.slice("fps", i + 2, CROWDED))))).alias("p")).select("p.*")
    # more members: groups around the words within one bit, outside the equal segment
    part = F.shiftright("key", 34).cast("int")
    flips = [F.array(*[F.lit((1 << b) - (1 << 64 if b == 63 else 0)) for b in range(64) if not STARTS[i] <= b < STARTS[i] + WIDTHS[i]], F.lit(0)) for i in range(3)]
    centre = F.explode(F.transform(F.when(part == 0, flips[0]).when(part == 1, flips[1]).otherwise(flips[2]), lambda m: F.col("fp").bitwiseXOR(m)))
    around = shared.filter(F.col("n") > CROWDED).select("key", "fp", centre.alias("centre"))
    heads = around.groupBy("key", "centre").agg(F.min("fp").alias("a"), F.count("*").alias("members")).filter("members > 1").drop("members")
    heads = write_scratch(heads, "simhash-heads")
    stars = around.join(heads, ["key", "centre"]).select("a", F.col("fp").alias("b")).filter("a < b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id, component_key) of every row; component_id is
    the smallest id that links reach, component_key the smallest fingerprint."""
    rows = write_scratch(fingerprints(docs, doc_id, text, size), "simhash-rows")
    classes = write_scratch(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "simhash-classes")
    found = write_scratch(connected_components(links(classes)), "simhash-components")
    known = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component_key"))
    known = write_scratch(known, "simhash-known")
    firsts = known.groupBy(F.col("component_key").alias("c")).agg(F.min("first_id").alias("component_id"))
    labels = write_scratch(known.join(firsts, F.col("component_key") == F.col("c")).select(F.col("fp").alias("f"), "component_key", "component_id"), "simhash-labels")
    # a fingerprint held by very many rows is split by AQE: both sides are plain tables
    return rows.join(labels, F.col("fp") == F.col("f")).drop("f")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the smallest id (null
    ids last, then the smallest text hash); of equal rows, one.  Same columns
    as ``docs``."""
    labels = near_duplicates(docs).select("component_key", F.col("doc_id").isNull().alias("bare"), F.col("doc_id").alias("id"), "text_hash")
    heads = labels.groupBy("component_key").agg(F.min(F.struct("bare", "id", "text_hash")).alias("h"))
    heads = write_scratch(heads.select(F.col("h.id").alias("_id"), F.col("h.text_hash").alias("_hash")), "simhash-heads")
    aside, names = set_aside(docs, "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    stay = aside.join(heads, same).dropDuplicates(["_id", "_hash"])
    return stay.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
