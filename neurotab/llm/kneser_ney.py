"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark.

Words are known by their 64-bit XXH64, pairs by a mix of two word hashes.

1. Each task counts the pairs of its texts and sends the distinct ones, packed
   and compressed, to the bucket of the pair's hash.  Pairs are spread by their
   own hash and combined before the shuffle, so neither a very common word nor
   a very common pair fills one task.
2. A bucket adds up its pairs, writes them as a sorted hash array (hash, count)
   into the shared folder, and passes on what its pairs mean for their two
   words: how often and before how many different words a context stands, and
   after how many different contexts a word.
3. The word buckets add those parts up and write sorted arrays as well.
4. Workers memory-map the arrays and look up the sorted hashes of a batch.

The model: a pair's count is discounted by D1, D2 or D3+ (from the counts of
counts); the mass so freed goes to the continuation model of single words,
which is discounted the same way and freed mass goes to V + 1 equal shares, one
for all unknown words.  A context never seen leaves the continuation model.

Defined results: a null or empty text has one token, the end; documents with a
null id are learned from; an empty training set leaves the even shares;
repeated rows count once each; a very long text is one row, counted and scored
whole; an empty table to score gives no rows; columns beside id and text are not
read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import as_batch, map_batches, text_bytes, write_scratch
from neurotab.llm.packing import expand, small, squeeze
from neurotab.session import scratch_path

TOKENS_A_BUCKET = 4_000_000
FLUSH_TOKENS = 4_000_000
SCORE_TOKENS = 500_000
SEED = 0
WORD_COLUMNS = ("count", "after", "follows1", "follows2", "follows3", "uses")


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, SEED)


# no word is empty or holds white space
END, START = b"", b"\n"


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of a text's words and of its end."""
    import xxhash

    w = (text or b"").lower().split()
    w.append(END)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in w), np.uint64, len(w))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the hash, so sorted hashes are grouped by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def contexts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(previous token, token) of all tokens of some texts."""
    own = np.concatenate(parts)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.cumsum([0, *map(len, parts)])[:-1]] = np.uint64(word_hash(START))
    return before, own


def summed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums of the columns by key, keys sorted."""
    if not len(keys):
        return keys, columns
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
    return keys[first], [np.add.reduceat(c[order], first) for c in columns]


def packed_pairs(parts: list[np.ndarray], buckets: int) -> dict:
    """Distinct pairs of some texts, a row per bucket: the words once, then the
    pairs as places in that list."""
    before, own = contexts(parts)
    h = pair_hash(before, own)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.nonzero(np.r_[True, h[1:] != h[:-1]])[0]
    count = np.diff(np.r_[first, len(h)])
    a, b, target = before[order][first], own[order][first], bucket_of(h[first], buckets)
    out: dict = {"bucket": [], "body": []}
    edges = np.nonzero(np.r_[True, target[1:] != target[:-1], True])[0] if len(target) else np.zeros(1, np.int64)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        words, place = np.unique(np.r_[a[lo:hi], b[lo:hi]], return_inverse=True)
        pa_, pb = place[:hi - lo], place[hi - lo:]
        by = np.lexsort((pb, pa_))
        out["bucket"].append(int(target[lo]))
        out["body"].append(squeeze(words, np.diff(pa_[by], prepend=0).astype(np.uint32), pb[by].astype(np.uint32), small(count[lo:hi][by])))
    return out


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under a fixed name; a repeated task writes the same bytes
    under a name of its own and renames it."""
    import uuid

    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    part = f"{base}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(array.tobytes())
    system.move(part, f"{base}/{name}")


PAIR = np.dtype([("hash", "<u8"), ("count", "<u4")])


def merge_pairs(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair hash, context, word, count) of a bucket, sorted by hash."""
    a, b, n = [], [], []
    for body in bodies:
        words, step, pb, count = expand(body)
        a.append(words[np.cumsum(step, dtype=np.int64)])
        b.append(words[pb])
        n.append(count.astype(np.uint32))
    a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n)
    h = pair_hash(a, b)
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.nonzero(np.r_[True, h[1:] != h[:-1]])[0]
    return h[first], a[order][first], b[order][first], np.add.reduceat(n[order], first)


def fit(docs: DataFrame, text: str = "text") -> dict:
    """Count the model over all rows of ``docs``; returns what scoring needs:
    the folder, the number of buckets and a few sums."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "kneser-ney")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    only = docs.select(text)
    size = only.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(size / 6 / TOKENS_A_BUCKET))
    body = pa.schema([("bucket", pa.int64()), ("body", pa.binary())])

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            for t in text_bytes(batch.column(0)):
                parts.append(tokens(t))
                held += len(parts[-1])
                if held >= FLUSH_TOKENS:
                    yield as_batch(packed_pairs(parts, buckets), body)
                    parts, held = [], 0
        if parts:
            yield as_batch(packed_pairs(parts, buckets), body)

    pairs = only.mapInArrow(count, "bucket long, body binary")
    kinds = pa.schema([("bucket", pa.int64()), ("body", pa.binary()), ("facts", pa.list_(pa.int64()))])

    def pair_bucket(key, batches):
        h, a, b, n = merge_pairs([x for batch in batches for x in batch.column("body").to_pylist()])
        table = np.empty(len(h), PAIR)
        table["hash"], table["count"] = h, n
        save(folder, f"pairs-{key[0].as_py():07d}", table)
        one = np.ones(len(h), np.uint32)
        zero = np.zeros(len(h), np.uint32)
        words, sums = summed(np.r_[a, b], [np.r_[x, y] for x, y in (
            (zero, n), (zero, one), ((n == 1) * one, zero), ((n == 2) * one, zero), ((n >= 3) * one, zero), (n, zero))])
        target = bucket_of(words, buckets)
        edges = np.nonzero(np.r_[True, target[1:] != target[:-1], True])[0]
        facts = [len(h), *(int((n == k).sum()) for k in (1, 2, 3, 4))]
        out: dict = {"bucket": [], "body": [], "facts": []}
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            out["bucket"].append(int(target[lo]))
            out["body"].append(squeeze(words[lo:hi], *(small(s[lo:hi]) for s in sums)))
            out["facts"].append(facts if lo == 0 else None)
        yield as_batch(out, kinds)

    sums = pa.schema([("facts", pa.list_(pa.int64()))])

    def word_bucket(key, batches):
        keys, columns = [], [[] for _ in WORD_COLUMNS]
        for batch in batches:
            for x in batch.column("body").to_pylist():
                k, *cs = expand(x)
                keys.append(k)
                for to, c in zip(columns, cs, strict=True):
                    to.append(c.astype(np.int64))
        h, cs = summed(np.concatenate(keys), [np.concatenate(c) for c in columns])
        table = np.empty(len(h), WORD)
        table["hash"] = h
        for name, c in zip(WORD_COLUMNS, cs, strict=True):
            table[name] = c
        save(folder, f"words-{key[0].as_py():07d}", table)
        after = table["after"]
        yield as_batch({"facts": [[int(table["count"].sum()), int((table["count"] > 0).sum()), int((after >= 3).sum()), *(int((after == k).sum()) for k in (1, 2, 3, 4))]]}, sums)

    from collections.abc import Iterator

    for f in (pair_bucket, word_bucket):
        f.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    parts = write_scratch(pairs.groupBy("bucket").applyInArrow(pair_bucket, "bucket long, body binary, facts array<long>"), "kn-words")
    words = write_scratch(parts.select("bucket", "body").groupBy("bucket").applyInArrow(word_bucket, "facts array<long>"), "kn-facts")

    def totals(df: DataFrame, n: int) -> list[int]:
        row = df.filter("facts is not null").agg(*[F.sum(F.get("facts", F.lit(k))).alias(f"f{k}") for k in range(n)]).first()
        return [x or 0 for x in row]

    n_pairs, *pair_counts = totals(parts, 5)
    n_tokens, n_words, many, *word_counts = totals(words, 7)
    return {"folder": folder, "buckets": buckets, "tokens": n_tokens, "words": n_words, "pairs": n_pairs,
            "pair_discounts": discounts(pair_counts), "word_discounts": discounts(word_counts),
            "word_classes": [word_counts[0], word_counts[1], many]}


WORD = np.dtype([("hash", "<u8"), *((c, "<i8") for c in WORD_COLUMNS)])


def discounts(n: list[int]) -> list[float]:
    """[0, D1, D2, D3+] from the numbers of things counted 1, 2, 3 and 4 times;
    half the count where too little was seen."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k / 2
        out.append(min(max(d, 0.0), float(k)))
    return out


class Arrays:
    """Sorted hash arrays of one kind, memory-mapped when first used."""

    def __init__(self, model: dict, name: str, kind: np.dtype) -> None:
        self.model, self.name, self.kind, self.open = model, name, kind, {}

    def shard(self, bucket: int) -> np.ndarray:
        if bucket not in self.open:
            from pyarrow import fs

            system, base = fs.FileSystem.from_uri(self.model["folder"])
            place = f"{base}/{self.name}-{bucket:07d}"
            if len(self.open) >= 512:
                self.open.clear()
            if system.get_file_info(place).type == fs.FileType.NotFound:  # no hash fell into this range
                self.open[bucket] = np.empty(0, self.kind)
            elif system.type_name == "local":
                self.open[bucket] = np.memmap(place, self.kind, "r")
            else:  # a store that cannot be mapped
                with system.open_input_file(place) as f:
                    self.open[bucket] = np.frombuffer(f.read(), self.kind)
        return self.open[bucket]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Records of sorted hashes, all zero where unknown."""
        out = np.zeros(len(h), self.kind)
        target = bucket_of(h, self.model["buckets"])
        edges = np.nonzero(np.r_[True, target[1:] != target[:-1], True])[0] if len(h) else [0]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            shard = self.shard(int(target[lo]))
            if len(shard):
                place = np.minimum(np.searchsorted(shard["hash"], h[lo:hi]), len(shard) - 1)
                got = shard[place]
                hit = got["hash"] == h[lo:hi]
                out[lo:hi][hit] = got[hit]
        return out


def score_texts(parts: list[np.ndarray], model: dict, pairs: Arrays, words: Arrays) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) of some texts."""
    before, own = contexts(parts)
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    keys, place = np.unique(np.r_[own, before], return_inverse=True)
    facts = words.find(keys)
    w, h = facts[place[:len(own)]], facts[place[len(own):]]
    n, v = model["tokens"], model["words"]
    base = np.log10((w["count"] + 1.0) / (n + (v + 1)))
    # continuation model of single words
    d = np.array(model["word_discounts"])
    total = max(1, model["pairs"])
    free = float(np.dot(d[1:], model["word_classes"])) if model["pairs"] else 1.0
    after = w["after"]
    low = np.maximum(after - d[np.minimum(after, 3)], 0.0) / total + free / total / (v + 1)
    # pairs
    keys, place = np.unique(pair_hash(before, own), return_inverse=True)
    c = pairs.find(keys)["count"][place].astype(np.int64)
    d = np.array(model["pair_discounts"])
    freed = d[1] * h["follows1"] + d[2] * h["follows2"] + d[3] * h["follows3"]
    uses = np.maximum(h["uses"], 1)
    p = np.where(h["uses"] > 0, (np.maximum(c - d[np.minimum(c, 3)], 0.0) + freed * low) / uses, low)
    add = lambda x: np.add.reduceat(x, starts)
    return add(np.ones(len(own), np.int64)), add((w["count"] > 0).astype(np.int64)), add(base), add(np.log10(p))


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row."""
    def run(batch: pa.RecordBatch):
        if run.arrays is None:
            run.arrays = Arrays(model, "pairs", PAIR), Arrays(model, "words", WORD)
        parts, held, at = [], 0, 0
        for k, t in enumerate(text_bytes(batch.column(1)), 1):
            parts.append(tokens(t))
            held += len(parts[-1])
            if held >= SCORE_TOKENS or k == batch.num_rows:
                n, known, base, own = score_texts(parts, model, *run.arrays)
                yield {"doc_id": batch.column(0).slice(at, k - at), "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), model["tokens"]),
                       "base_score": base, "score": own, "perplexity": 10 ** (-own / n)}
                parts, held, at = [], 0, k

    run.arrays = None
    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(docs.select(doc_id, text), run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
