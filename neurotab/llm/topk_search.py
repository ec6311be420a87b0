"""Exact top-k inner products by block-at-a-time pruning.

Documents are packed into shards of ``SHARD`` rows, a shard into ranges (blocks)
of ``BLOCK`` documents after neighbours in the shard were brought together.
Each block keeps the largest and smallest weight of every term (dimension) and
a forward index, its small integer matrix.  For a query the bound of a block is
the sum over terms of weight times maximum (minimum, where the query is
negative).  Blocks are visited in the order of their bounds, per query, and
scored until the next bound falls below the query's k-th score; equal bounds
are still scored, since a tie may hold a smaller id.

Query groups of ``GROUP`` vectors meet every shard through an equi-join on the
shard number, so a task holds one shard and one group at a time.  The join is
always a shuffle: the groups are copied for every shard, which the planner does
not count when it takes them to be small enough to send through the driver.  A
shard is dealt to ``SLOTS`` keys, each for a part of the groups.  A first round
against one shard gives each query a k-th score to prune with everywhere else.

Defined results: vectors that are null or hold null or non-finite components
take no part, neither do null ids; vectors of other lengths count as padded
with zeros; every row with the query's own id is left out; repeated rows are
candidates one by one, repeated query ids are one query (the smallest vector); an empty table gives no
rows.  Scores are 64-bit: components whose products pass them (about 1e8 and
more at 64 dimensions) are not meant for this search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurotab.llm.common import as_batch, map_batches, write_scratch

SHARD = 8192
BLOCK = 128
GROUP = 512
AHEAD = 8  # blocks of a query that are scored before its bounds are looked at again
SLOTS = 4
SCALE = 64


def quantized(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null unless all are finite."""
    ok = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(ok, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix, padded with zeros."""
    lists = column.to_pylist()
    out = np.zeros((len(lists), max(map(len, lists), default=0)), np.int64)
    for k, row in enumerate(lists):
        out[k, :len(row)] = row
    return out


def pack(m: np.ndarray) -> bytes:
    for kind in (np.int8, np.int16, np.int32):
        if not m.size or np.iinfo(kind).min <= m.min() and m.max() <= np.iinfo(kind).max:
            m = m.astype(kind)
            break
    return b"%d %d " % (m.dtype.itemsize, m.shape[1]) + m.tobytes()


def unpack(data: bytes) -> np.ndarray:
    item, width, body = data.split(b" ", 2)
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[int(item)]
    return np.frombuffer(body, kind).reshape(-1, int(width)) if int(width) else np.zeros((0, 0), kind)


def neighbours_first(m: np.ndarray) -> np.ndarray:
    """An order of the rows that puts vectors with the same strongest terms together."""
    if not m.size:
        return np.arange(len(m))
    strong = np.argsort(-np.abs(m), axis=1, kind="stable")[:, :3]
    sign = np.take_along_axis(m, strong, 1) < 0
    code = strong * 2 + sign
    return np.lexsort(code.T[::-1])


def packed(rows: DataFrame, number: Column, name: str) -> DataFrame:
    """(name, ids, body): rows (vec_id, v) packed by their number."""
    def group(key, batches):
        ids, parts = [], []
        for batch in batches:
            ids.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
            parts.append(matrix(batch.column("v")))
        width = max(p.shape[1] for p in parts)
        m = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])
        ids = np.concatenate(ids).astype(np.int64)
        order = neighbours_first(m)
        yield as_batch({name: [key[0].as_py()], "ids": [ids[order].tobytes()], "body": [pack(m[order])]}, schema)

    schema = pa.schema([(name, pa.int64()), ("ids", pa.binary()), ("body", pa.binary())])
    group.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.select("vec_id", "v", number.alias("_g")).groupBy("_g").applyInArrow(group, f"{name} long, ids binary, body binary")


def search(query: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, docs: np.ndarray, ids: np.ndarray, k: int):
    """Top k of each query in one shard: (scores, ids), filled up with the lowest
    long and -1; only scores at or above ``kth`` are sure to be complete."""
    width = max(query.shape[1], docs.shape[1])
    query, docs = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (query, docs))
    most = float(np.abs(query, dtype=np.float64).max(initial=0)) * float(np.abs(docs, dtype=np.float64).max(initial=0)) * width
    # the narrowest type in which all sums are exact
    kind = np.float32 if most < 2 ** 24 else np.float64 if most < 2 ** 53 else np.int64
    query, docs = query.astype(kind), docs.astype(kind)
    starts = np.arange(0, len(docs), BLOCK)
    high = np.maximum.reduceat(docs, starts, axis=0)
    low = np.minimum.reduceat(docs, starts, axis=0)
    bounds = (np.maximum(query, 0) @ high.T + np.minimum(query, 0) @ low.T).astype(np.int64)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = np.full((len(query), k), np.iinfo(np.int64).min)
    best_ids = np.full((len(query), k), -1, np.int64)
    kth = kth.copy()
    for lo in range(0, len(starts), AHEAD):
        ahead = order[:, lo:lo + AHEAD]
        row, place = np.nonzero(np.take_along_axis(bounds, ahead, 1) >= kth[:, None])
        if not len(row):
            break
        block = ahead[row, place]
        by_block = np.argsort(block, kind="stable")
        hits = []
        for some in np.split(by_block, np.nonzero(np.diff(block[by_block]))[0] + 1):
            s, some = starts[block[some[0]]], row[some]
            scores = query[some] @ docs[s:s + BLOCK].T
            # what is below the k-th score changes nothing
            r, c = np.nonzero((scores >= kth[some, None]) & (ids[None, s:s + BLOCK] != query_ids[some, None]))
            hits.append((some[r], scores[r, c].astype(np.int64), ids[s + c]))
        rows, scores, found = (np.concatenate(x) for x in zip(*hits, strict=True))
        hit = np.unique(rows)
        rows, scores, found = (np.concatenate(x) for x in ((np.repeat(hit, k), rows), (best[hit].ravel(), scores), (best_ids[hit].ravel(), found)))
        place = np.lexsort((found, ~scores, rows))
        rank = np.arange(len(rows)) - np.searchsorted(rows[place], rows[place])
        place, rank = place[rank < k], rank[rank < k]
        best[rows[place], rank], best_ids[rows[place], rank] = scores[place], found[place]
        kth[hit] = np.maximum(kth[hit], best[hit, k - 1])
    return best, best_ids


def meet(groups: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of query groups (grp, shard, query_ids, queries, kth)
    joined to their shards."""
    dealt = shards.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))))
    pairs = groups.withColumn("slot", F.pmod("grp", F.lit(SLOTS))).hint("merge").join(dealt.hint("merge"), ["shard", "slot"])
    pairs = pairs.select("query_ids", "queries", "kth", "ids", "body")

    def run(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            query_ids, ids = (np.frombuffer(row[c], np.int64) for c in ("query_ids", "ids"))
            best, found = search(unpack(row["queries"]), query_ids, np.frombuffer(row["kth"], np.int64), unpack(row["body"]), ids, k)
            q, place = np.nonzero(found >= 0) if (found >= 0).all() else np.nonzero(best > np.iinfo(np.int64).min)
            yield {"query_id": query_ids[q], "vec_id": found[q, place], "score": best[q, place]}

    return map_batches(pairs, run, "query_id long, vec_id long, score long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row with ``is_query``, its k
    highest integer inner products against all other rows, ties to smaller ids."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantized(F.col(embedding)).alias("v"), is_query.alias("q"))
    rows = write_scratch(rows.filter("v is not null and vec_id is not null"), "topk-vectors")
    queries = rows.filter("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    n, n_queries = rows.count(), queries.count()
    n_shards, n_groups = -(-n // SHARD) or 1, -(-n_queries // GROUP) or 1
    shards = write_scratch(packed(rows, F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)), "shard"), "topk-shards")
    groups = write_scratch(packed(queries, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_groups)), "grp"), "topk-groups")
    groups = groups.select("grp", F.col("ids").alias("query_ids"), F.col("body").alias("queries"))

    def no_bound(batch: pa.RecordBatch) -> dict:
        low = [np.full(len(x.as_py()) // 8, np.iinfo(np.int64).min).tobytes() for x in batch.column(1)]
        return {"grp": batch.column(0), "query_ids": batch.column(1), "queries": batch.column(2), "kth": low}

    kind = "grp long, query_ids binary, queries binary, kth binary"
    first = map_batches(groups, no_bound, kind).withColumn("shard", F.pmod("grp", F.lit(n_shards)))
    home = write_scratch(best_of(meet(first, shards, k), k).drop("rank"), "topk-home")
    if n_shards == 1:
        return best_of(home, k).select("query_id", "rank", "vec_id", "score")
    # the k-th score of each query at home, put back beside its group
    kth = home.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    kth = kth.select(F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(n_groups)).alias("grp"), F.struct("query_id", F.when(F.col("n") >= k, F.col("low")).alias("low")).alias("x"))
    lows = kth.groupBy("grp").agg(F.collect_list("x").alias("lows"))  # at most a group's queries

    def bounded(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            known = {x["query_id"]: x["low"] for x in row["lows"] or ()}
            least = np.iinfo(np.int64).min
            low = [least if known.get(q) is None else known[q] for q in np.frombuffer(row["query_ids"], np.int64).tolist()]
            yield {"grp": [row["grp"]], "query_ids": [row["query_ids"]], "queries": [row["queries"]], "kth": [np.array(low, np.int64).tobytes()]}

    armed = map_batches(groups.join(lows, "grp", "left").select("grp", "query_ids", "queries", "lows"), bounded, kind)
    armed = write_scratch(armed, "topk-armed").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    others = meet(armed.filter(F.col("shard") != F.pmod("grp", F.lit(n_shards))), shards, k)
    return best_of(home.unionByName(others), k).select("query_id", "rank", "vec_id", "score")
