"""Exact k-nearest-neighbour join (Euclidean) in blocks.

Queries are packed into groups and points into blocks of fixed size, per
partition key, by a hash of their id, so a dominant key is many blocks.  Every
query group of a partition meets every point block of it through an equi-join
on (partition, block number): a stated query set against all rows, a block at
a time.  A task holds one group and one block as matrices; a matrix product
settles which points can be among the k best of a query, those alone get their
exact distance, and what is shuffled to the final ranking is k rows per query
and block, not the pairs.  No pruning by single coordinates is tried: in many
dimensions it settles no query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurotab.session import cut_lineage

QUERY_GROUP = 2048
POINT_BLOCK = 4096
# queries whose distances to a block are held at once, and groups of points that bound the k-th
SLICE = 256
SIEVE = 64
# a classifier is fitted on at most this many labelled rows (those of smallest hash)
MAX_TRAIN_ROWS = 1_000_000
# distances are compared to this many decimals, so that equal ones tie on any machine
DECIMALS = 9


def _packs(rows: DataFrame, part: Sequence[str], prefix: str) -> DataFrame:
    """(part..., {prefix}_no, {prefix}_ids, {prefix}_vecs): rows (part..., _no, _id, _v) packed."""
    fields = [T.StructField(c, rows.schema[c].dataType) for c in part]
    schema = T.StructType([*fields, T.StructField(f"{prefix}_no", T.LongType()), T.StructField(f"{prefix}_ids", T.ArrayType(T.LongType())),
                           T.StructField(f"{prefix}_vecs", T.BinaryType())])

    def pack(key, batches):
        ids, vecs = [], []
        for b in batches:
            ids += b.column("_id").to_pylist()
            lists = b.column("_v")
            vecs.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        values = [k.as_py() for k in key]
        yield pa.RecordBatch.from_pydict(
            dict(zip([*part, f"{prefix}_no"], [[v] for v in values], strict=True)) | {f"{prefix}_ids": [ids], f"{prefix}_vecs": [np.concatenate(vecs).tobytes()]},
            schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    pack.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.groupBy(*part, "_no").applyInArrow(pack, schema)


def _numbered(counted: DataFrame, part: Sequence[str], size: int, id_col: str, vec: str) -> DataFrame:
    """``counted`` are the rows with their partition's number of rows, ``_n``."""
    n = F.ceil(F.col("_n") / size)
    return counted.select(*part, F.pmod(F.xxhash64(id_col), n).alias("_no"), F.col(id_col).cast("long").alias("_id"),
                                                F.col(vec).cast("array<double>").alias("_v"))


def _squares(q: np.ndarray, p: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (rows, cols), in the same order of additions for every pair."""
    d = np.zeros(len(rows))
    for j in range(q.shape[1]):
        diff = q[rows, j] - p[cols, j]
        d += diff * diff
    return d


def _candidates(q: np.ndarray, p: np.ndarray, same: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) among which are each query's k nearest points, ties included.

    |q - p|^2 - |q|^2 comes from one matrix product.  The k-th smallest of the
    minima of disjoint groups of points is no less than the k-th smallest of
    all, so points beyond it, by more than the product's rounding errors and
    those of the compared distance, are settled without an exact distance."""
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    part = q @ (-2.0 * p.T)
    part += pp
    if same is not None:
        part[same] = np.inf
    width = max(1, len(p) // max(SIEVE, 2 * k))
    least = np.minimum.reduceat(part, np.arange(0, len(p), width), axis=1)
    bound = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] >= k else np.full(len(q), np.inf)
    error = 8 * (q.shape[1] + 8) * np.finfo(float).eps * (qq + pp.max(initial=0.0))
    reach = np.sqrt(np.maximum(bound + qq, 0) + error) + 2 * 10.0 ** -DECIMALS
    limit = reach * reach + error - qq
    limit += 4 * np.finfo(float).eps * (np.abs(reach * reach) + qq)
    return np.nonzero(part <= limit[:, None])


def _nearest(q: np.ndarray, p: np.ndarray, q_ids: np.ndarray, p_ids: np.ndarray, k: int, exclude_self: bool):
    """For each query: places of its k nearest points (ties by id) and distances.
    Only candidates get an exact distance, and only they are sorted."""
    by_id = np.argsort(p_ids, kind="stable")
    p, p_ids = p[by_id], p_ids[by_id]
    k = min(k, len(p))
    same = q_ids[:, None] == p_ids[None, :] if exclude_self else None
    if np.isfinite(q).all() and np.isfinite(p).all():
        rows, cols = _candidates(q, p, same, k)
    else:
        rows, cols = (v.ravel() for v in np.indices((len(q), len(p))))
    d = np.sqrt(_squares(q, p, rows, cols))
    key = np.round(d, DECIMALS)
    if same is not None:
        key[same[rows, cols]] = np.inf
    order = np.lexsort((cols, key, rows))  # of equal distances the first ids come first
    first = np.searchsorted(rows, np.arange(len(q)))
    chosen = order[first[:, None] + np.arange(k)]
    return by_id[cols[chosen]], d[chosen], np.isfinite(key[chosen])


def knn_join(queries: DataFrame, points: DataFrame, k: int, id_col: str = "id", vec: str = "features",
             partition: Sequence[str] = (), exclude_self: bool = False, payload: Sequence[str] = (),
             query_group: int = QUERY_GROUP, block: int = POINT_BLOCK) -> DataFrame:
    """For each query: its k nearest points of the same partition (ties by point id).

    Output: (q_id, partition..., p_id, payload..., distance, rank) with rank 1..k
    (fewer rows when the partition holds fewer points)."""
    part = list(partition)
    if part:
        count = lambda df: df.join(df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n")), part)
        last = points.groupBy(*part).agg((F.ceil(F.count(F.lit(1)) / block) - 1).alias("_last"))
    else:  # one implicit partition: its counts are two numbers, no join
        count = lambda df: df.withColumn("_n", F.lit(df.count()))
        last = F.lit(max(-(-points.count() // block) - 1, 0)).cast("long")
    blocks = _packs(_numbered(count(points), part, block, id_col, vec), part, "p")
    groups = _packs(_numbered(count(queries), part, query_group, id_col, vec), part, "q")
    numbered = groups.join(last, part) if part else groups.withColumn("_last", last)
    sent = numbered.withColumn("p_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last", "q_no")
    pairs = sent.join(blocks, [*part, "p_no"]).drop("p_no")
    fields = [T.StructField(c, queries.schema[c].dataType) for c in part]
    schema = T.StructType([T.StructField("q_id", T.LongType()), *fields, T.StructField("p_id", T.LongType()), T.StructField("distance", T.DoubleType())])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one pair of packs is held at a time, and SLICE of its queries
                row = {name: batch.column(name)[at] for name in batch.schema.names}
                q_ids, p_ids = (row[n].values.to_numpy(zero_copy_only=False) for n in ("q_ids", "p_ids"))
                q, p = (np.frombuffer(row[n].as_buffer()).reshape(len(i), -1) for n, i in (("q_vecs", q_ids), ("p_vecs", p_ids)))
                for lo in range(0, len(q), SLICE):
                    own = q_ids[lo:lo + SLICE]
                    place, distance, real = _nearest(q[lo:lo + SLICE], p, own, p_ids, k, exclude_self)
                    keep = real.ravel()
                    out = {"q_id": np.repeat(own, place.shape[1])[keep], "p_id": p_ids[place].ravel()[keep], "distance": distance.ravel()[keep]}
                    out |= {c: [row[c].as_py()] * int(keep.sum()) for c in part}
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    found = pairs.mapInArrow(match, schema)
    order = Window.partitionBy("q_id", *part).orderBy(F.round("distance", DECIMALS), "p_id")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if payload:
        top = top.join(points.select(F.col(id_col).alias("p_id"), *payload), "p_id")
    return top.select("q_id", *part, "p_id", *payload, "distance", "rank")


def knn_classify(train: DataFrame, test: DataFrame, k: int, label: str = "label", id_col: str = "id",
                 vec: str = "features", classes: Sequence[int] = (0, 1, 2), max_train: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Majority vote of the k nearest training rows; probability = vote share;
    ties go to the smallest label.  The training set is bounded by ``max_train``
    labelled rows: beyond it, a share picked by a hash of the id is used."""
    n = train.count()
    if n > max_train:
        train = cut_lineage(train.where(F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(1 << 30)) < int(max_train / n * (1 << 30))))
    nn = knn_join(test, train, k, id_col, vec, payload=[label])
    votes = nn.groupBy("q_id").agg(*[F.count_if(F.col(label) == c).alias(f"_v{c}") for c in classes],
                                   F.count(F.lit(1)).alias("_n"))
    arr = F.array(*[F.col(f"_v{c}") for c in classes])
    pred = F.array_position(arr, F.array_max(arr)) - 1
    return votes.select(F.col("q_id").alias(id_col), pred.cast("int").alias("prediction"),
                        *[(F.col(f"_v{c}") / F.col("_n")).alias(f"p{c}") for c in classes])
