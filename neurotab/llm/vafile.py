"""Centroid clustering over a vector-approximation file.

Each vector is kept twice: in full in a file of the shared folder, and as an
approximation of 6 bits a dimension, the cell of its component between
quantiles of that dimension.  For a centroid c, a table gives the least and the
greatest share that a component in each cell can have in the squared distance;
their sums over the dimensions are an interval that holds the true distance.
The distance from a fixed middle m, |x - m|^2, is the same for all centroids of
a vector, so the tables leave it out: what remains, |c - m|^2 - 2 (x - m)(c - m),
is linear in x and its interval is as narrow as the cells.  A centroid whose
interval starts above the least upper end cannot be nearest.  Where one centroid
is left the vector is decided from its cells alone; where intervals overlap the
vector is fetched and its distances to the candidates are computed.  All of it
is integer arithmetic, so assignments are exact.

A round reads the table of approximations (cells and last assignment, in blocks
of 4,096 vectors) and writes the next one.  Sums per centroid are carried from
round to round: a task fetches only vectors that moved, and sends the change of
the sums, one row a task, which Spark adds up; k x (d + 1) numbers reach the
driver.  Rounds read what the last one wrote, so a lost executor repeats its
own tasks only; a vector file that a lost task left is in no table.

Defined results: vectors of another length, null, or with a null or non-finite
component take no part; a null id takes part (it is last among those that could
start a centroid), equal ids and equal vectors each count; of vectors with one
hash the smaller vector starts the centroid; fewer vectors than centroids make
as many centroids as there are vectors; an empty table gives no rows; other
columns are not read.  A scaled component of 2^26 or more ends the query with an
error, since 64-bit distances could overflow.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import as_batch, write_scratch
from neurotab.session import scratch_path

SCALE, DIMENSIONS, CENTROIDS, ROUNDS = 256, 64, 40, 5
CELL_BITS = 6
BLOCK = 4096
LARGEST = 1 << 26
ACCURACY = 1000  # of the quantiles; any cells give the same result


def fixed_point(embedding: Column, scale: int, dimensions: int) -> Column:
    """floor(scale * x) of every component as int; null unless all are finite."""
    ok = (F.size(embedding) == dimensions) & F.forall(
        embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fits = lambda y: F.when(F.abs(y) < LARGEST, y.cast("int")).otherwise(
        F.raise_error(F.lit("clustering: a scaled component of 2^26 or more")).cast("int"))
    return F.when(ok, F.transform(embedding, lambda x: fits(F.floor(x.cast("double") * scale))))


def packed(cells: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Cells (n, d) with ``bits`` bits each, a row of bytes a vector."""
    return np.packbits((cells[:, :, None] >> np.arange(bits, dtype=np.uint8) & 1).reshape(len(cells), -1), axis=1)


def unpacked(rows: np.ndarray, d: int, bits: int = CELL_BITS) -> np.ndarray:
    flat = np.unpackbits(rows, axis=1, count=d * bits).reshape(len(rows), d, bits)
    return (flat << np.arange(bits, dtype=np.uint8)).sum(2, dtype=np.uint8)


@dataclass
class Cells:
    """Boundaries of the cells of each dimension: cell c holds the whole numbers
    from ``low[d][c]`` to ``high[d][c]``; ``middle`` is a point among the vectors."""

    cuts: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    middle: list[int]

    @classmethod
    def between(cls, quantiles: list[list[int]], least: list[int], most: list[int]) -> Cells:
        cuts = [np.array(sorted({c for c in q if a < c <= b}), np.int64) for q, a, b in zip(quantiles, least, most, strict=True)]
        return cls(cuts, [np.r_[a, c] for c, a in zip(cuts, least, strict=True)], [np.r_[c - 1, b] for c, b in zip(cuts, most, strict=True)],
                   [int(q[len(q) // 2]) for q in quantiles])

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, x[:, k], side="right") for k, cut in enumerate(self.cuts)], 1).astype(np.uint8)

    def intervals(self, cells: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of each vector to each centroid,
        both without the vector's own distance to the middle."""
        least = np.zeros((len(cells), len(centroids)), np.int64)
        most = np.zeros_like(least)
        for k, (low, high, m) in enumerate(zip(self.low, self.high, self.middle, strict=True)):
            c = centroids[:, k] - m
            ends = c * c - 2 * c * (low - m)[:, None], c * c - 2 * c * (high - m)[:, None]  # by cell and centroid
            least += np.minimum(*ends)[cells[:, k]]
            most += np.maximum(*ends)[cells[:, k]]
        return least, most


class Vectors:
    """Rows of one vector file, read at the places asked for."""

    def __init__(self, path: str, kind: str, dimensions: int) -> None:
        from pyarrow import fs

        self.system, self.place = fs.FileSystem.from_uri(path)
        self.kind, self.d = np.dtype(kind), dimensions
        self.map = None
        if self.system.type_name == "local":
            self.map = np.memmap(self.place, self.kind, "r").reshape(-1, dimensions)

    def block(self, start: int, n: int) -> np.ndarray:
        if self.map is not None:
            return self.map[start:start + n]
        width = self.kind.itemsize * self.d
        with self.system.open_input_file(self.place) as f:  # a store that cannot be mapped
            return np.frombuffer(f.read_at(n * width, start * width), self.kind).reshape(n, self.d)

    def rows(self, start: int, n: int, which: np.ndarray) -> np.ndarray:
        return self.block(start, n)[which].astype(np.int64)


def nearest(cells: Cells, codes: np.ndarray, centroids: np.ndarray, fetch) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) of each vector, and
    which vectors ``fetch`` had to read."""
    least, most = cells.intervals(codes, centroids)
    candidate = least <= most.min(1, keepdims=True)
    found = candidate.argmax(1)
    open_ = np.nonzero(candidate.sum(1) > 1)[0]
    if len(open_):
        x, candidate = fetch(open_), candidate[open_]
        best = np.full(len(open_), np.iinfo(np.int64).max)
        for c in range(len(centroids)):
            own = np.nonzero(candidate[:, c])[0]
            distance = ((x[own] - centroids[c]) ** 2).sum(1)
            closer = distance < best[own]
            best[own[closer]] = distance[closer]
            found[open_[own[closer]]] = c
    return found, open_


@dataclass
class Model:
    """State between rounds: ``blocks`` (the approximations), centroids and sums."""

    blocks: DataFrame
    cells: Cells
    kind: str
    centroids: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    fetched: list[int] = field(default_factory=list)  # vectors read in full by each assignment, sums of moved ones aside
    moved: list[int] = field(default_factory=list)


def starting_centroids(x: DataFrame, k: int, seed: str) -> np.ndarray:
    order = F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    return np.array([r["x"] for r in x.orderBy(order.asc_nulls_last(), "x").limit(k).select("x").collect()], np.int64)


def block_schema(x: DataFrame) -> str:
    ids = x.schema["vec_id"].dataType.simpleString()
    return f"file string, start bigint, n int, ids array<{ids}>, cells binary, cluster binary, change array<bigint>"


def approximate(x: DataFrame, cells: Cells, kind: str, dimensions: int) -> DataFrame:
    """Write the vector files and the table of their approximations."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    folder, schema = scratch_path(x.sparkSession, "vectors"), block_schema(x)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        path, at, out = f"{uuid.uuid4().hex}.vec", 0, None
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(k, BLOCK)
                    n, column = part.num_rows, part.column(1)
                    m = column.flatten().to_numpy().reshape(n, dimensions)
                    if out is None:
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(f"{base}/{path}")
                    out.write(m.astype(kind).tobytes())
                    ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(0))
                    yield as_batch({"file": [f"{folder}/{path}"], "start": [at], "n": [n], "ids": ids, "cells": [packed(cells.of(m)).tobytes()],
                                    "cluster": [b""], "change": [None]}, arrow)
                    at += n
        finally:
            if out is not None:
                out.close()

    return write_scratch(x.select("vec_id", "x").mapInArrow(run, schema), "approximations")


def start(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", centroids: int = CENTROIDS,
          dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = "2:") -> Model | None:
    """The approximation file and the first centroids; None without vectors."""
    x = write_scratch(vectors.select(vectors[vec_id].alias("vec_id"), fixed_point(vectors[embedding], scale, dimensions).alias("x"))
                      .filter(F.col("x").isNotNull()), "fixed-point")
    share = [k / (1 << CELL_BITS) for k in range(1, 1 << CELL_BITS)]
    of = [F.get("x", F.lit(k)) for k in range(dimensions)]
    row = x.agg(F.array(*[F.percentile_approx(c, share, ACCURACY) for c in of]), F.array(*[F.min(c) for c in of]), F.array(*[F.max(c) for c in of])).first()
    if row[1][0] is None:
        return None
    cells = Cells.between(*row)
    top = max(-min(row[1]) - 1, max(row[2]), 1)
    kind = next(t for t in ("<i1", "<i2", "<i4") if top <= np.iinfo(t).max)
    first = starting_centroids(x, centroids, seed)
    return Model(approximate(x, cells, kind, dimensions), cells, kind, first, np.zeros((len(first), dimensions), np.int64), np.zeros(len(first), np.int64))


def assigned(model: Model, centroids: np.ndarray):
    """A function of a batch of blocks: for each block its row, vectors, new
    and old numbers and the places of fetched vectors."""
    cells, kind, (k, d) = model.cells, model.kind, centroids.shape

    def run(batch: pa.RecordBatch):
        opened: dict[str, Vectors] = {}
        for row in batch.select(["file", "start", "n", "cells", "cluster"]).to_pylist():
            if row["file"] not in opened:
                opened = {row["file"]: Vectors(row["file"], kind, d)}
            vectors = opened[row["file"]]
            codes = unpacked(np.frombuffer(row["cells"], np.uint8).reshape(row["n"], -1), d)
            fetch = lambda which, v=vectors, r=row: v.rows(r["start"], r["n"], which)
            new, read = nearest(cells, codes, centroids, fetch)
            old = np.frombuffer(row["cluster"], np.int32) if row["cluster"] else np.full(row["n"], -1, np.int32)
            yield row, fetch, new, old, read

    return run


def one_round(model: Model) -> None:
    """Assign every vector, then move the centroids to the floored means."""
    from pyspark.sql.pandas.types import to_arrow_schema

    centroids, (k, d) = model.centroids, model.centroids.shape
    arrow, each = to_arrow_schema(model.blocks.schema), assigned(model, model.centroids)

    def run(batches):
        sums, counts, seen = np.zeros((k, d), np.int64), np.zeros(k, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            new_clusters = []
            for row, fetch, new, old, read in each(batch):
                went = np.nonzero(new != old)[0]
                seen += len(read), len(went)
                if len(went):
                    x = fetch(went)
                    for c in np.unique(np.r_[new[went], old[went]]):
                        if c >= 0:
                            sums[c] += x[new[went] == c].sum(0) - x[old[went] == c].sum(0)
                            counts[c] += (new[went] == c).sum() - (old[went] == c).sum()
                new_clusters.append(new.astype(np.int32).tobytes())
            kept = {name: batch.column(name) for name in ("file", "start", "n", "ids", "cells")}
            yield as_batch(kept | {"cluster": new_clusters, "change": [None] * batch.num_rows}, arrow)
        change = np.r_[seen, counts, sums.ravel()].tolist()
        yield as_batch({"change": [change]} | {f.name: pa.nulls(1, f.type) for f in arrow if f.name != "change"}, arrow)

    written = write_scratch(model.blocks.mapInArrow(run, model.blocks.schema), "round")
    parts = written.filter(F.col("file").isNull()).select(F.posexplode("change").alias("pos", "part"))
    total = np.array([r["total"] for r in parts.groupBy("pos").agg(F.sum("part").alias("total")).orderBy("pos").collect()], np.int64)
    model.blocks = written.filter(F.col("file").isNotNull())
    model.fetched.append(int(total[0]))
    model.moved.append(int(total[1]))
    model.counts = model.counts + total[2:2 + k]
    model.sums = model.sums + total[2 + k:].reshape(k, d)
    filled = model.counts > 0
    model.centroids = np.where(filled[:, None], model.sums // np.maximum(model.counts, 1)[:, None], centroids)


def assign(model: Model) -> DataFrame:
    """(vec_id, cluster int, distance long) of every vector.  The distance is
    exact, so this pass reads every vector in full beside its cells."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ids = model.blocks.schema["ids"].dataType.elementType.simpleString()
    schema = f"vec_id {ids}, cluster int, distance bigint"
    arrow, each, centroids = to_arrow_schema(StructType.fromDDL(schema)), assigned(model, model.centroids), model.centroids

    def run(batches):
        for batch in batches:
            names = batch.column("ids")
            for i, (row, fetch, new, _, _) in enumerate(each(batch)):
                x = fetch(np.arange(row["n"]))
                yield as_batch({"vec_id": names[i].values, "cluster": new, "distance": ((x - centroids[new]) ** 2).sum(1)}, arrow)

    return model.blocks.mapInArrow(run, schema)


def cluster(vectors: DataFrame, rounds: int = ROUNDS, **how) -> tuple[DataFrame, Model | None]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)
    and the model after ``rounds`` rounds and one more assignment."""
    model = start(vectors, **how)
    if model is None:
        ids = vectors.schema[how.get("vec_id", "vec_id")].dataType.simpleString()
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {ids}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"), None
    for _ in range(rounds):
        one_round(model)
    out = write_scratch(assign(model), "clusters")
    inertia = {r["cluster"]: r["total"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model.centroids.tolist()]
    of_cluster = out.sparkSession.createDataFrame(
        [(c, v, sum(inertia.values()), digest[c]) for c, v in inertia.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return out.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), model
