"""Whitening of vectors by their principal components.

Two passes give the covariance exactly: integer sums of all entries, then
integer sums of products of the entries centred on the rounded mean, each task
adding up its own rows in blocks that float64 products hold without rounding.
What rounding the mean left is taken off in whole numbers, so the covariance is
the true one to the last bit, whatever the order of the rows.  Its leading
eigenpairs are found on the driver (``eigen``: d x d numbers, whatever the
number of rows).  The projection, d x 32 numbers, is broadcast, and every row
is centred and projected where it lies.  A last pass measures the covariance of
the result against the identity.

Defined results: rows whose vector is null, empty, or holds a null or
non-finite entry are dropped; of vectors of several lengths those of the most
frequent length take part (ties: the longest), the others are dropped; a null
or repeated id is carried along, each row gives its own result; components
whose eigenvalue is nothing but rounding (all vectors equal in that direction,
or fewer vectors than dimensions) cannot be scaled to one and are left out; an
empty table gives no rows.  ``deviation`` is null where it needs more than 64
bits.  An entry whose scaled value needs more than 62 bits ends the query with
an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import map_batches, write_scratch
from neurotab.llm.eigen import leading_eigenpairs

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
EXACT = 1 << 53  # whole numbers up to here are exact in float64
SUMS = "dims int, pos int, part decimal(38,0)"


def fixed_point(embedding: Column, scale: int, offset: int) -> Column:
    """floor(scale * x) + offset of every entry; null unless all are finite."""
    ok = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fits = lambda y: F.when(F.abs(y) < float(1 << 62), F.floor(y)).otherwise(
        F.raise_error(F.lit("whitening: an entry needs more than 62 bits")).cast("bigint"))
    return F.when(ok & (F.size(embedding) > 0), F.transform(embedding, lambda x: fits(x.cast("double") * scale) + F.lit(offset).cast("bigint")))


def by_length(column: pa.Array):
    """(length, matrix) of the rows of a list column."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    start = np.cumsum(n) - n
    for d in np.unique(n):
        rows = np.nonzero(n == d)[0]
        yield int(d), flat[start[rows, None] + np.arange(d)] if len(rows) < len(n) else flat.reshape(len(n), d)


def exact_sums(m: np.ndarray) -> np.ndarray:
    """Column sums as Python numbers."""
    top = int(np.abs(m).max(initial=0))
    return m.sum(0).astype(object) if top * len(m) < 1 << 63 else m.astype(object).sum(0)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y as Python numbers, by float64 products of blocks too small to round."""
    top, d = int(np.abs(y).max(initial=0)), y.shape[1]
    total = np.zeros((d, d), object)
    if top * top >= EXACT:
        wide = y.astype(object)
        return wide.T @ wide
    step = max(1, EXACT // max(1, top * top))
    floats = y.astype(np.float64)
    for k in range(0, len(y), step):
        block = floats[k:k + step]
        total += (block.T @ block).astype(np.int64).astype(object)
    return total


def totals(rows: DataFrame, kernel) -> dict[int, list[tuple[int, int]]]:
    """Sums over all rows of what ``kernel`` makes of a matrix (a flat array of
    whole numbers), by length of the vectors: one row of parts a task and length,
    added up by Spark.  {length: [(place, sum)]} of the most frequent length;
    place 0 is the number of rows."""
    def run(batches):
        from neurotab.llm.common import as_batch

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, m in by_length(batch.column(0)):
                own = np.r_[np.array([len(m)], object), kernel(m)]
                sums[d] = sums[d] + own if d in sums else own
        arrow = pa.schema([("dims", pa.int32()), ("pos", pa.int32()), ("part", pa.decimal128(38, 0))])
        for d, s in sums.items():
            yield as_batch({"dims": np.full(len(s), d), "pos": np.arange(len(s)), "part": [Decimal(int(v)) for v in s]}, arrow)

    parts = rows.select("x").mapInArrow(run, SUMS).groupBy("dims", "pos").agg(F.sum("part").alias("total"))
    counts = write_scratch(parts, "whitening-sums")
    best = counts.filter("pos = 0").orderBy(F.desc("total"), F.desc("dims")).limit(1).select("dims")
    found = counts.join(best, "dims").select("dims", "pos", "total").collect()  # of one length: O(d^2) numbers
    return {r["dims"]: sorted((q["pos"], int(q["total"])) for q in found) for r in found[:1]}


@dataclass
class Model:
    """Mean and leading components of the fit rows; ``x`` holds all rows in fixed point."""

    x: DataFrame
    n: int = 0
    sums: np.ndarray = field(default_factory=lambda: np.zeros(0, object))
    covariance: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance) if len(self.values) else self.values


def middle_of(sums: np.ndarray, n: int) -> np.ndarray:
    return np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)


def fit(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS,
        scale: int = SCALE, offset: int = OFFSET) -> Model:
    """Mean, covariance and leading components of all vectors."""
    x = write_scratch(vectors.select(vectors[vec_id].alias("vec_id"), fixed_point(vectors[embedding], scale, offset).alias("x"))
                      .filter(F.col("x").isNotNull()), "whitening")
    first = totals(x, exact_sums)
    if not first:
        return Model(x.filter(F.lit(False)))
    (d, sums), = first.items()
    n, s = sums[0][1], np.array([v for _, v in sums[1:]], object)
    x, mid = x.filter(F.size("x") == d), middle_of(s, n)
    upper = np.triu_indices(d)
    products = totals(x, lambda m: exact_products(m - mid)[upper])[d]
    rest = s - n * mid.astype(object)
    covariance = np.zeros((d, d))
    for i, j, (_, p) in zip(*upper, products[1:], strict=True):
        covariance[i, j] = covariance[j, i] = (n * p - int(rest[i]) * int(rest[j])) / (n * n)
    values, found = leading_eigenpairs(covariance, components)
    real = values > max(values.max(initial=0), 0) * d * np.finfo(np.float64).eps * 4
    return Model(x, n, s, covariance, values[real], found[:, real])


def centred(m: np.ndarray, n: int, mid: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S/n: whole numbers near zero less what rounding the mean left."""
    return (m - mid) - rest


def deviations(m: np.ndarray, n: int, mid: np.ndarray, s: np.ndarray) -> pa.Array:
    """Sum over the dimensions of (n x - S)^2, exact; null over 64 bits."""
    y, rest = m - mid, s - n * mid.astype(object)
    top = n * int(np.abs(y).max(initial=0)) + max((abs(int(v)) for v in rest), default=0)
    if top * top * max(1, m.shape[1]) < 1 << 63:
        z = n * y - rest.astype(np.int64)
        return pa.array((z * z).sum(1), pa.int64())
    z = n * y.astype(object) - rest
    return pa.array([v if v < 1 << 63 else None for v in (z * z).sum(1)], pa.int64())


def project(model: Model, columns: str, make) -> DataFrame:
    """The rows of the model's table through ``make(ids, x, whitened)``; mean
    and projection are broadcast."""
    n, mid = model.n, middle_of(model.sums, model.n)
    rest = np.array([int(v) / n for v in model.sums - n * mid.astype(object)])
    sent = model.x.sparkSession.sparkContext.broadcast((model.components, np.sqrt(model.values)))

    def run(batch: pa.RecordBatch):
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            (_, m), = by_length(part.column(1))
            axes, deviation = sent.value
            yield make(part.column(0), m, centred(m, n, mid, rest) @ axes / deviation)

    return map_batches(model.x.select("vec_id", "x"), run, columns)


def identity_error(model: Model) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.values)
    upper = np.triu_indices(k)

    def sums(_, m, w):
        return {"part": [np.r_[w.sum(0), (w.T @ w)[upper]].tolist()]}

    parts = project(model, "part array<double>", sums).select(F.posexplode("part").alias("pos", "part"))
    rows = parts.groupBy("pos").agg(F.sum("part").alias("total")).orderBy("pos").collect()  # O(k^2) numbers
    total = np.array([r["total"] for r in rows]) / model.n
    cov = total[k:] - total[:k][upper[0]] * total[:k][upper[1]] - (upper[0] == upper[1])
    return float(np.abs(cov).max(initial=0))


def whiten(model: Model) -> DataFrame:
    """(vec_id, deviation long, whitened array<double>) of every row of the model."""
    kind = model.x.schema["vec_id"].dataType.simpleString()
    columns = f"vec_id {kind}, deviation bigint, whitened array<double>"
    if not model.n:
        return model.x.sparkSession.createDataFrame([], columns)
    mid, n, s = middle_of(model.sums, model.n), model.n, model.sums

    def rows(ids: pa.Array, m: np.ndarray, w: np.ndarray) -> dict:
        at = np.arange(len(m) + 1, dtype=np.int32) * w.shape[1]
        return {"vec_id": ids, "deviation": deviations(m, n, mid, s), "whitened": pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(w).ravel()))}

    return project(model, columns, rows)
