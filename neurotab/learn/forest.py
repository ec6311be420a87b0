"""Random forests over binned features, the trees of all folds side by side.

The trees are those of Spark's ``RandomForestClassifier``: Poisson(1) weights of
the rows, a square root of the features drawn anew at each node, Gini gain over
at most 32 bins cut as Spark cuts them, sibling leaves of equal prediction
merged, and a forest's probability the mean of its leaves' class shares.  Spark
moves the class counts of every node of every tree through a shuffle at each
level, once a partition, and starts again for each fold.  Here the binned table
(one byte a value) is broadcast and a task grows some trees of one fold whole;
nothing but trees, or the left-out rows' summed shares, comes back.

A table of more than ``IN_TASK_CELLS`` bytes is not broadcast: ``fits_in_task``
says so, and the caller leaves it to Spark's own forest.

Weights come from a hash of the row and features from the tree's number, so the
forest does not depend on how rows are spread.  Shares are added as whole
numbers of 2^-40, so their sums do not either.

Defined results: as with Spark's forest, null features count as 0, and NaN or
infinite ones, null rows and an empty training set raise when a forest is grown.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab import config
from neurotab.learn import boosting
from neurotab.learn.boosting import BINS, LOOKED_AT, bin_matrix, binned, features_of, middle_cuts, mixed, quantile_cuts
from neurotab.session import cut_lineage

TREES = "plan int, tree int, feature array<int>, cut array<int>, child array<int>, shares array<double>"
TREES_A_TASK = 10
ROWS_AT_ONCE = 1 << 17
SHARE_UNIT = float(1 << 40)
LEAST_GAIN = 1e-12
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


@dataclass(frozen=True)
class Bagging:
    """One forest; ``leave_out`` is a fold it must not see."""

    trees: int = 300
    depth: int = 10
    seed: int = config.SEED
    leave_out: int | None = None


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root, ``child`` the left of two
    neighbouring children (0: a leaf), ``shares`` (node, class)."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    shares: np.ndarray

    def output(self, cells: np.ndarray) -> np.ndarray:
        node = np.zeros(len(cells), np.int64)
        at = np.arange(len(cells))
        while len(at := at[self.child[node[at]] > 0]):
            own = node[at]
            node[at] = self.child[own] + (cells[at, self.feature[own]] > self.cut[own])
        return self.shares[node]


def row_weights(key: np.ndarray, salt: int) -> np.ndarray:
    """How often each row is drawn: Poisson(1)."""
    return np.searchsorted(POISSON, (mixed(key, salt) >> np.uint64(11)) * 2.0 ** -53, side="right")


def class_counts(cells: np.ndarray, rows: np.ndarray, slot: np.ndarray, label: np.ndarray, weight: np.ndarray, used: np.ndarray,
                 classes: int) -> np.ndarray:
    """(drawn feature, class, node, bin) weights; ``slot`` is each row's place
    among the nodes, ``used`` has the features drawn at each."""
    nodes, drawn = used.shape
    out = np.zeros((drawn, classes * nodes * BINS))
    for lo in range(0, len(rows), ROWS_AT_ONCE):
        part = slice(lo, lo + ROWS_AT_ONCE)
        own, w = slot[part], weight[part]
        low = (label[part] * nodes + own) * BINS
        block, start = cells[rows[part]].ravel(), np.arange(len(own)) * cells.shape[1]
        for s in range(drawn):
            out[s] += np.bincount(low + block[start + used[own, s]], w, out.shape[1])
    return out.reshape(drawn, classes, nodes, BINS)


def gini_splits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gain, place of the feature, cut, left counts) of each node's best split;
    ties go to the first feature and cut."""
    left = counts.cumsum(3)
    whole = left[..., -1:]
    left = left[..., :-1]
    right = whole - left
    n_left, n_right, n = (v.sum(1) for v in (left, right, whole))
    with np.errstate(divide="ignore", invalid="ignore"):  # sides without rows are ruled out below
        gain = ((left * left).sum(1) / n_left + (right * right).sum(1) / n_right - (whole * whole).sum(1) / n) / n
    gain[(n_left < 1) | (n_right < 1)] = -np.inf
    flat = gain.swapaxes(0, 1).reshape(counts.shape[2], -1)
    best, each = flat.argmax(1), np.arange(len(flat))
    place, cut = np.divmod(best, BINS - 1)
    return flat[each, best], place, cut, left[place, :, each, cut]


def grow_tree(cells: np.ndarray, label: np.ndarray, weight: np.ndarray, plan: Bagging, tree: int, classes: int) -> Tree:
    d = cells.shape[1]
    drawn, rng = math.ceil(math.sqrt(d)), np.random.default_rng([plan.seed, tree])
    rows = np.nonzero(weight)[0]
    y, w = label[rows], weight[rows].astype(np.float64)
    feature, cut, child = ([np.zeros(1, np.int64)] for _ in range(3))
    held = [np.bincount(y, w, classes)[None]]  # class counts of the nodes
    nodes, slot, count = np.zeros(1, np.int64), np.zeros(len(rows), np.int64), 1
    for level in range(plan.depth if d else 0):
        # nodes of one class stay leaves
        several = (np.concatenate(held)[nodes] > 0).sum(1) > 1
        stay = several[slot]
        rows, y, w, slot, nodes = rows[stay], y[stay], w[stay], (np.cumsum(several) - 1)[slot[stay]], nodes[several]
        if not len(nodes):
            break
        used = np.sort(rng.random((len(nodes), d)).argsort(1)[:, :drawn], 1)
        gain, which, at, left = gini_splits(class_counts(cells, rows, slot, y, w, used, classes))
        split = gain > LEAST_GAIN
        if not split.any():
            break
        first = count + 2 * (np.cumsum(split) - 1)  # the left child of each split node
        by = used[np.arange(len(nodes)), which]
        feature, cut, child, held = ([np.concatenate(v)] for v in (feature, cut, child, held))
        whole = held[0][nodes]
        parents = nodes[split]
        feature[0][parents], cut[0][parents], child[0][parents] = by[split], at[split], first[split]
        more = 2 * int(split.sum())
        for v in (feature, cut, child):
            v.append(np.zeros(more, np.int64))
        held.append(np.stack([left[split], (whole - left)[split]], 1).reshape(more, classes))
        nodes = np.arange(count, count + more)
        count += more
        if level + 1 < plan.depth:
            stay = split[slot]
            rows, y, w, slot = rows[stay], y[stay], w[stay], slot[stay]
            slot = first[slot] - nodes[0] + (cells[rows, by[slot]] > at[slot])
    feature, cut, child, held = (np.concatenate(v) for v in (feature, cut, child, held))
    return merged(feature, cut, child, held)


def merged(feature: np.ndarray, cut: np.ndarray, child: np.ndarray, held: np.ndarray) -> Tree:
    """The tree without splits whose two sides are leaves of one prediction; children stand behind their parents."""
    said, below = held.argmax(1).tolist(), child.tolist()
    for i in range(len(below) - 1, -1, -1):
        c = below[i]
        if c and not below[c] and not below[c + 1] and said[c] == said[c + 1]:
            below[i], said[i] = 0, said[c]
    total = held.sum(1, keepdims=True)
    shares = np.where(total > 0, held / np.where(total > 0, total, 1), 1 / held.shape[1])
    return Tree(feature, cut, np.array(below, np.int64), shares)


# ---------------------------------------------------------------- on Spark

def fits_in_task(data: DataFrame, in_task_cells: int | None = None) -> bool:
    """Whether the binned table is small enough to be broadcast."""
    n, d = data.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    return n * max(d or 0, 1) <= (boosting.IN_TASK_CELLS if in_task_cells is None else in_task_cells)


def _checked(data: DataFrame) -> DataFrame:
    odd = F.col("features").isNull() | F.exists("features", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("features", lambda x: F.coalesce(x, F.lit(0.0)))
    return data.withColumn("features", F.when(F.coalesce(odd, F.lit(False)), F.raise_error(F.lit("features must not be null, NaN or infinite"))).otherwise(whole))


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list of each row of a matrix."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel(), kind))


def grow_forests(data: DataFrame, plans: Sequence[Bagging], fold_col: str | None = None,
                 keep_trees: bool = True) -> tuple[list[list[float]], int, DataFrame, DataFrame]:
    """Grow all ``plans`` on (id, label, features[, fold]).  Returns the cuts, the
    number of classes, the trees and (plan, id, shares) of the left-out rows."""
    spark = data.sparkSession
    data = _checked(data)
    cuts = (middle_cuts if data.count() <= LOOKED_AT else quantile_cuts)(data)
    rows = binned(data, cuts, fold_col, F.xxhash64("id", "features"))
    table = rows.toArrow()  # within IN_TASK_CELLS
    n, d = table.num_rows, len(cuts)
    cells = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(n, d)
    label = np.array(table["label"].to_pylist(), np.int64)
    fold = np.array([-1 if v is None else v for v in table["fold"].to_pylist()], np.int64)
    for plan in plans:
        if not (fold != plan.leave_out if plan.leave_out is not None else np.ones(n, bool)).any():
            raise ValueError("no rows to grow a forest from")
    classes = int(label.max()) + 1
    sent = spark.sparkContext.broadcast((cells, label, fold, table["key"].to_numpy(), table["id"].combine_chunks()))
    kind, id_type = rows.schema["id"].dataType.simpleString(), table.schema.field("id").type
    whole, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())
    names = ["plan", "tree", "feature", "cut", "child", "shares", "place", "id", "units"]
    kinds = [pa.int32(), pa.int32(), whole, whole, whole, doubles, pa.int64(), id_type, pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, label, fold, key, ids = sent.value

        def batch(k: int, size: int, **columns: pa.Array) -> pa.RecordBatch:
            columns["plan"] = pa.array(np.full(size, k, np.int32))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in zip(names, kinds, strict=True)], names)

        for b in batches:
            for k, lo, hi in zip(*(b.column(c).to_pylist() for c in ("plan", "lo", "hi")), strict=True):
                plan = plans[k]
                out = np.nonzero(fold == plan.leave_out)[0] if plan.leave_out is not None else np.zeros(0, np.int64)
                left_out, units = cells[out], np.zeros((len(out), classes), np.int64)
                for t in range(lo, hi):
                    weight = row_weights(key, plan.seed * 1_000_003 + t)
                    weight[out] = 0
                    grown = grow_tree(cells, label, weight, plan, t, classes)
                    if keep_trees:
                        lists = {c: _lists(getattr(grown, c)[None], pa.int32()) for c in ("feature", "cut", "child")}
                        yield batch(k, 1, tree=pa.array([t], pa.int32()), shares=_lists(grown.shares.reshape(1, -1), pa.float64()), **lists)
                    if len(out):
                        units += np.rint(grown.output(left_out) * SHARE_UNIT).astype(np.int64)
                if len(out):
                    yield batch(k, len(out), place=pa.array(out), id=ids.take(pa.array(out)), units=_lists(units, pa.int64()))

    work = [(k, lo, min(lo + TREES_A_TASK, p.trees)) for k, p in enumerate(plans) for lo in range(0, p.trees, TREES_A_TASK)]
    dealt = spark.createDataFrame([(i, *v) for i, v in enumerate(work)], "no int, plan int, lo int, hi int").repartitionByRange(len(work), "no")
    done = cut_lineage(dealt.select("plan", "lo", "hi").mapInArrow(run, f"{TREES}, place bigint, id {kind}, units array<bigint>"))
    trees = done.where("tree is not null").select(*[c.split()[0] for c in TREES.split(", ")])
    summed = done.where("tree is null").groupBy("plan", "place").agg(F.first("id").alias("id"), *[F.sum(F.get("units", F.lit(c))).alias(f"_u{c}") for c in range(classes)])
    total = sum((F.col(f"_u{c}") for c in range(1, classes)), F.col("_u0"))
    return cuts, classes, trees, summed.select("plan", "id", F.array(*[F.col(f"_u{c}") / total for c in range(classes)]).alias("shares"))


def forest_shares(data: DataFrame, cuts: list[list[float]], classes: int, trees: DataFrame) -> DataFrame:
    """(id, shares) of new rows through a stored forest, whose size is that of the
    model; NaN lies above every cut, as in Spark's trees."""
    stored = trees.orderBy("tree").toArrow()
    forest = [Tree(*(r[c].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("feature", "cut", "child")), r["shares"].values.to_numpy().reshape(-1, classes))
              for r in ({c: stored[c][i] for c in stored.column_names} for i in range(stored.num_rows))]
    sent = data.sparkSession.sparkContext.broadcast(forest)
    kind, d = data.schema["id"].dataType.simpleString(), len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = bin_matrix(features_of(b.column("features"), d), cuts)
            total = np.zeros((len(cells), classes))
            for t in sent.value:
                total += t.output(cells)
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists(total / len(sent.value), pa.float64())], ["id", "shares"])

    above = F.transform("features", lambda x: F.when(F.isnan(x), float("inf")).otherwise(F.coalesce(x, F.lit(0.0))))
    return data.select("id", above.alias("features")).mapInArrow(run, f"id {kind}, shares array<double>")
