"""Gradient-boosted trees over binned features, many classifiers at once.

Features are cut at quantiles into at most 32 bins, one byte each.  Trees are
grown level by level from histograms of the softmax gradients by (classifier,
class, node, feature, bin).  Gradients are rounded to whole numbers of 2^-20
before they are added, so sums do not depend on how rows are spread, and both
ways below grow the same trees:

* ``by_levels``: one aggregation a tree level for all classifiers, classes and
  nodes together.  Each task adds up the histograms of its rows, Spark merges
  them by node, and one split a node comes back.  Margins are written once a
  round.  The rows never leave their partitions.
* ``by_classifier``: where the whole binned table is within ``IN_TASK_CELLS``
  bytes (measured), it is broadcast and every classifier is one task.  A search
  over trials and folds is hundreds of short fits, and this runs them side by
  side without a job a level.

A classifier may leave out one fold; its margins for that fold come back as
out-of-fold predictions, so cross-validation needs no scoring pass.

Defined results: null and NaN features go to the lowest bin; a feature with one
value is never split; a class that no row has keeps its (falling) share; an
empty training set gives trees without splits and even probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab import config
from neurotab.session import cut_lineage, scratch_path

BINS = 32
IN_TASK_CELLS = 1 << 26
UNIT = float(1 << 20)
PENALTY, LEAST_WEIGHT = 1.0, 1.0
ACCURACY = 2000  # of the quantiles
ROWS_AT_ONCE = 1 << 15
COLUMN_AT_ONCE, TABLE_AT_ONCE, NODES_AT_ONCE, WALKED_AT_ONCE = 1 << 17, 1 << 15, 16, 1 << 13
CODES, PARTS, PAIRED = BINS * BINS, 8, 800  # codes of two features; parts of a table at most; rows a part from which a node is added up by pairs
APART = 2.25  # times the largest sum of g that h is scaled by: over 2, so that rounding tells h
MOST = 85  # rows of one code whose sums of g and h fit into one number, whatever they are
LOOKED_AT = 10_000
TREES = "plan int, round int, cls int, feature array<int>, cut array<int>, child array<int>, value array<double>"


@dataclass(frozen=True)
class Plan:
    """One classifier: ``rows`` is the share of rows, ``features`` the share of
    features ("all" or "sqrt") of a tree; ``leave_out`` a fold it must not see.
    With ``against`` it is a binary classifier of that class against the rest,
    one tree a round, grown as Spark's ``GBTClassifier`` does: the first tree on
    the labels -1 and 1 at full weight, the others on the residuals of its log
    loss, splits by variance, leaves the mean."""

    rounds: int = 300
    depth: int = 6
    step: float = 0.05
    rows: float = 1.0
    features: str = "all"
    seed: int = config.SEED
    leave_out: int | None = None
    against: int | None = None

    def step_of(self, turn: int) -> float:
        return 1.0 if self.against is not None and turn == 0 else self.step

    @property
    def penalty(self) -> float:
        return PENALTY if self.against is None else 0.0


# ---------------------------------------------------------------- binning

def quantile_cuts(data: DataFrame, bins: int = BINS, col: str = "features") -> list[list[float]]:
    """Cut points of every feature: values above a cut go to a higher bin."""
    share = [k / bins for k in range(1, bins)]
    rows = data.select(F.posexplode(col).alias("j", "x")).groupBy("j").agg(
        F.percentile_approx(F.when(~F.isnan("x"), F.col("x")), share, ACCURACY).alias("cuts")).orderBy("j").collect()
    return [sorted(set(r["cuts"] or [])) for r in rows]


def middle_cuts(data: DataFrame, bins: int = BINS, col: str = "features") -> list[list[float]]:
    """Cuts half way between values, where Spark's trees cut a table whose rows
    they all look at (no more than ``LOOKED_AT``): a feature's rows in strides."""
    def cut(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, n = (np.concatenate(v) for v in zip(*[(p.column("x").to_numpy(), p.column("n").to_numpy()) for p in parts], strict=True))
        order = np.argsort(x)
        x, n = x[order], n[order]
        middles, seen = (x[:-1] + x[1:]) / 2, np.cumsum(n)
        chosen = []
        if len(middles) < bins:
            chosen = middles.tolist()
        else:
            stride = target = seen[-1] / bins
            for i, m in enumerate(middles):
                if abs(seen[i] - target) < abs(seen[i + 1] - target):
                    chosen.append(float(m))
                    target += stride
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([chosen], pa.list_(pa.float64()))], ["j", "cuts"])

    values = data.select(F.posexplode(col).alias("j", "x"))
    found = values.where("x is not null and not isnan(x)").groupBy("j", (F.col("x") + 0.0).alias("x")).agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("j").applyInArrow(cut, "j int, cuts array<double>").collect()
    known = {r["j"]: r["cuts"] for r in found}
    width = data.agg(F.max(F.size(col))).first()[0] or 0
    return [known.get(j, []) for j in range(width)]


def bin_matrix(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        column = np.where(np.isnan(x[:, j]), -np.inf, x[:, j])
        out[:, j] = np.searchsorted(np.array(c), column, side="left")
    return out


def features_of(column: pa.Array, d: int) -> np.ndarray:
    lists = column.to_pylist()
    return np.array([[np.nan if v is None else v for v in row] for row in lists], np.float64).reshape(len(lists), d)


def binned(data: DataFrame, cuts: list[list[float]], fold_col: str | None, key: F.Column | None = None) -> DataFrame:
    """(id, key, label, fold, bins), written once; ``key`` is a hash of the id unless given."""
    d, kind = len(cuts), data.schema["id"].dataType.simpleString()
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(None).cast("int")
    key = F.xxhash64("id") if key is None else key
    rows = data.select("id", key.alias("key"), F.col("label").cast("int").alias("label"), fold.alias("fold"), "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = bin_matrix(features_of(b.column("features"), d), cuts)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([r.tobytes() for r in cells], pa.binary())], ["id", "key", "label", "fold", "bins"])

    return cut_lineage(rows.mapInArrow(run, f"id {kind}, key bigint, label int, fold int, bins binary"))


# ---------------------------------------------------------------- one round

def shares(margins: np.ndarray) -> np.ndarray:
    m = np.ascontiguousarray(margins.T)  # a few classes: column by column
    e = np.exp(m - m.max(0))
    return (e / e.sum(0)).T


def whole_gradients(margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the softmax loss, in whole units."""
    p = shares(margins).T
    g = p - (label == np.arange(margins.shape[1])[:, None])
    return np.rint(g * UNIT).T, np.rint(2 * p * (1 - p) * UNIT).T


def gradients(plan: Plan, turn: int, margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``whole_gradients``, or residuals and row counts of a class against the rest."""
    if plan.against is None:
        return whole_gradients(margins, label)
    y = np.where(label == plan.against, 1.0, -1.0)[:, None]
    rest = y if turn == 0 else 4 * y / (1 + np.exp(np.minimum(2 * y * margins, 700)))
    return np.rint(-rest * UNIT), np.full(rest.shape, UNIT)


def mixed(key: np.ndarray, salt: int) -> np.ndarray:
    h = key.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def learns(plan: Plan, turn: int, key: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Rows that the tree of this round is grown from."""
    use = fold != plan.leave_out if plan.leave_out is not None else np.ones(len(key), bool)
    if plan.rows < 1:
        use &= mixed(key, plan.seed * 1_000_003 + turn) < np.uint64(plan.rows * 2.0 ** 64)
    return use


def allowed(plan: Plan, turn: int, d: int) -> np.ndarray:
    """Features that the tree of this round may split."""
    mask = np.ones(d, bool)
    if plan.features == "sqrt":
        order = np.argsort(mixed(np.arange(d), plan.seed * 7_000_003 + turn), kind="stable")
        mask[order[max(1, int(np.sqrt(d))):]] = False
    return mask


class Trees:
    """The trees of one round, one a class, as lists of nodes; node 0 is the
    root, ``child`` the left of two neighbouring children (0: a leaf)."""

    def __init__(self, classes: int) -> None:
        self.feature, self.cut, self.child, self.value = ([[0] for _ in range(classes)] for _ in range(4))
        self.open = [(c, 0) for c in range(classes)]  # nodes of the level that is to be split

    def split(self, found: dict[tuple[int, int], tuple]) -> None:
        """Apply (feature, cut, left value, right value) of nodes; the others stay leaves."""
        after = []
        for c, node in self.open:
            if (c, node) in found:
                feature, cut, *values = found[c, node]
                if feature < 0:  # a root that stays a leaf
                    self.value[c][node] = values[0]
                    continue
                self.feature[c][node], self.cut[c][node], self.child[c][node] = feature, cut, len(self.child[c])
                for side in values:
                    after.append((c, len(self.child[c])))
                    self.feature[c].append(0)
                    self.cut[c].append(0)
                    self.child[c].append(0)
                    self.value[c].append(side)
        self.open = after

    def walk(self, cells: np.ndarray, c: int) -> np.ndarray:
        """The node that each row has come to in the tree of class ``c``."""
        feature, cut, child = (np.array(v[c]) for v in (self.feature, self.cut, self.child))
        level = [0] * len(child)
        for own, first in enumerate(self.child[c]):
            if first:
                level[first] = level[first + 1] = level[own] + 1
        leaf = child == 0  # its rows stay
        child[leaf], cut[leaf] = np.nonzero(leaf)[0], BINS
        node, flat, d = np.zeros(len(cells), np.int64), np.ravel(cells), cells.shape[1]
        for lo in range(0, len(cells), WALKED_AT_ONCE):
            own = node[lo:lo + WALKED_AT_ONCE]
            first = np.arange(lo, lo + len(own)) * d
            for _ in range(max(level)):
                own[:] = child.take(own) + (flat.take(first + feature.take(own)) > cut.take(own))
        return node

    def output(self, cells: np.ndarray) -> np.ndarray:
        return np.stack([np.array(v)[self.walk(cells, c)] for c, v in enumerate(self.value)], 1)

    def rows(self, plan: int, turn: int) -> list[tuple]:
        return [(plan, turn, c, self.feature[c], self.cut[c], self.child[c], [float(v) for v in self.value[c]]) for c in range(len(self.value))]


class Columns:
    """A table that many histograms are taken of in one task.

    * Features are taken in pairs: sums by the joint code of two bins, of which
      the sums by either bin are the margins.
    * A row's g and h are added up as one number, h * scale + g, where the sums of
      both are sure to fit: in the codes of a pair by the most rows that any code
      has in a part of the table (1 to ``PARTS`` parts, until most pairs fit), in a small node by its own sums.  Others are added
      up one after the other.

    Sums are of whole numbers below 2^53, so all ways give the same."""

    def __init__(self, cells: np.ndarray) -> None:
        self.features = np.ascontiguousarray(cells.T)
        self.used: np.ndarray | None = None

    def pair_up(self, used: np.ndarray) -> None:
        """Joint codes of the features ``used``, unless they are those of before."""
        if self.used is not None and np.array_equal(used, self.used):
            return
        self.used, n = used, self.features.shape[1]
        self.pairs = [(j, j + 1 if j + 1 < len(used) else None) for j in range(0, len(used), 2)]
        self.codes = [np.left_shift(self.features[used[a]], 5, dtype=np.uint16) + (0 if b is None else self.features[used[b]]) for a, b in self.pairs]
        part = np.arange(n) * PARTS // max(n, 1)
        counts = np.stack([np.bincount(part * CODES + c, minlength=PARTS * CODES).reshape(PARTS, CODES) for c in self.codes])
        for parts in (1, 2, 4, PARTS):
            self.most = counts.reshape(len(self.pairs), parts, PARTS // parts, CODES).sum(2).max((1, 2))
            if (self.most <= MOST).mean() >= 0.75:
                break
        else:
            parts, self.most = 1, counts.sum(1).max(1)
        self.parts, self.part = parts, part * parts // PARTS * CODES

    def histograms(self, places: list[tuple[np.ndarray, np.ndarray, np.ndarray]], used: np.ndarray) -> np.ndarray:
        out = np.zeros((len(places), 2, len(used), BINS))
        if not places or not len(used):
            return out
        self.pair_up(used)
        large = [i for i, p in enumerate(places) if len(p[0]) >= PAIRED * self.parts]
        small = [i for i, p in enumerate(places) if len(p[0]) < PAIRED * self.parts]
        whole = np.array([[np.abs(places[i][1]).sum(), places[i][2].sum()] for i in small]).reshape(-1, 2)
        scale = np.ceil(APART * whole[:, 0] + 1)
        fits = whole[:, 1] * scale + whole[:, 0] < 2.0 ** 53
        for some, how in ((large, self.paired), ([i for i, f in zip(small, fits, strict=True) if f], lambda x: self.single(x, scale[fits])),
                          ([i for i, f in zip(small, fits, strict=True) if not f], self.single)):
            if some:
                out[some] = how([places[i] for i in some])
        return out

    def paired(self, places: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Sums of large nodes by the codes of pairs."""
        n, wide = len(places), self.parts * CODES
        out = np.zeros((n, 2, len(self.used), BINS))
        if all(p[0] is places[0][0] for p in places):  # the roots: the same rows, other weights
            rows, first, weights = places[0][0], np.zeros(len(places[0][0]), np.int64), [p[1:] for p in places]
        else:
            rows, *w = (np.concatenate([p[k] for p in places]) for k in range(3))
            first, weights = np.repeat(np.arange(n) * wide, [len(p[0]) for p in places]), [w]
        first = first + self.part.take(rows)
        most_g, most_h = (max(float(np.abs(w[k]).max()) for w in weights) for k in range(2))
        # one factor for all pairs that fit, unless it is too much for one of them
        fits = self.most * (most_h * np.ceil(APART * self.most * most_g + 1) + most_g) < 2.0 ** 53
        joint = np.ceil(APART * self.most[fits].max(initial=0) * most_g + 1)
        fits &= self.most * (most_h * joint + most_g) < 2.0 ** 53
        packed, ones = [w[1] * joint + w[0] for w in weights], np.ones(BINS)
        for lo in range(0, len(rows), COLUMN_AT_ONCE):
            part = slice(lo, lo + COLUMN_AT_ONCE)
            own, low = rows[part], first[part]
            start, stop = int(low[0]) // wide, int(low[-1]) // wide + 1
            low, size = low - start * wide, (stop - start) * wide
            some = max(1, TABLE_AT_ONCE // (size * len(weights)))  # pairs whose tables are split up together
            for fit in (True, False):
                chosen = np.nonzero(fits == fit)[0]
                for pairs in np.split(chosen, range(some, len(chosen), some)) if len(chosen) else []:
                    sums = np.empty((2, len(weights), len(pairs), size))
                    for k, pair in enumerate(pairs):
                        index = low + self.codes[pair].take(own)
                        for i, w in enumerate(weights):
                            for x in (1,) if fit else (0, 1):
                                sums[x, i, k] = np.bincount(index, (packed[i] if fit else w[x])[part], size)
                    if fit:
                        both = sums[1].copy()
                        np.rint(both * (1 / joint), out=sums[1])
                        np.subtract(both, sums[1] * joint, out=sums[0])
                    shape = 2, len(weights), len(pairs), stop - start
                    left = (sums.reshape(-1, BINS) @ ones).reshape(*shape, self.parts, BINS).sum(4)
                    right = sums.reshape(*shape, -1, BINS).sum(4)
                    for k, pair in enumerate(pairs):
                        for j, x in zip(self.pairs[pair], (left, right), strict=True):
                            if j is not None and len(weights) == 1:
                                out[start:stop, :, j] += x[:, 0, k].swapaxes(0, 1)
                            elif j is not None:
                                out[:, :, j] += x[:, :, k, 0].swapaxes(0, 1)
        return out

    def single(self, places: list[tuple[np.ndarray, np.ndarray, np.ndarray]], scale: np.ndarray | None = None) -> np.ndarray:
        """Sums of small nodes by feature; with ``scale`` g and h of a node as one number."""
        n, lens = len(places), [len(p[0]) for p in places]
        rows, *weights = (np.concatenate([p[k] for p in places]) for k in range(3))
        if scale is not None:
            weights = [weights[1] * np.repeat(scale, lens) + weights[0]]
        first = np.repeat(np.arange(n) * BINS, lens)
        out = np.zeros((n, 2, len(self.used), BINS))
        for lo in range(0, len(rows), COLUMN_AT_ONCE):
            part = slice(lo, lo + COLUMN_AT_ONCE)
            own, low = rows[part], first[part]
            start, stop = int(low[0]), int(low[-1]) + BINS
            low = low - start
            nodes = slice(start // BINS, stop // BINS)
            for j, f in enumerate(self.used):
                index = low + self.features[f].take(own)
                for k, w in enumerate(weights):
                    out[nodes, k, j] += np.bincount(index, w[part], stop - start).reshape(-1, BINS)
        if scale is not None:
            both, scale = out[:, 0].copy(), scale[:, None, None]
            np.rint(both / scale, out=out[:, 1])
            np.subtract(both, out[:, 1] * scale, out=out[:, 0])
        return out


def histograms(cells: np.ndarray | Columns, places: list[tuple[np.ndarray, np.ndarray, np.ndarray]], used: np.ndarray) -> np.ndarray:
    """(node, [g, h], feature of ``used``, bin) sums; ``places`` has rows, g and h
    of each node.  A feature's cells are added up for all nodes at once, some rows at a time."""
    if isinstance(cells, Columns):
        return cells.histograms(places, used)
    n = len(places)
    out = np.zeros((n, 2, len(used), BINS))
    if not places:
        return out
    rows, *weights = (np.concatenate([p[k] for p in places]) for k in range(3))
    first = np.repeat(np.arange(n) * BINS, [len(p[0]) for p in places])
    for lo in range(0, len(rows), ROWS_AT_ONCE):
        part = slice(lo, lo + ROWS_AT_ONCE)
        low, g, h = first[part], weights[0][part], weights[1][part]
        start, stop = int(low[0]), int(low[-1]) + BINS  # rows stand in the order of their nodes
        low = low - start
        nodes = slice(start // BINS, stop // BINS)
        columns = np.ascontiguousarray(cells[rows[part]].T[used])
        for j, column in enumerate(columns):
            index = low + column
            out[nodes, 0, j] += np.bincount(index, g, stop - start).reshape(-1, BINS)
            out[nodes, 1, j] += np.bincount(index, h, stop - start).reshape(-1, BINS)
    return out


def best_splits(sums: np.ndarray, used: np.ndarray, step: float, penalty: float = PENALTY) -> list[tuple | None]:
    """(feature, cut, left value, right value) of each node, None where no split
    gains; ties go to the first feature and cut."""
    if not len(used):
        return [None] * len(sums)
    if len(sums) > NODES_AT_ONCE:  # what is worked on stays in the cache
        return [x for lo in range(0, len(sums), NODES_AT_ONCE) for x in best_splits(sums[lo:lo + NODES_AT_ONCE], used, step, penalty)]
    left_g, left_h = sums[:, 0].cumsum(2), sums[:, 1].cumsum(2)
    left_g *= 1 / UNIT
    left_h *= 1 / UNIT
    whole_g, whole_h = left_g[:, :1, -1:].copy(), left_h[:, :1, -1:].copy()  # any feature's bins add up to the node
    right_g, right_h = whole_g - left_g, whole_h - left_h

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        squares = a ** 2
        squares /= b + penalty
        return squares

    with np.errstate(divide="ignore", invalid="ignore"):  # sides without rows are ruled out below
        gain = score(left_g, left_h)
        gain += score(right_g, right_h)
        gain -= score(whole_g, whole_h)
    gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = -np.inf
    flat = gain.reshape(len(sums), -1)
    best = flat.argmax(1)
    leaf = lambda a, b: float(-step * a / (b + penalty))
    out: list[tuple | None] = []
    for i, b in enumerate(best):
        j, cut = divmod(int(b), BINS)  # above the last bin there are no rows
        out.append((int(used[j]), cut, leaf(left_g[i, j, cut], left_h[i, j, cut]), leaf(right_g[i, j, cut], right_h[i, j, cut])) if flat[i, b] > 1e-9 else None)
    return out


# ---------------------------------------------------------------- both ways to grow

def grow(plan: Plan, cells: np.ndarray, label: np.ndarray, fold: np.ndarray, key: np.ndarray, classes: int) -> tuple[np.ndarray, list[Trees]]:
    """Margins and trees of one classifier over a table held in one task."""
    held = fold == plan.leave_out if plan.leave_out is not None else np.zeros(len(cells), bool)
    left_out, cells, label, fold, key = cells[held], cells[~held], label[~held], fold[~held], key[~held]
    margins, left_margins, forest, d = np.zeros((classes, len(cells))), np.zeros((classes, len(left_out))), [], cells.shape[1]
    table = Columns(cells)
    for turn in range(plan.rounds):
        g, h = (np.ascontiguousarray(v.T) for v in gradients(plan, turn, margins.T, label))
        learned, step = learns(plan, turn, key, fold), plan.step_of(turn)
        trees, used = Trees(classes), np.nonzero(allowed(plan, turn, d))[0]
        own = dict.fromkeys([(c, 0) for c in range(classes)], np.nonzero(learned)[0])
        weight: dict[tuple[int, int], np.ndarray] = {}  # h of the rows of a node
        place = lambda k: (own[k], g[k[0]].take(own[k]), weight[k])  # noqa: E731, B023
        before: dict[tuple[int, int], np.ndarray] = {}  # sums of the parents, by their left child
        if plan.against is not None and learned.any():
            trees.value[0][0] = float(-step * (g[0][learned].sum() / UNIT) / (h[0][learned].sum() / UNIT))
        for _ in range(plan.depth):
            # a node that cannot give two children of the least weight needs no histogram
            weight = {k: h[k[0]].take(own[k]) for k in trees.open}
            trees.open = [k for k in trees.open if weight[k].sum() >= 2 * LEAST_WEIGHT * UNIT]
            if not trees.open:
                break
            at = trees.open
            sums = level_sums(table, at, own, place, before, used)
            found = {k: s for k, s in zip(at, best_splits(sums, used, step, plan.penalty), strict=True) if s}
            trees.split(found)
            before = {(k[0], trees.child[k[0]][k[1]]): s for k, s in zip(at, sums, strict=True) if k in found}
            for (c, n), (j, cut, *_) in found.items():
                rows, child = own.pop((c, n)), trees.child[c][n]
                right = table.features[j].take(rows) > cut
                own[c, child], own[c, child + 1] = rows[~right], rows[right]
        unseen, added = np.nonzero(~learned)[0], np.empty_like(margins)
        if len(unseen):
            added[:, unseen] = trees.output(cells[unseen]).T
        for (c, n), rows in own.items():  # rows that were learned from stand at their leaves
            added[c][rows] = trees.value[c][n]
        margins += added
        left_margins += trees.output(left_out).T
        forest.append(trees)
    whole = np.zeros((len(held), classes))
    whole[~held], whole[held] = margins.T, left_margins.T
    return whole, forest


def level_sums(cells: np.ndarray | Columns, at: list[tuple[int, int]], own: dict, place, before: dict, used: np.ndarray) -> np.ndarray:
    """Sums of the nodes ``at``.  Of two neighbours the one with fewer rows is
    added up, the other is what is left of their parent (whole numbers: exactly)."""
    left = [(c, n if (c, n) in before else n - 1) for c, n in at]
    counted = {k if k not in before or len(own[k]) <= len(own[k[0], k[1] + 1]) else (k[0], k[1] + 1)
               for k in left if k in before} | {k for k in at if not before}
    # a node whose neighbour is not asked for is added up itself if it has fewer rows
    order = {k: i for i, k in enumerate(sorted(counted))}
    direct = histograms(cells, [place(k) for k in order], used)
    return np.stack([direct[order[k]] if k in order else before[first] - direct[order[first[0], 2 * first[1] + 1 - k[1]]] for k, first in zip(at, left, strict=True)])


def by_classifier(rows: DataFrame, plans: Sequence[Plan], classes: int, keep_trees: bool) -> tuple[DataFrame, DataFrame]:
    """Every classifier in one task over the broadcast table."""
    spark = rows.sparkSession
    table = rows.toArrow()
    n = table.num_rows
    cells = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8)
    d = len(cells) // n if n else 0
    fold = np.array([-1 if v is None else v for v in table["fold"].to_pylist()], np.int64)
    sent = spark.sparkContext.broadcast((cells.reshape(n, d), np.array(table["label"].to_pylist(), np.int64), fold,
                                         np.array(table["key"].to_pylist(), np.int64), table["id"].combine_chunks()))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"{TREES}, id {kind}, margins array<double>"

    names = ["plan", "round", "cls", "feature", "cut", "child", "value", "id", "margins"]
    whole, lists = pa.int32(), pa.list_(pa.int32())
    kinds = [whole, whole, whole, lists, lists, lists, pa.list_(pa.float64()), table.schema.field("id").type, pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, label, fold, key, ids = sent.value
        for k in (k for batch in batches for k in batch.column("plan").to_pylist()):
            margins, forest = grow(plans[k], cells, label, fold, key, classes)
            grown = [(*row, None, None) for t, trees in enumerate(forest) for row in trees.rows(k, t)] if keep_trees else []
            held = np.nonzero(fold == plans[k].leave_out)[0] if plans[k].leave_out is not None else np.zeros(0, int)
            left = [(k, -1, -1, None, None, None, None, i, m) for i, m in zip(ids.take(pa.array(held)).to_pylist(), margins[held].tolist(), strict=True)]
            for part in (grown, left):
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], names)

    # the longest fits start first, one a task
    order = sorted(range(len(plans)), key=lambda k: -plans[k].rounds * plans[k].depth)
    work = spark.createDataFrame([(place, k) for place, k in enumerate(order)], "place int, plan int").repartitionByRange(len(plans), "place")
    done = cut_lineage(work.select("plan").mapInArrow(run, schema))
    return done.where("round >= 0").select(*[c.split()[0] for c in TREES.split(", ")]), done.where("round < 0").select("plan", "id", "margins")


def by_levels(rows: DataFrame, plans: Sequence[Plan], classes: int, d: int, keep_trees: bool) -> tuple[DataFrame, DataFrame]:
    """All classifiers together, one aggregation a tree level over all rows."""
    spark, p = rows.sparkSession, len(plans)
    kind = rows.schema["id"].dataType.simpleString()
    state_schema = f"id {kind}, key bigint, label int, fold int, bins binary, margins binary"
    state = rows.withColumn("margins", F.lit(None).cast("binary"))
    kept: list[tuple] = []

    def read(batch: pa.RecordBatch):
        n = batch.num_rows
        cells = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, d)
        fold = np.array([-1 if v is None else v for v in batch.column("fold").to_pylist()], np.int64)
        margins = np.stack([np.zeros((p, classes)) if m is None else np.frombuffer(m, np.float64).reshape(p, classes) for m in batch.column("margins").to_pylist()]) if n else np.zeros((0, p, classes))
        return cells, np.array(batch.column("label").to_pylist(), np.int64), fold, np.array(batch.column("key").to_pylist(), np.int64), margins

    for turn in range(max(q.rounds for q in plans)):
        trees = {k: Trees(classes) for k, q in enumerate(plans) if turn < q.rounds}
        for level in range(max(plans[k].depth for k in trees)):
            growing = {k: t for k, t in trees.items() if level < plans[k].depth and t.open}
            if not growing:
                break
            totals = _level(state, read, plans, growing, turn, d)
            for k, t in growing.items():
                t.split({(c, n): s for (q, c, n), s in totals.items() if q == k})

        def add(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells, _, _, _, margins = read(b)
                for k, t in trees.items():
                    margins[:, k] += t.output(cells)
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([m.tobytes() for m in margins], pa.binary())], b.schema.names)

        path = scratch_path(spark, "margins")
        state.mapInArrow(add, state_schema).write.parquet(path)
        state = spark.read.schema(state_schema).parquet(path)
        if keep_trees:
            kept += [r for k, t in trees.items() for r in t.rows(k, turn)]
    leave_out = [q.leave_out for q in plans]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, fold, _, margins = read(b)
            for k, f in enumerate(leave_out):
                which = np.nonzero(fold == f)[0] if f is not None else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), k, np.int32)), b.column(0).take(pa.array(which)), pa.array(list(margins[which, k]), pa.list_(pa.float64()))], ["plan", "id", "margins"])

    return spark.createDataFrame(kept, TREES), state.mapInArrow(held, f"plan int, id {kind}, margins array<double>")


def _level(state: DataFrame, read, plans: Sequence[Plan], growing: dict[int, Trees], turn: int, d: int) -> dict:
    """{(plan, class, node): split} of one level: histograms by task, merged by node."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            cells, label, fold, key, margins = read(b)
            for k, trees in growing.items():
                g, h = gradients(plans[k], turn, margins[:, k], label)
                use, used = learns(plans[k], turn, key, fold), np.nonzero(allowed(plans[k], turn, d))[0]
                for c in sorted({c for c, _ in trees.open}):
                    node = np.where(use, trees.walk(cells, c), -1)
                    names = [n for q, n in trees.open if q == c]
                    own = [np.nonzero(node == n)[0] for n in names]
                    for n, s in zip(names, histograms(cells, [(o, g[o, c], h[o, c]) for o in own], used), strict=True):
                        sums[k, c, n] = sums[k, c, n] + s if (k, c, n) in sums else s
        if sums:
            at = list(sums)
            yield pa.RecordBatch.from_arrays([*[pa.array([a[i] for a in at], pa.int32()) for i in range(3)],
                                              pa.array([sums[a].tobytes() for a in at], pa.binary())], ["plan", "cls", "node", "sums"])

    def merge(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c, n = (v.as_py() for v in key)
        used = np.nonzero(allowed(plans[k], turn, d))[0]
        total = sum(np.frombuffer(s, np.float64).reshape(1, 2, len(used), BINS) for part in parts for s in part.column("sums").to_pylist())
        plan = plans[k]
        split = best_splits(total, used, plan.step_of(turn), plan.penalty)[0]
        whole = total[0, :, 0].sum(1) / UNIT if len(used) else np.zeros(2)
        if not split and n == 0 and plan.against is not None and whole[1]:
            split = -1, 0, float(-plan.step_of(turn) * whole[0] / whole[1]), 0.0
        if split:
            yield pa.RecordBatch.from_pylist([{"plan": k, "cls": c, "node": n, "feature": split[0], "cut": split[1], "low": split[2], "high": split[3]}],
                                             pa.schema([(x, pa.int32()) for x in ("plan", "cls", "node", "feature", "cut")] + [("low", pa.float64()), ("high", pa.float64())]))

    found = state.mapInArrow(partial, "plan int, cls int, node int, sums binary").groupBy("plan", "cls", "node").applyInArrow(
        merge, "plan int, cls int, node int, feature int, cut int, low double, high double")
    return {(r["plan"], r["cls"], r["node"]): (r["feature"], r["cut"], r["low"], r["high"]) for r in found.collect()}  # a split a node


def boost(data: DataFrame, plans: Sequence[Plan], fold_col: str | None = None, classes: int = 3, keep_trees: bool = True,
          in_task_cells: int = IN_TASK_CELLS) -> tuple[list[list[float]], DataFrame, DataFrame]:
    """Fit all ``plans`` on (id, label, features[, fold]).  Returns the cuts, the
    trees (plan, round, cls, nodes) and the margins of left-out rows (plan, id, margins)."""
    as_spark = all(q.against is not None for q in plans) and data.count() <= LOOKED_AT
    cuts = (middle_cuts if as_spark else quantile_cuts)(data)
    rows = binned(data, cuts, fold_col)
    d = len(cuts)
    if rows.count() * max(d, 1) <= in_task_cells:
        return cuts, *by_classifier(rows, plans, classes, keep_trees)
    return cuts, *by_levels(rows, plans, classes, d, keep_trees)


def probabilities(margins: F.Column) -> F.Column:
    e = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))


def forest_margins(data: DataFrame, cuts: list[list[float]], trees: DataFrame, classes: int = 3) -> DataFrame:
    """(id, margins) of new rows through a stored forest, whose size is that of the model."""
    stored = trees.orderBy("round", "cls").toArrow().to_pylist()
    rounds: list[Trees] = []
    for k in range(0, len(stored), classes):
        t = Trees(classes)
        for r in stored[k:k + classes]:
            t.feature[r["cls"]], t.cut[r["cls"]], t.child[r["cls"]], t.value[r["cls"]] = r["feature"], r["cut"], r["child"], r["value"]
        rounds.append(t)
    sent = data.sparkSession.sparkContext.broadcast(rounds)
    kind, d = data.schema["id"].dataType.simpleString(), len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = bin_matrix(features_of(b.column("features"), d), cuts)
            total = np.zeros((len(cells), classes))
            for t in sent.value:
                total += t.output(cells)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(total), pa.list_(pa.float64()))], ["id", "margins"])

    return data.select("id", "features").mapInArrow(run, f"id {kind}, margins array<double>")
