"""Zero-phase filtering of signals of any length, block by block.

A signal is cut into blocks of ``block`` samples.  Over one block a recursive
filter is an affine map of its state: the state at the end is the state at the
start times a fixed matrix, plus what the block's own samples leave.  So all
blocks are first run from a zero state, their end states (ten numbers a block
for the band-pass) are composed along each signal, and every block is run once
more from its true start.  The backward pass does the same over the reversed
forward result.  The only arrays are blocks.

Composition is a scan: blocks are composed in groups of ``fan``, the groups'
maps by the same function, and the starts of the groups are handed back down,
so a signal of any length needs only groups of at most ``fan`` rows.

Defined results: signals no longer than the odd extension stay as they are; the
last block takes the rest of the signal, so it has up to twice the length; rows
with a null value or position take no part; repeated positions of a signal are
kept in value order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurotab.functions import kernels as kn
from neurotab.session import cut_lineage

BLOCK = 1024
FAN = 256
ARRAY = T.ArrayType(T.DoubleType())


def to_blocks(df: DataFrame, sig_keys: Sequence[str], block: int = BLOCK, idx: str = "sample_idx", value: str = "value") -> DataFrame:
    """(sig_keys..., blk, blocks, values) of the long layout; positions of a
    signal run from 0 without gaps.  Block k starts at sample k * block."""
    rows = df.where(F.col(value).isNotNull() & F.col(idx).isNotNull())
    counts = rows.groupBy(*sig_keys).agg(F.greatest(F.floor(F.count(F.lit(1)) / block), F.lit(1)).cast("long").alias("blocks"))
    numbered = rows.join(counts, list(sig_keys)).withColumn(
        "blk", F.least(F.floor(F.col(idx) / block).cast("long"), F.col("blocks") - 1))
    return numbered.groupBy(*sig_keys, "blk", "blocks").agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).cast("double").alias("v")))).alias("_s")) \
        .select(*sig_keys, "blk", "blocks", F.transform("_s", lambda s: s["v"]).alias("values"))


def from_blocks(blocks: DataFrame, sig_keys: Sequence[str], block: int = BLOCK, idx: str = "sample_idx", value: str = "value") -> DataFrame:
    return blocks.select(*sig_keys, "blk", F.posexplode("values").alias("_p", value)) \
        .select(*sig_keys, (F.col("blk") * block + F.col("_p")).cast("long").alias(idx), value)


def step_matrix(sections, n: int) -> np.ndarray:
    """How a start state reaches the end of ``n`` samples: end = start @ matrix + own."""
    m = 2 * len(sections)
    return kn.cascade(sections, [np.zeros(n)] * m, np.eye(m))[1]


def _rows(values: pd.Series, blk: pd.Series, blocks: pd.Series, pad: int, extend: bool, back: bool) -> list[np.ndarray]:
    """The samples that a block filters: with the odd extension at the ends of
    the signal if they lack it, reversed for the backward pass."""
    rows = [np.asarray(v, dtype=np.float64) for v in values]
    if extend:
        rows = [kn.odd_extension(r, pad, left=k == 0, right=k == n - 1) if k in (0, n - 1) else r
                for r, k, n in zip(rows, blk, blocks, strict=True)]
    return [r[::-1] for r in rows] if back else rows


def _end_state_udf(sections, pad: int, back: bool):
    zi = kn.cascade_zi(sections)

    @F.pandas_udf(ARRAY)
    def end_state(values: pd.Series, blk: pd.Series, blocks: pd.Series) -> pd.Series:
        rows = _rows(values, blk, blocks, pad, not back, back)
        first = (blocks - 1 if back else blk * 0).to_numpy() == blk.to_numpy()
        start = np.array([zi * r[0] if f else np.zeros(len(zi)) for r, f in zip(rows, first, strict=True)])
        return pd.Series(list(kn.cascade(sections, rows, start)[1]), dtype=object)
    return end_state


def _filter_udf(sections, pad: int, back: bool):
    zi = kn.cascade_zi(sections)

    @F.pandas_udf(ARRAY)
    def filtered(values: pd.Series, blk: pd.Series, blocks: pd.Series, start: pd.Series) -> pd.Series:
        rows = _rows(values, blk, blocks, pad, not back, back)
        state = np.array([zi * r[0] if s is None else np.asarray(s) for r, s in zip(rows, start, strict=True)])
        out, _ = kn.cascade(sections, rows, state)
        if back:  # in the order of time, without the extension
            out = [r[::-1][pad if k == 0 else 0:len(r) - (pad if k == n - 1 else 0)] for r, k, n in zip(out, blk, blocks, strict=True)]
        return pd.Series([np.ascontiguousarray(r) for r in out], dtype=object)
    return filtered


def start_states(ends: DataFrame, sig_keys: Sequence[str], matrix: np.ndarray, fan: int = FAN) -> DataFrame:
    """(sig_keys..., pos, start) for pos >= 1 from (sig_keys..., pos, own): the
    state before block ``pos`` is own[pos - 1] + start[pos - 1] @ matrix, and the
    first block's own state already holds its start."""
    size, keys = len(matrix), list(sig_keys)
    last = ends.agg(F.max("pos")).first()[0]

    def along(own: list, state: np.ndarray) -> list[np.ndarray]:
        """States before each row and after the last one."""
        states = [state]
        for c in own:
            state = np.asarray(c) + state @ matrix
            states.append(state)
        return states

    @F.pandas_udf(T.ArrayType(ARRAY))
    def before_each(own: pd.Series, begin: pd.Series) -> pd.Series:
        return pd.Series([[v.tolist() for v in along(o, np.zeros(size) if b is None else np.asarray(b))[:-1]] for o, b in zip(own, begin, strict=True)], dtype=object)

    @F.pandas_udf(ARRAY)
    def after_all(own: pd.Series) -> pd.Series:
        return pd.Series([along(o, np.zeros(size))[-1] for o in own], dtype=object)

    def gathered(rows: DataFrame, by: list[str]) -> DataFrame:
        """One row a group of at most ``fan`` blocks, in order."""
        return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "own"))).alias("s"))

    def told(groups: DataFrame) -> DataFrame:
        pairs = F.arrays_zip(F.col("s.pos").alias("pos"), before_each(F.col("s.own"), F.col("begin")).alias("start"))
        return groups.select(*keys, F.explode(pairs).alias("z")).select(*keys, "z.pos", "z.start").where("pos > 0")

    if last is None or last < fan:
        return told(gathered(ends, keys).withColumn("begin", F.lit(None).cast(ARRAY)))
    groups = cut_lineage(gathered(ends.withColumn("grp", F.floor(F.col("pos") / fan).cast("long")), [*keys, "grp"]))
    totals = cut_lineage(groups.select(*keys, F.col("grp").alias("pos"), after_all(F.col("s.own")).alias("own")))
    # every group but a signal's last one has ``fan`` blocks, and nothing follows the last
    begins = start_states(totals, keys, np.linalg.matrix_power(matrix, fan), fan)
    return told(groups.join(begins.select(*keys, F.col("pos").alias("grp"), F.col("start").alias("begin")), [*keys, "grp"], "left"))


def _pass(blocks: DataFrame, sig_keys: Sequence[str], sections, matrix: np.ndarray, back: bool, fan: int) -> DataFrame:
    """One direction over all blocks; ``blocks`` is read twice, so it is a stored table."""
    keys, pad = list(sig_keys), kn.padding(sections)
    place = F.col("blocks") - 1 - F.col("blk") if back else F.col("blk")
    ends = cut_lineage(blocks.select(*keys, place.alias("pos"), _end_state_udf(sections, pad, back)("values", "blk", "blocks").alias("own")))
    starts = start_states(ends, keys, matrix, fan)
    joined = blocks.withColumn("pos", place).join(starts, [*keys, "pos"], "left")
    return joined.select(*keys, "blk", "blocks", _filter_udf(sections, pad, back)("values", "blk", "blocks", "start").alias("values"))


def filter_blocks(blocks: DataFrame, sig_keys: Sequence[str], sections, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Zero-phase filter of a table of blocks; same columns.  Signals of one
    block are filtered where they are; longer ones in two passes."""
    if block <= kn.padding(sections):
        raise ValueError(f"a block must be longer than the extension of {kn.padding(sections)} samples")
    short = blocks.where("blocks = 1").withColumn("values", kn.zero_phase_udf(sections)(F.col("values")))
    long = cut_lineage(blocks.where("blocks > 1"))
    if long.isEmpty():
        return short
    matrix = step_matrix(sections, block)
    forward = cut_lineage(_pass(long, sig_keys, sections, matrix, False, fan))
    return short.unionByName(_pass(forward, sig_keys, sections, matrix, True, fan))


def zero_phase(df: DataFrame, sig_keys: Sequence[str], filters: Sequence, block: int = BLOCK, fan: int = FAN,
               idx: str = "sample_idx", value: str = "value") -> DataFrame:
    """Long layout: the signals after each of ``filters`` (lists of sections) in
    turn.  Output (sig_keys..., idx, value)."""
    blocks = cut_lineage(to_blocks(df, sig_keys, block, idx, value))
    for k, sections in enumerate(filters):
        blocks = filter_blocks(blocks, sig_keys, sections, block, fan)
        if k < len(filters) - 1:
            blocks = cut_lineage(blocks)
    return from_blocks(blocks, sig_keys, block, idx, value)
