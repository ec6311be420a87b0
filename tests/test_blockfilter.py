"""Block-wise zero-phase filtering equals the whole-signal filter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurotab.functions import kernels as kn
from neurotab.operators import blockfilter as bf
from neurotab.operators import preprocess as pp

BAND, NOTCH = pp.cleaning_filters(128.0)


def long_table(spark, signals):
    rows = [(s, c, x.tolist()) for (s, c), x in signals.items()]
    arrays = spark.createDataFrame(rows, "rec long, channel string, v array<double>")
    return arrays.select("rec", "channel", F.posexplode("v").alias("sample_idx", "value")).repartition(7)


def collected(df):
    out = {}
    for r in df.select("rec", "channel", "sample_idx", "value").orderBy("sample_idx").collect():
        out.setdefault((r["rec"], r["channel"]), []).append((r["sample_idx"], r["value"]))
    return out


@pytest.mark.parametrize("block, fan", [(64, 4), (64, 100), (1024, 256)])
def test_blocks_equal_the_whole_signal(spark, block, fan):
    rng = np.random.default_rng(1)
    lengths = [5000, 20, 33, 34, 63, 64, 65, 127, 128, 129, 1000]
    signals = {(k, "F3"): 100 + np.cumsum(rng.normal(size=n)) for k, n in enumerate(lengths)}
    out = collected(bf.zero_phase(long_table(spark, signals), ["rec", "channel"], [BAND, NOTCH], block, fan))
    assert set(out) == set(signals)
    for key, x in signals.items():
        want = kn.zero_phase(NOTCH, kn.zero_phase(BAND, [x]))[0]
        assert [i for i, _ in out[key]] == list(range(len(x)))
        np.testing.assert_allclose([v for _, v in out[key]], want, rtol=0, atol=1e-9)


def test_no_array_is_longer_than_two_blocks(spark):
    signals = {(0, "F3"): np.arange(1000.0), (1, "F4"): np.ones(37)}
    blocks = bf.to_blocks(long_table(spark, signals), ["rec", "channel"], 64)
    assert blocks.agg(F.max(F.size("values"))).first()[0] < 128
    assert blocks.where("rec = 0").count() == 15 and blocks.where("rec = 1").first()["blocks"] == 1
    back = collected(bf.from_blocks(blocks, ["rec", "channel"], 64))
    assert [v for _, v in back[0, "F3"]] == list(range(1000))


def test_start_states_of_many_levels(spark):
    rng = np.random.default_rng(2)
    matrix, own = rng.normal(size=(3, 3)) * 0.4, rng.normal(size=(40, 3))
    rows = [(key, k, (own[k] * key).tolist()) for key in (1, 2) for k in range(40 if key == 1 else 7)]
    ends = spark.createDataFrame(rows, "key long, pos long, own array<double>")
    for fan in (2, 3, 7, 64):
        got = {(r["key"], r["pos"]): r["start"] for r in bf.start_states(ends, ["key"], matrix, fan).collect()}
        assert len(got) == 39 + 6
        for key, n in ((1, 40), (2, 7)):
            state = np.zeros(3)
            for k in range(1, n):
                state = own[k - 1] * key + state @ matrix
                np.testing.assert_allclose(got[key, k], state, atol=1e-12)


def test_empty_table_nulls_and_short_blocks(spark):
    empty = spark.createDataFrame([], "rec long, channel string, sample_idx long, value double")
    assert bf.zero_phase(empty, ["rec", "channel"], [BAND, NOTCH]).count() == 0
    df = spark.createDataFrame([(1, "a", 0, 1.0), (1, "a", None, 2.0), (1, "a", 1, None)], "rec long, channel string, sample_idx long, value double")
    assert collected(bf.zero_phase(df, ["rec", "channel"], [NOTCH])) == {(1, "a"): [(0, 1.0)]}
    with pytest.raises(ValueError, match="longer than the extension"):
        bf.zero_phase(df, ["rec", "channel"], [BAND], block=33)
