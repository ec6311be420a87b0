"""Two-exchange transforms and resampling equal the array kernel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurotab.functions.kernels import fourier_resample_matrix
from neurotab.operators import blockfft as bf

RNG = np.random.default_rng(7)


def table(spark, signals):
    rows = [(k, c, x.tolist()) for (k, c), x in signals.items()]
    return spark.createDataFrame(rows, "rec long, channel string, v array<double>").select("rec", "channel", F.posexplode("v").alias("sample_idx", "value"))


def collected(df):
    out = {}
    for r in df.orderBy("sample_idx").collect():
        out.setdefault((r["rec"], r["channel"]), []).append((r["sample_idx"], r["value"]))
    return out


@pytest.mark.parametrize("sr_in, sr_out", [(256.0, 128.0), (128.0, 256.0), (512.0, 200.0)])
def test_resampling_of_long_signals(spark, sr_in, sr_out):
    lengths = [512, 4096, 509, 510, 1021, 40, 7]  # 509 and 1021 are prime, 40 and 7 fit an array
    signals = {(k, "F3"): 50 + np.cumsum(RNG.normal(size=n)) for k, n in enumerate(lengths)}
    got = collected(bf.resample(table(spark, signals), ["rec", "channel"], sr_in, sr_out, longest=80))
    for key, x in signals.items():
        want = fourier_resample_matrix(x[None], int(len(x) * sr_out / sr_in))[0]
        assert [i for i, _ in got[key]] == list(range(len(want)))
        np.testing.assert_allclose([v for _, v in got[key]], want, rtol=0, atol=1e-9)


def test_no_array_is_longer_than_the_root(spark):
    assert bf.split_length(4096, 64) == (64, 64) and bf.split_length(509, 64) is None and bf.split_length(2 * 509, 64) is None
    for n in (2, 509, 1021, 70_001):
        a, b = bf.padded_length(n)
        assert a * b >= 2 * n - 1 and a <= b <= 2 * a


def test_transform(spark):
    x = RNG.normal(size=60) + 1j * RNG.normal(size=60)
    rows = [(1, 6, 10, i, float(v.real), float(v.imag)) for i, v in enumerate(x) if i % 7]  # absent samples are 0
    x[::7] = 0
    got = bf.transform(spark.createDataFrame(rows, "key long, n1 long, n2 long, i long, re double, im double")).orderBy("i").collect()
    np.testing.assert_allclose([r["re"] + 1j * r["im"] for r in got], np.fft.fft(x), atol=1e-12)


def test_edges(spark):
    empty = spark.createDataFrame([], "rec long, channel string, sample_idx long, value double")
    assert bf.resample(empty, ["rec", "channel"], 256.0, 128.0).count() == 0
    signals = {(0, "a"): np.arange(100.0), (1, "a"): np.ones(1), (2, "a"): np.ones(90)}
    got = collected(bf.resample(table(spark, signals), ["rec", "channel"], 128.0, 128.0, longest=50))
    assert [v for _, v in got[0, "a"]] == list(range(100)) and len(got[2, "a"]) == 90
    assert (1, "a") not in collected(bf.resample(table(spark, signals), ["rec", "channel"], 256.0, 128.0, longest=50))
