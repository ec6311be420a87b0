"""Fourier resampling of signals of any length.

A transform of length N = n1 x n2 is done in two exchanges: the samples at every
n2-th place form a column and are transformed (length n1), turned by the twiddle
factor of their place, and the results of one frequency over all columns form a
row and are transformed (length n2).  No array is longer than n1 or n2, about
the square root of the signal.

A length with a large prime factor has no such split.  Its transform is written
as a convolution with a chirp (Bluestein), which can be padded to a power of two;
the chirp of a length is transformed once, whatever number of signals has it.

Signals short enough for an array (``longest``) go through the array kernel.

Defined results: a signal of n samples gets int(n * sr_out / sr_in); as many as
before leave it as it is, and none leave no rows.  Positions of a signal run
from 0 without gaps; rows with a null value, position or key take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurotab.functions.kernels import resample_udf
from neurotab.session import cut_lineage

LONGEST = 1 << 16
PARTS = T.StructType([T.StructField(name, T.ArrayType(T.DoubleType())) for name in ("re", "im")])


def split_length(n: int, longest: int) -> tuple[int, int] | None:
    """Factors of n nearest to its square root, if both are at most ``longest``."""
    d = next(k for k in range(int(n ** 0.5), 0, -1) if n % k == 0)
    return (d, n // d) if n // d <= longest else None


def padded_length(n: int) -> tuple[int, int]:
    """Factors of the power of two that holds the convolution of two n's."""
    bits = (2 * n - 2).bit_length()
    return 1 << bits // 2, 1 << (bits - bits // 2)


def _dense(at: pd.Series, re: pd.Series, im: pd.Series, length: pd.Series):
    for p, x, y, n in zip(at, re, im, length, strict=True):
        out = np.zeros(int(n), complex)
        out[np.asarray(p, np.int64)] = np.asarray(x) + 1j * np.asarray(y)
        yield out


def _parts(rows: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"re": [r.real.copy() for r in rows], "im": [r.imag.copy() for r in rows]})


@F.pandas_udf(PARTS)
def _column_transform(at: pd.Series, re: pd.Series, im: pd.Series, n1: pd.Series, n2: pd.Series, place: pd.Series) -> pd.DataFrame:
    """Transform of a column and the twiddle factors of its place."""
    rows = []
    for x, a, b, i in zip(_dense(at, re, im, n1), n1, n2, place, strict=True):
        size = int(a) * int(b)
        rows.append(np.fft.fft(x) * np.exp(-2j * np.pi * (int(i) * np.arange(int(a)) % size) / size))
    return _parts(rows)


@F.pandas_udf(PARTS)
def _row_transform(at: pd.Series, re: pd.Series, im: pd.Series, n2: pd.Series) -> pd.DataFrame:
    return _parts([np.fft.fft(x) for x in _dense(at, re, im, n2)])


def transform(df: DataFrame) -> DataFrame:
    """Discrete Fourier transform of (key, n1, n2, i, re, im), signals of n1 x n2
    samples (absent ones are 0): the same columns, i the frequency."""
    def gathered(rows: DataFrame, group: Column, place: Column) -> DataFrame:
        return rows.groupBy("key", "n1", "n2", group.alias("g")).agg(F.collect_list(F.struct(place.alias("p"), "re", "im")).alias("s")) \
            .select("key", "n1", "n2", "g", F.col("s.p").alias("p"), F.col("s.re").alias("re"), F.col("s.im").alias("im"))

    def spread(rows: DataFrame, out: Column) -> DataFrame:
        pairs = F.arrays_zip("t.re", "t.im")
        return rows.select("key", "n1", "n2", "g", F.posexplode(pairs).alias("k", "v")) \
            .select("key", "n1", "n2", out.alias("i"), "g", F.col("v.re").alias("re"), F.col("v.im").alias("im"))

    columns = gathered(df, F.pmod("i", "n2"), F.floor(F.col("i") / F.col("n2")).cast("long"))
    turned = spread(columns.withColumn("t", _column_transform("p", "re", "im", "n1", "n2", "g")), F.col("k").cast("long"))
    rows = gathered(turned, F.col("i"), F.col("g").cast("long"))
    return spread(rows.withColumn("t", _row_transform("p", "re", "im", "n2")), F.col("g") + F.col("n1") * F.col("k")).drop("g")


def _times(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def _chirp(j: Column, n: Column) -> tuple[Column, Column]:
    """exp(-pi i j^2 / n); the square is taken modulo 2n in whole numbers."""
    angle = F.pmod(j * j, 2 * n) * F.lit(np.pi) / n
    return F.cos(angle), -F.sin(angle)


def spectra(df: DataFrame, lengths: DataFrame, longest: int) -> DataFrame:
    """(key, i, re, im) transforms of (key, i, re, im) signals; ``lengths`` has
    (key, n) of each."""
    @F.pandas_udf("n1 long, n2 long, whole boolean")
    def factors(n: pd.Series) -> pd.DataFrame:
        found = [split_length(int(v), longest) for v in n]
        return pd.DataFrame([(*(f or padded_length(int(v))), f is not None) for f, v in zip(found, n, strict=True)], columns=["n1", "n2", "whole"])

    planned = lengths.select("key", "n", factors("n").alias("f")).select("key", "n", "f.n1", "f.n2", "f.whole")
    rows = df.join(planned, "key")
    direct = transform(rows.where("whole").select("key", "n1", "n2", "i", "re", "im")).select("key", "i", "re", "im")

    odd = cut_lineage(planned.where(~F.col("whole")))
    if odd.isEmpty():
        return direct
    here, pair, n = (F.col("re"), F.col("im")), lambda c: (c[0].alias("re"), c[1].alias("im")), F.col("n")
    signal = rows.where(~F.col("whole")).select(F.struct(F.lit(True).alias("own"), "key", "n").alias("key"), "n1", "n2", "i", *pair(_times(here, _chirp(F.col("i"), n))))
    empty = F.lit(None).cast(df.schema["key"].dataType).alias("key")
    wave = odd.select("n", "n1", "n2").distinct().select("n", "n1", "n2", F.explode(F.sequence(1 - n, n - 1)).alias("j"))
    back = _chirp(F.col("j"), n)
    wave = wave.select(F.struct(F.lit(False).alias("own"), empty, "n").alias("key"), "n1", "n2", F.pmod("j", F.col("n1") * F.col("n2")).alias("i"), *pair((back[0], -back[1])))
    both = cut_lineage(transform(signal.unionByName(wave)))
    a = both.where("key.own").select("key", "key.n", "n1", "n2", "i", "re", "im")
    b = both.where(~F.col("key.own")).select(F.col("key.n").alias("n"), "i", F.col("re").alias("bre"), F.col("im").alias("bim"))
    product = _times(here, (F.col("bre"), F.col("bim")))
    convolved = transform(a.join(b, ["n", "i"]).select("key", "n1", "n2", "i", *pair((product[0], -product[1]))))
    size, n = F.col("n1") * F.col("n2"), F.col("key.n")  # inverse: conjugate, transform, conjugate, divide
    out = _times((F.col("re") / size, -F.col("im") / size), _chirp(F.col("i"), n))
    return direct.unionByName(convolved.where(F.col("i") < n).select(F.col("key.key").alias("key"), "i", *pair(out)))


def resample(df: DataFrame, sig_keys: Sequence[str], sr_in: float, sr_out: float, idx: str = "sample_idx", value: str = "value",
             longest: int = LONGEST) -> DataFrame:
    """Long layout (sig_keys..., idx, value): every signal resampled to
    int(n * sr_out / sr_in) samples by truncating or padding its spectrum."""
    keys = list(sig_keys)
    rows = df.where(F.col(value).isNotNull() & F.col(idx).isNotNull()).select(
        F.struct(*keys).alias("key"), F.col(idx).cast("long").alias("i"), F.col(value).cast("double").alias("v"))
    counts = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.floor(F.col("n") * sr_out / sr_in).cast("long")))
    named = lambda d: d.select(*[F.col(f"key.{k}").alias(k) for k in keys], F.col("i").cast("long").alias(idx), F.col("v").alias(value))
    short = (F.col("n") <= longest) & (F.col("m") <= longest)
    few = rows.join(counts.where(short & (F.col("m") > 0)), "key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")) \
        .select("key", F.posexplode(resample_udf(float(sr_in), float(sr_out))(F.col("s.v"))).alias("i", "v"))
    many = cut_lineage(counts.where(~short & (F.col("m") > 0)))
    same = rows.join(many.where("n = m").select("key"), "key").select("key", "i", "v")
    changed = many.where("n != m")
    if changed.isEmpty():
        return named(few).unionByName(named(same))

    # the half spectrum up to the smaller of both Nyquist frequencies, and its mirror
    found = spectra(rows.join(changed.select("key"), "key").select("key", "i", F.col("v").alias("re"), F.lit(0.0).alias("im")), changed, longest)
    kept = found.join(changed, "key").withColumn("w", F.least("n", "m")).where(F.col("i") * 2 <= F.col("w"))
    top = F.col("i") * 2 == F.col("w")
    re, im = F.col("re"), F.col("im")
    # downwards both ends of the new Nyquist frequency fall together; upwards the old one is shared out
    at = lambda k, x, y: F.struct(k.cast("long").alias("i"), x.alias("re"), (-y).alias("im"))  # noqa: E731  (conjugated for the inverse)
    mirror = F.col("m") - F.col("i")
    places = F.when(top & (F.col("m") < F.col("n")), F.array(at(F.col("i"), 2 * re, F.lit(0.0)))) \
        .when(top, F.array(at(F.col("i"), re / 2, im / 2), at(mirror, re / 2, -im / 2))) \
        .when(F.col("i") == 0, F.array(at(F.col("i"), re, F.lit(0.0)))) \
        .otherwise(F.array(at(F.col("i"), re, im), at(mirror, re, -im)))
    spectrum = cut_lineage(kept.select("key", F.explode(places).alias("y")).select("key", "y.i", "y.re", "y.im"))
    wave = spectra(spectrum, changed.select("key", F.col("m").alias("n")), longest)
    out = wave.join(changed, "key").select("key", "i", (F.col("re") / F.col("n")).alias("v"))
    return named(few).unionByName(named(same)).unionByName(named(out))
