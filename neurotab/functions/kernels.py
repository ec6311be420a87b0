"""Arrow-batched signal kernels.

Each kernel is a ``pandas_udf`` over an ``array<double>`` column (one signal
per row).  Inside a batch, rows of equal length are stacked into one NumPy
matrix so the work is vectorised across signals; Spark partitions and
shuffles the rows, the kernel never sees more than one Arrow batch.
These are used only where a relational form would multiply the data
(FFT, recursive filters, quadratic template matching).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ---------------------------------------------------------------- helpers

# cells of one matrix: a batch of many rows is worked on some rows at a time, so
# that a worker's memory does not grow with the batch
STACK_CELLS = 1 << 18


def _some(places, cells: int):
    """Stretches of ``places`` whose rows have so many cells each."""
    step = max(1, STACK_CELLS // max(1, cells))
    return (places[at:at + step] for at in range(0, len(places), step))


def _by_length(series: pd.Series, fn) -> pd.Series:
    """Apply ``fn(matrix) -> list of 1-D arrays`` to groups of equal-length rows."""
    out = [None] * len(series)
    lengths = np.fromiter((0 if v is None else len(v) for v in series), dtype=np.int64, count=len(series))
    for n in np.unique(lengths):
        idx = np.nonzero(lengths == n)[0]
        if n == 0:
            for i in idx:
                out[i] = None if series.iloc[i] is None else np.zeros(0)
            continue
        for some in _some(idx, int(n)):
            res = fn(np.vstack([np.asarray(series.iloc[i], dtype=np.float64) for i in some]))
            for j, i in enumerate(some):
                out[i] = np.array(res[j])  # not a view that holds the whole matrix
    return pd.Series(out, dtype=object)


def hann_periodic(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)


# ---------------------------------------------------------------- Welch PSD

def welch_matrix(x: np.ndarray, fs: float, nperseg: int) -> np.ndarray:
    """One-sided Welch density for each row of ``x``: periodic Hann window,
    50 % overlap, per-segment mean removal, mean over segments."""
    n = x.shape[1]
    seg = min(nperseg, n)
    step = seg - seg // 2
    nseg = (n - seg) // step + 1
    win = hann_periodic(seg)
    scale = 1.0 / (fs * float(np.sum(win * win)))
    acc = np.zeros((x.shape[0], seg // 2 + 1))
    for s in range(nseg):
        block = x[:, s * step: s * step + seg]
        block = block - block.mean(axis=1, keepdims=True)
        spec = np.fft.rfft(block * win, axis=1)
        acc += spec.real ** 2 + spec.imag ** 2
    psd = acc / nseg * scale
    if seg % 2 == 0:
        psd[:, 1:-1] *= 2.0
    else:
        psd[:, 1:] *= 2.0
    return psd


def welch_udf(fs: float, nperseg: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def welch(values: pd.Series) -> pd.Series:
        return _by_length(values, lambda m: list(welch_matrix(m, fs, nperseg)))
    return welch


# ---------------------------------------------------------------- Fourier resampling

def fourier_resample_matrix(x: np.ndarray, n_out: int) -> np.ndarray:
    """Resample rows to ``n_out`` samples by truncating / zero-padding the spectrum."""
    n = x.shape[1]
    if n_out == n:
        return x.copy()
    spec = np.fft.rfft(x, axis=1)
    new = np.zeros((x.shape[0], n_out // 2 + 1), dtype=complex)
    m = min(n, n_out)
    keep = m // 2 + 1
    new[:, :keep] = spec[:, :keep]
    if m % 2 == 0:
        if n_out < n:      # downsampling: fold the new Nyquist bin
            new[:, m // 2] *= 2.0
        elif n_out > n:    # upsampling: split the old Nyquist bin
            new[:, m // 2] *= 0.5
    return np.fft.irfft(new, n_out, axis=1) * (float(n_out) / n)


def resample_udf(sr_in: float, sr_out: float):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def resample(values: pd.Series) -> pd.Series:
        def fn(m):
            n_out = int(m.shape[1] * sr_out / sr_in)
            return list(fourier_resample_matrix(m, n_out))
        return _by_length(values, fn)
    return resample


# ---------------------------------------------------------------- zero-phase IIR

def lfilter_rows(b: np.ndarray, a: np.ndarray, x: np.ndarray, zi: np.ndarray) -> np.ndarray:
    """Direct-form II transposed recursion applied to every row at once."""
    b = b / a[0]
    a = a / a[0]
    order = max(len(a), len(b)) - 1
    b = np.pad(b, (0, order + 1 - len(b)))
    a = np.pad(a, (0, order + 1 - len(a)))
    z = zi.copy()
    y = np.empty_like(x)
    for t in range(x.shape[1]):
        xt = x[:, t]
        yt = b[0] * xt + z[:, 0]
        for k in range(order - 1):
            z[:, k] = b[k + 1] * xt + z[:, k + 1] - a[k + 1] * yt
        z[:, order - 1] = b[order] * xt - a[order] * yt
        y[:, t] = yt
    return y


def lfilter_zi(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Steady-state initial conditions for a unit step input."""
    b = b / a[0]
    a = a / a[0]
    n = max(len(a), len(b))
    b = np.pad(b, (0, n - len(b)))
    a = np.pad(a, (0, n - len(a)))
    m = n - 1
    comp = np.zeros((m, m))          # companion matrix of a
    comp[0, :] = -a[1:]
    if m > 1:
        comp[1:, :-1] += np.eye(m - 1)
    i_minus_a = np.eye(m) - comp.T
    rhs = b[1:] - a[1:] * b[0]
    return np.linalg.solve(i_minus_a, rhs)


def filtfilt_matrix(b, a, x: np.ndarray) -> np.ndarray:
    """Forward-backward filtering with odd extension of 3*max(len(a), len(b))
    samples and steady-state initial conditions.  Rows too short for the
    extension are returned unchanged."""
    b = np.asarray(b, dtype=np.float64)
    a = np.asarray(a, dtype=np.float64)
    pad = 3 * max(len(a), len(b))
    n = x.shape[1]
    if n <= pad:
        return x.copy()
    left = 2 * x[:, :1] - x[:, pad:0:-1]
    right = 2 * x[:, -1:] - x[:, -2:-pad - 2:-1]
    ext = np.concatenate([left, x, right], axis=1)
    zi = lfilter_zi(b, a)
    y = lfilter_rows(b, a, ext, zi[None, :] * ext[:, :1])
    y = y[:, ::-1]
    y = lfilter_rows(b, a, y, zi[None, :] * y[:, :1])
    y = y[:, ::-1]
    return np.ascontiguousarray(y[:, pad:pad + n])


def cascade(sections, rows: list[np.ndarray], z: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Run second-order sections over rows of any lengths, all rows at once.

    ``z`` holds two states a section and row at the start.  Rows are taken in
    order of falling length, so those not yet at their end are always the first
    ones and a row's states stay as they were at its own end.  Returns the
    filtered rows and the end states."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    y = np.zeros((len(rows), int(lengths.max(initial=0))))
    for place, i in enumerate(order):
        y[place, :lengths[i]] = rows[i]
    state = np.ascontiguousarray(z[order].T)
    active = np.searchsorted(-lengths[order], -np.arange(y.shape[1]), side="left")
    x = np.ascontiguousarray(y.T)
    for t in range(len(x)):
        n = active[t]
        v = x[t, :n]
        for s, (b, a) in enumerate(sections):
            z0, z1 = state[2 * s, :n], state[2 * s + 1, :n]
            w = b[0] * v + z0
            state[2 * s, :n] = b[1] * v + z1 - a[1] * w
            state[2 * s + 1, :n] = b[2] * v - a[2] * w
            v = w
        x[t, :n] = v
    out: list[np.ndarray] = [np.zeros(0)] * len(rows)
    for place, i in enumerate(order):
        out[i] = x[:lengths[i], place].copy()
    end = np.empty_like(z)
    end[order] = state.T
    return out, end


def cascade_zi(sections) -> np.ndarray:
    """States of the sections in the steady state of a unit step."""
    out, gain = [], 1.0
    for b, a in sections:
        out.append(lfilter_zi(b, a) * gain)
        gain *= b.sum() / a.sum()
    return np.concatenate(out)


def padding(sections) -> int:
    """Length of the odd extension: three times the coefficients of the whole filter."""
    return 3 * (2 * len(sections) + 1)


def odd_extension(x: np.ndarray, pad: int, left: bool = True, right: bool = True) -> np.ndarray:
    parts = [2 * x[0] - x[pad:0:-1]] if left else []
    parts.append(x)
    if right:
        parts.append(2 * x[-1] - x[-2:-pad - 2:-1])
    return np.concatenate(parts)


def zero_phase(sections, signals: list[np.ndarray]) -> list[np.ndarray]:
    """Forward and backward filtering of whole signals with odd extension and
    steady-state starts; signals no longer than the extension stay as they are."""
    pad, zi = padding(sections), cascade_zi(sections)
    out = [np.array(x, dtype=np.float64) for x in signals]
    which = [i for i, x in enumerate(out) if len(x) > pad]
    for some in _some(which, max((len(out[i]) + 2 * pad for i in which), default=1)):
        rows = [odd_extension(out[i], pad) for i in some]
        for _ in range(2):  # forward, then backward over the reversed result
            rows, _ = cascade(sections, rows, np.array([zi * r[0] for r in rows]))
            rows = [r[::-1] for r in rows]
        for i, r in zip(some, rows, strict=True):
            out[i] = r[pad:len(r) - pad].copy()
    return out


def zero_phase_udf(sections):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def filtered(values: pd.Series) -> pd.Series:
        there = [i for i, v in enumerate(values) if v is not None]
        done = zero_phase(sections, [np.asarray(values.iloc[i], dtype=np.float64) for i in there])
        out: list[np.ndarray | None] = [None] * len(values)
        for i, r in zip(there, done, strict=True):
            out[i] = r
        return pd.Series(out, dtype=object)
    return filtered


# ---------------------------------------------------------------- template entropies

def template_entropies(x: np.ndarray, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(sample entropy, approximate entropy) of every row of a matrix.

    Template matches are found lag by lag for all rows at once: where samples i
    and i + lag lie within r (0.2 population standard deviations of the row),
    two such places in a row are a match of length 2, three one of length 3.
    Sample entropy counts pairs among the first n - order templates, approximate
    entropy counts matches per template, itself included."""
    rows, n = x.shape
    if n <= order + 1:
        return np.zeros(rows), np.zeros(rows)
    r = 0.2 * np.std(x, axis=1, keepdims=True)
    pairs = np.zeros((2, rows))
    counts = [np.ones((rows, n - order + 1)), np.ones((rows, n - order))]
    for lag in range(1, n - order + 1):
        near = np.abs(x[:, lag:] - x[:, :n - lag]) <= r
        match = near[:, :near.shape[1] - order + 1]
        for k in range(1, order):
            match = match & near[:, k:near.shape[1] - order + 1 + k]
        longer = match[:, :-1] & near[:, order:]
        usable = n - order - lag
        pairs[0] += match[:, :usable].sum(axis=1)
        pairs[1] += longer[:, :usable].sum(axis=1)
        for c, m in zip(counts, (match, longer), strict=True):
            c[:, :m.shape[1]] += m
            c[:, lag:lag + m.shape[1]] += m
    with np.errstate(divide="ignore", invalid="ignore"):
        sample = np.where(pairs[0] == 0, 0.0, np.where(pairs[1] == 0, np.inf, -np.log(pairs[1] / pairs[0])))
    phi = [np.mean(np.log(c / c.shape[1]), axis=1) for c in counts]
    return sample, phi[0] - phi[1]


def sample_entropy_1d(x: np.ndarray, order: int = 2) -> float:
    return float(template_entropies(np.asarray(x, dtype=np.float64)[None, :], order)[0][0])


def approx_entropy_1d(x: np.ndarray, order: int = 2) -> float:
    return float(template_entropies(np.asarray(x, dtype=np.float64)[None, :], order)[1][0])


def _entropy_udf(which: int):
    @F.pandas_udf(T.DoubleType())
    def kernel(values: pd.Series) -> pd.Series:
        out = np.zeros(len(values))
        arrays = [np.asarray(v, dtype=np.float64) if v is not None else np.empty(0) for v in values]
        lengths = np.array([len(v) for v in arrays])
        for n in np.unique(lengths):
            places = np.nonzero(lengths == n)[0]
            for some in _some(places, int(n)):
                out[some] = template_entropies(np.stack([arrays[i] for i in some]))[which]
        return pd.Series(out)
    return kernel


def sample_entropy_udf():
    return _entropy_udf(0)


def approx_entropy_udf():
    return _entropy_udf(1)


# ---------------------------------------------------------------- wavelet

def wavelet_level(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One analysis level of every row: output o is the sum of tap j times sample
    2o + 1 - j of the half-sample symmetric extension."""
    taps = len(low)
    ext = np.pad(x, ((0, 0), (taps - 1, taps - 1)), mode="symmetric")
    n_out = (x.shape[1] + taps - 1) // 2
    parts = [ext[:, taps - j:taps - j + 2 * n_out:2][:, :n_out] for j in range(taps)]
    return (sum(h * p for h, p in zip(low, parts, strict=True)), sum(h * p for h, p in zip(high, parts, strict=True)))


def wavelet_udf(low: list, high: list, level: int):
    """Array of samples -> [approximation, details from the last level to the
    first]; empty where the signal is too short for one level."""
    lo, hi = np.array(low), np.array(high)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def kernel(values: pd.Series) -> pd.Series:
        out = [[] for _ in range(len(values))]
        arrays = [np.asarray(v, dtype=np.float64) if v is not None else np.empty(0) for v in values]
        lengths = np.array([len(v) for v in arrays])
        for n in np.unique(lengths):
            levels = min(level, int(np.floor(np.log2(n / (len(lo) - 1))))) if n >= len(lo) - 1 else 0
            if levels < 1:
                continue
            places = np.nonzero(lengths == n)[0]
            for some in _some(places, int(n)):
                cur, bands = np.stack([arrays[i] for i in some]), []
                for _ in range(levels):
                    cur, detail = wavelet_level(cur, lo, hi)
                    bands.insert(0, detail)
                bands.insert(0, cur)
                for k, i in enumerate(some):
                    out[i] = [b[k] for b in bands]
        return pd.Series(out)
    return kernel


# ---------------------------------------------------------------- chi-square tail

def chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi-square with k degrees of freedom (closed forms)."""
    import math
    if x <= 0:
        return 1.0
    if k % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= (x / 2) / i
            total += term
        return math.exp(-x / 2) * total
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, (k - 1) // 2 + 1):
        total += term
        term *= x / (2 * i + 1)
    return total


def chi2_sf_udf():
    @F.pandas_udf(T.DoubleType())
    def sf(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_sf(float(a), int(b)) for a, b in zip(x, df)])
    return sf
