"""NumPy-level checks of the Arrow kernels and filter design (no Spark)."""

import math

import numpy as np
import pytest

from neurotab.functions import iir
from neurotab.functions import kernels as k

FS = 128.0
T = np.arange(512) / FS


def _welch_direct(x, fs, nperseg):
    seg = min(nperseg, len(x))
    step = seg - seg // 2
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg)
    out = []
    for s in range(0, len(x) - seg + 1, step):
        b = x[s:s + seg] - x[s:s + seg].mean()
        out.append(np.abs(np.fft.rfft(b * w)) ** 2)
    p = np.mean(out, axis=0) / (fs * np.sum(w * w))
    p[1:-1 if seg % 2 == 0 else None] *= 2
    return p


def test_welch_matches_direct_formula():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 512))
    got = k.welch_matrix(x, FS, 256)
    for i in range(3):
        np.testing.assert_allclose(got[i], _welch_direct(x[i], FS, 256), rtol=1e-12)


def test_welch_sine_power_in_alpha():
    psd = k.welch_matrix(np.sin(2 * np.pi * 10 * T)[None, :], FS, 256)[0]
    freqs = np.arange(len(psd)) * FS / 256
    alpha = psd[(freqs >= 8) & (freqs <= 13)].sum()
    assert alpha / psd.sum() > 0.99


def test_bandpass_design_gain():
    b, a = iir.bandpass_coefficients(0.5, 45.0, FS, 5)
    w = np.exp(-1j * np.pi * np.array([0.0, 10 / 64, 1.0]))
    h = np.polyval(b[::-1], w) / np.polyval(a[::-1], w)
    assert abs(h[0]) < 1e-8 and abs(h[2]) < 1e-8
    assert abs(abs(h[1]) - 1) < 1e-3


def test_filtfilt_passes_10hz_removes_50hz():
    # 32 s: the 0.5 Hz edge has a transient of several seconds, so judge the interior
    t = np.arange(4096) / FS
    inner = slice(1000, -1000)
    b, a = iir.bandpass_coefficients(0.5, 45.0, FS, 5)
    s10 = np.sin(2 * np.pi * 10 * t)[None, :]
    s50 = np.sin(2 * np.pi * 50 * t)[None, :]
    assert np.max(np.abs(k.filtfilt_matrix(b, a, s10)[0, inner] - s10[0, inner])) < 1e-3
    assert np.max(np.abs(k.filtfilt_matrix(b, a, s50)[0, inner])) < 0.05
    nb, na = iir.notch(50.0, 30.0, FS)
    assert np.max(np.abs(k.filtfilt_matrix(nb, na, s50)[0, inner])) < 0.05
    assert np.max(np.abs(k.filtfilt_matrix(nb, na, s10)[0, inner] - s10[0, inner])) < 1e-3


def test_filtfilt_short_signal_passes_through():
    b, a = iir.bandpass_coefficients(0.5, 45.0, FS, 5)
    x = np.arange(20.0)[None, :]
    np.testing.assert_array_equal(k.filtfilt_matrix(b, a, x), x)


def test_lfilter_zi_is_steady_state():
    b, a = iir.notch(50.0, 30.0, FS)
    zi = k.lfilter_zi(b, a)
    y = k.lfilter_rows(b, a, np.ones((1, 50)), zi[None, :])
    np.testing.assert_allclose(y, np.full((1, 50), np.polyval(b[::-1], 1) / np.polyval(a[::-1], 1)), atol=1e-12)


def test_resample_keeps_a_low_tone():
    x = np.cos(2 * np.pi * 4 * np.arange(64) / 64)[None, :]
    y = k.fourier_resample_matrix(x, 32)[0]
    np.testing.assert_allclose(y, np.cos(2 * np.pi * 4 * np.arange(32) / 32), atol=1e-12)


def _brute_sampen(x, r):
    n = len(x)
    nt = n - 2
    b = a = 0
    for i in range(nt):
        for j in range(i + 1, nt):
            if max(abs(x[i] - x[j]), abs(x[i + 1] - x[j + 1])) <= r:
                b += 1
                if abs(x[i + 2] - x[j + 2]) <= r:
                    a += 1
    return -math.log(a / b)


def _brute_apen(x, r):
    n = len(x)

    def phi(m):
        t = [x[i:i + m] for i in range(n - m + 1)]
        c = [sum(max(abs(p - q) for p, q in zip(u, v)) <= r for v in t) for u in t]
        return np.mean(np.log(np.array(c) / len(t)))
    return phi(2) - phi(3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_template_entropies_match_brute_force(seed):
    x = np.random.default_rng(seed).normal(size=80)
    r = 0.2 * np.std(x)
    assert k.sample_entropy_1d(x) == pytest.approx(_brute_sampen(x, r), rel=1e-12)
    assert k.approx_entropy_1d(x) == pytest.approx(_brute_apen(x, r), rel=1e-12)


def test_chi2_tail_closed_forms():
    assert k.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert k.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert k.chi2_sf(0.0, 3) == 1.0


def test_cascade_equals_the_whole_filter():
    """Sections and the product form agree as far as the product form is exact."""
    rng = np.random.default_rng(4)
    sections = iir.bandpass_sections(0.5, 45.0, FS, 5)
    b, a = iir.coefficients(sections)
    signals = [rng.normal(size=n) for n in (20, 300, 257, 1000, 34, 35, 300)]
    for x, y in zip(signals, k.zero_phase(sections, signals)):
        np.testing.assert_allclose(y, k.filtfilt_matrix(b, a, x[None, :])[0], rtol=1e-6, atol=1e-8)
    for order in (1, 2, 3, 4, 5):
        parts = iir.bandpass_sections(1.0, 30.0, FS, order)
        assert len(parts) == order and all(np.abs(np.roots(p[1])).max() < 1 for p in parts)


def test_cascade_states():
    sections = [*iir.bandpass_sections(0.5, 45.0, FS, 5), iir.notch(50.0, 30.0, FS)]
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=200), rng.normal(size=(1, 12))
    whole, end = k.cascade(sections, [x], z)
    first, middle = k.cascade(sections, [x[:70]], z)
    second, last = k.cascade(sections, [x[70:]], middle)
    np.testing.assert_array_equal(np.concatenate([first[0], second[0]]), whole[0])
    np.testing.assert_array_equal(last, end)
    # a steady input stays steady
    steady, _ = k.cascade(sections, [np.ones(50)], k.cascade_zi(sections)[None])
    np.testing.assert_allclose(steady[0], np.full(50, steady[0][0]), atol=1e-12)


# FIXED VALUES of the filters: band-pass 0.5 to 45 Hz of order 5 and notch at 50 Hz with Q = 30, for 128 Hz, from a pole-zero
# design (analog poles, frequency warping, bilinear transform) that is not the one in functions/iir.py
BANDPASS_B = [
    0.19639140494838692, 0.0, -0.9819570247419346, 0.0,
    1.9639140494838692, 0.0, -1.9639140494838692, 0.0,
    0.9819570247419346, 0.0, -0.19639140494838692,
]
BANDPASS_A = [
    1.0, -2.9245406634082336, 1.9087780909036647, 0.8624070489898426,
    0.2706412526243287, -1.769609419795776, 0.07433319487132584, 0.5939779878320594,
    0.13620496440861732, -0.1136773326974559, -0.03851506598041766,
]
NOTCH_B = [
    0.9606803283865873, 1.485231872365558, 0.9606803283865873,
]
NOTCH_A = [
    1.0, 1.485231872365558, 0.9213606567731747,
]


def test_filter_design_equals_an_independent_one():
    for got, want in ((iir.bandpass_coefficients(0.5, 45.0, 128.0, 5), (BANDPASS_B, BANDPASS_A)), (iir.notch(50.0, 30.0, 128.0), (NOTCH_B, NOTCH_A))):
        for x, y in zip(got, want):
            np.testing.assert_allclose(x, y, rtol=0, atol=1e-12)
