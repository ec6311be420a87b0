"""IIR filter design (driver side, a handful of coefficients).

Coefficients are computed once with NumPy and shipped inside the kernel
closure; the per-signal recursion runs in ``kernels.cascade``.
"""

from __future__ import annotations

import numpy as np


Section = tuple[np.ndarray, np.ndarray]


def bandpass_sections(low_hz: float, high_hz: float, fs: float, order: int) -> list[Section]:
    """Digital Butterworth band-pass as a cascade of second-order sections
    (numerator, denominator); band edges are kept within 0.001 and 0.999 of the
    Nyquist frequency.

    The low-pass prototype of cutoff 1 is the product of 1 / (s - p) over the
    left half of the unit circle.  Low-pass to band-pass and the bilinear
    transform together are one substitution,
        s = c (z^2 - 2 m z + 1) / (z^2 - 1),
    with c = cot(half the band) and m = cos(middle) / cos(half the band), so each
    pole gives (z^2 - 1) / ((c - p) z^2 - 2 m c z + (c + p)).  For a real pole
    that is a section; the two roots of a complex pole each pair with the
    matching root of the conjugate pole to a section of their own.

    A cascade has states of the size of the signal, so they can be handed from
    block to block; the states of one long recursion are far larger than the
    signal and cancel each other."""
    low, high = (np.pi * np.clip(f / (fs / 2.0), 0.001, 0.999) for f in (low_hz, high_hz))
    half = (high - low) / 2.0
    c, m = 1.0 / np.tan(half), np.cos((low + high) / 2.0) / np.cos(half)
    zeros, out = np.array([1.0, 0.0, -1.0]), []
    for k in range((order + 1) // 2):
        p = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
        quadratic = np.array([c - p, -2.0 * m * c, c + p])
        if 2 * k + 1 == order:  # the real pole of an odd order
            out.append((zeros / quadratic[0].real, quadratic.real / quadratic[0].real))
        else:
            out += [(zeros / abs(quadratic[0]), np.array([1.0, -2.0 * r.real, abs(r) ** 2])) for r in np.roots(quadratic)]
    return out


def coefficients(sections: list[Section]) -> Section:
    """Numerator and denominator of a whole cascade."""
    b, a = np.ones(1), np.ones(1)
    for sb, sa in sections:
        b, a = np.convolve(b, sb), np.convolve(a, sa)
    return b, a


def bandpass_coefficients(low_hz: float, high_hz: float, fs: float, order: int) -> Section:
    return coefficients(bandpass_sections(low_hz, high_hz, fs, order))


def notch(freq: float, q: float, fs: float) -> Section:
    """Second-order notch at ``freq`` Hz with quality factor ``q``: the mean of
    the signal and a second-order all-pass that turns its phase by half a turn
    at the notch.  The all-pass has lattice coefficients -cos(w) and
    (1 - t) / (1 + t), t the tangent of half the bandwidth w / q."""
    w = 2.0 * np.pi * freq / fs
    t = np.tan(w / q / 2.0)
    k1, k2 = -np.cos(w), (1.0 - t) / (1.0 + t)
    allpass = np.array([k2, k1 * (1.0 + k2), 1.0])
    return (allpass + allpass[::-1]) / 2.0, allpass[::-1].copy()
