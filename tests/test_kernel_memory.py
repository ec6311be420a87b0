"""Signal kernels hold some rows of a batch at a time, with the same results."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from neurotab import config
from neurotab.functions import kernels as kn
from neurotab.operators.preprocess import cleaning_filters

BAND, _ = cleaning_filters(128.0)
KERNELS = {
    "filter": lambda v: kn.zero_phase(BAND, list(v)),
    "welch": lambda v: list(kn.welch_udf(128.0, 32).func(v)),
    "entropy": lambda v: list(kn.sample_entropy_udf().func(v)),
    "wavelet": lambda v: [np.concatenate(w) if len(w) else np.zeros(0) for w in kn.wavelet_udf(config.DB4_LOW, config.DB4_HIGH, 3).func(v)],
}


@pytest.mark.parametrize("name", KERNELS)
def test_rows_in_stretches_are_the_same(name, monkeypatch):
    rng = np.random.default_rng(8)
    values = pd.Series([rng.normal(size=n) for n in rng.choice([3, 50, 64, 90], 60)])
    whole = KERNELS[name](values)
    monkeypatch.setattr(kn, "STACK_CELLS", 200)
    for a, b in zip(whole, KERNELS[name](values), strict=True):
        np.testing.assert_array_equal(a, b)


def test_working_memory_of_the_filter_is_bounded():
    """Beside the rows that come in and go out, at most a few matrices."""
    rng = np.random.default_rng(9)
    rows = [rng.normal(size=64) for _ in range(10_000)]
    tracemalloc.start()
    out = kn.zero_phase(BAND, rows)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(out) == 10_000 and peak - held < 12 * 8 * kn.STACK_CELLS
