"""Live epochs equal the whole signal's, over any split and a restart."""

import numpy as np
import pandas as pd
import pytest

from neurotab.functions import kernels as kn
from neurotab.operators.preprocess import cleaning_filters
from neurotab.streaming import live

BAND, NOTCH = cleaning_filters(128.0)
RNG = np.random.default_rng(3)


def whole(x, size):
    y = kn.cascade(BAND, [x], (kn.cascade_zi(BAND) * x[0])[None])[0][0]
    return [y[k:k + size].tolist() for k in range(0, len(y) - size + 1, size)]


@pytest.mark.parametrize("cuts", [[], [1], [5, 6, 70], list(range(1, 200, 3))])
def test_any_split_gives_the_same_epochs(cuts):
    x = 20 + np.cumsum(RNG.normal(size=200))
    state, told = None, []
    for a, b in zip([0, *cuts], [*cuts, 200]):
        signal = live.Signal(BAND, 32, state)
        told += signal.take([(i, x[i]) for i in range(a, b)])
        state = signal.state()
    assert [e for e, _, w in told if w] == list(range(6))
    np.testing.assert_array_equal([v for _, v, _ in told], whole(x, 32))
    left = list(live.Signal(BAND, 32, state).end())
    assert [(e, w, len(v), v[8:]) for e, v, w in left] == [(6, False, 32, [0.0] * 24)]


def test_out_of_order_repeats_and_gaps():
    x = RNG.normal(size=96)
    signal, told = live.Signal(BAND, 32), []
    for part in (range(40, 80), range(0, 20), range(10, 50), range(80, 96)):
        told += signal.take([(i, x[i]) for i in part])
    np.testing.assert_array_equal([v for _, v, _ in told], whole(x, 32))
    gap = live.Signal([], 4)
    assert list(gap.take([(0, 1.0), (1, None), (3, 5.0), (4, 6.0)])) == []
    assert list(gap.end()) == [(0, [1.0, 1.0, 5.0, 6.0], True)]


class State:
    """What Spark hands over, for one signal."""

    def __init__(self):
        self.value, self.hasTimedOut = None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, v):
        self.value = v

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.ms = ms


def test_timeout_tells_the_unfinished_epoch():
    run, state = live.epoch_maker(["r"], [], 4, 500), State()
    frame = pd.DataFrame({"sample_idx": [1, 0, 2], "value": [2.0, 1.0, 3.0]})
    assert list(run((7,), iter([frame]), state)) == [] and state.ms == 500
    state.hasTimedOut = True
    out, = run((7,), iter([]), state)
    assert out.values.tolist() == [[7, 0, False, [1.0, 2.0, 3.0, 0.0]]] and state.value is None


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    signals = {k: np.cumsum(RNG.normal(size=100 + 30 * k)) for k in range(3)}
    schema = "rec long, channel string, sample_idx long, value double"

    def arrive(name, lo, hi):
        rows = [(k, "F3", i, float(x[i])) for k, x in signals.items() for i in range(int(len(x) * lo), int(len(x) * hi))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    for lo, hi in ((0, 0.3), (0.3, 0.55), (0.55, 1)):  # each one a query of its own on the same checkpoint
        arrive("in", lo, hi)
        q = live.start_live(spark, str(tmp_path / "in"), schema, str(tmp_path / "ck"), str(tmp_path / "out"), ["rec", "channel"], BAND, 32)
        q.awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("rec", "epoch_id").collect():
        assert r["whole"] and r["epoch_id"] == len(got.setdefault(r["rec"], []))
        got[r["rec"]].append(r["values"])
    for k, x in signals.items():
        np.testing.assert_array_equal(got[k], whole(x, 32))


def test_a_bucket_of_signals_tells_what_each_does():
    """All signals of a bucket together, with repeats, missing values, gaps and a
    restart, as ``Signal`` one by one; and in one filter pass a batch."""
    for size, sections in ((4, BAND), (3, [])):
        alone, state, want, got = {}, None, [], []
        for _ in range(6):
            n = int(RNG.integers(0, 500))
            names, idx, values = np.array([f"s{k}" for k in RNG.integers(0, 7, n)], object), RNG.integers(0, 30, n), RNG.normal(size=n)
            values[RNG.random(n) < 0.1] = np.nan
            for s in sorted(set(names)):
                rows = sorted(zip(idx[names == s].tolist(), values[names == s].tolist()), key=lambda r: (r[0], np.isnan(r[1]), r[1]))
                signal = live.Signal(sections, size, alone.get(s))
                want += [(s, e, v) for e, v, _ in signal.take((i, None if np.isnan(v) else v) for i, v in rows)]
                alone[s] = signal.state()
            bucket = live.Bucket(sections, size, state)
            got += [(bucket.names[k], int(e), v.tolist()) for k, e, v in zip(*bucket.take(names, idx, values))]
            state = bucket.state()
        assert sorted(got) == sorted(want) and len(got) > 20


def test_calls_do_not_grow_with_the_signals(spark, tmp_path):
    """Signals share states; keys of any kind come back, null included."""
    rows = [(k if k else None, "a\"b", i, float(i * k)) for k in range(60) for i in range(8)]
    schema = "rec long, `the channel` string, sample_idx long, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = live.live_epochs(stream, ["rec", "the channel"], [], 4, buckets=3)
    q = out.writeStream.format("memory").queryName("few_states").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(p.stateOperators[0].numRowsUpdated for p in q.recentProgress) <= 3
    got = {(r["rec"], r["epoch_id"]): r["values"] for r in spark.table("few_states").collect()}
    assert got == {(k or None, e): [float(i * k) for i in range(4 * e, 4 * e + 4)] for k in range(60) for e in range(2)}
