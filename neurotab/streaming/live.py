"""Live samples to filtered epochs, with state carried from batch to batch.

Each (recording, channel) keeps what its next sample needs: the number of the
next sample, the states of the filter's sections, the samples of the epoch that
is not full yet, and samples that came before their turn.  However the samples
are split over micro-batches, and in whatever order a batch holds them, the
epochs are those of the whole signal filtered once (forward only: what lies
ahead is not known yet).  State survives a restart through the checkpoint.

Defined results: the filter starts in the steady state of the first sample; a
sample seen already (a repeat of an earlier number) is left out; a null value
repeats the one before it; an epoch is told when its last sample has come.  When
nothing has come for ``timeout_ms`` (if it is set), samples behind a gap are taken as if the
gap were not there, and an unfinished epoch is told filled up with zeros, with
``whole`` false; the recording is then forgotten.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from neurotab.functions import kernels as kn

STATE = "next long, epoch long, started boolean, filter array<double>, held array<double>, early array<struct<i:long,v:double>>"
BUCKETS = 512
TOLD_AT_ONCE = 10_000


class Signal:
    """One channel's state, and what it tells."""

    def __init__(self, sections, size: int, state: tuple | None = None) -> None:
        self.sections, self.size = sections, size
        self.next, self.epoch, self.started, z, held, early = state or (0, 0, False, None, [], [])
        self.z = np.zeros(2 * len(sections)) if z is None else np.asarray(z, float)
        self.held = [float(v) for v in held]
        self.early = {int(e[0]): e[1] for e in early}

    def state(self) -> tuple:
        return (self.next, self.epoch, self.started, self.z.tolist(), self.held, sorted(self.early.items()))

    def _filtered(self, values: list[float]) -> None:
        if not values:
            return
        if not self.started:
            self.z, self.started = kn.cascade_zi(self.sections) * values[0] if self.sections else self.z, True
        if self.sections:
            (out,), end = kn.cascade(self.sections, [np.array(values)], self.z[None])
            self.z = end[0]
            values = out.tolist()
        self.held += values

    def take(self, rows: Iterable[tuple[int, float]]) -> Iterator[tuple[int, list[float], bool]]:
        """(epoch, values, whole) of the epochs that these samples complete."""
        for i, v in rows:
            if i >= self.next and i not in self.early:
                self.early[int(i)] = v
        ready: list[float] = []
        while self.next in self.early:
            v = self.early.pop(self.next)
            if v is None or np.isnan(v):  # the last value stands for a missing one
                v = ready[-1] if ready else self.last if self.started else 0.0
            ready.append(float(v))
            self.next += 1
        self._filtered(ready)
        while len(self.held) >= self.size:
            yield self.epoch, self.held[:self.size], True
            self.held, self.epoch = self.held[self.size:], self.epoch + 1

    @property
    def last(self) -> float:
        return self.held[-1] if self.held else 0.0

    def end(self) -> Iterator[tuple[int, list[float], bool]]:
        """What is left when nothing more comes."""
        rest = [v for _, v in sorted(self.early.items()) if v is not None and not np.isnan(v)]
        self.early = {}
        self._filtered(rest)
        while self.held:
            part, self.held = self.held[:self.size], self.held[self.size:]
            yield self.epoch, part + [0.0] * (self.size - len(part)), len(part) == self.size
            self.epoch += 1


def epoch_maker(keys: Sequence[str], sections, size: int, timeout_ms: int | None = None, idx: str = "sample_idx", value: str = "value"):
    """The function that Spark calls with a signal's new rows and its state."""
    names = [*keys, "epoch_id", "whole", "values"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        signal = Signal(sections, size, state.get if state.exists else None)
        if state.hasTimedOut:
            told = list(signal.end())
            state.remove()
        else:
            rows = sorted((int(i), None if pd.isna(v) else float(v)) for f in frames for i, v in zip(f[idx], f[value], strict=True) if not pd.isna(i))
            told = list(signal.take(rows))
            state.update(signal.state())
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        if told:
            yield pd.DataFrame([(*key, e, whole, values) for e, values, whole in told], columns=names)
    return run


def grouped(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n codes starts in sorted ``codes``, and their end."""
    return np.searchsorted(codes, np.arange(n + 1))


class Bucket:
    """The states of many signals, named by texts, and what new samples of any of
    them tell: ``Signal`` for all at once, in arrays.  Samples that wait (``own``,
    ``at``, ``value``; a missing value is NaN) and those of unfinished epochs
    (``held``, ``lens``) stand in the order of the signals."""

    def __init__(self, sections, size: int, state: bytes | None = None) -> None:
        self.sections, self.size = sections, size
        empty = [], *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, bool), np.zeros((0, 2 * len(sections))), np.zeros(0, np.int64), \
            np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.names, self.next, self.epoch, self.started, self.z, self.lens, self.held, self.own, self.at, self.value = pickle.loads(state) if state else empty

    def state(self) -> bytes:
        return pickle.dumps((self.names, self.next, self.epoch, self.started, self.z, self.lens, self.held, self.own, self.at, self.value), 5)

    def _codes(self, names: np.ndarray) -> np.ndarray:
        codes, known = pd.factorize(pd.Index(np.concatenate([np.array(self.names, object), names])))
        new = len(known) - len(self.names)
        self.names = list(known)
        wider = lambda a: np.concatenate([a, np.zeros((new, *a.shape[1:]), a.dtype)])
        self.next, self.epoch, self.started, self.z, self.lens = map(wider, (self.next, self.epoch, self.started, self.z, self.lens))
        return codes[len(self.names) - new:]

    def take(self, names: np.ndarray, idx: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signal number, epoch, values) of the epochs that these samples complete."""
        codes = self._codes(names)
        n = len(self.names)
        own, at, value = np.r_[self.own, codes], np.r_[self.at, idx], np.r_[self.value, values]
        late = np.r_[np.zeros(len(self.own), bool), np.ones(len(codes), bool)]
        order = np.lexsort((value, late, at, own))  # of repeats the one that waits, else the least, is taken
        own, at, value = own[order], at[order], value[order]
        keep = at >= self.next[own]
        keep[1:] &= (own[1:] != own[:-1]) | (at[1:] != at[:-1])
        own, at, value = own[keep], at[keep], value[keep]
        place = np.arange(len(own)) - grouped(own, n)[own]
        ready = at - place == self.next[own]  # the run without a gap
        self.own, self.at, self.value = own[~ready], at[~ready], value[~ready]
        own, value, first = own[ready], value[ready], place[ready] == 0
        edges = grouped(own, n)
        count = np.diff(edges)
        self.next = self.next + count
        ends = np.cumsum(self.lens)
        last = np.where(self.started & (self.lens > 0), np.r_[0.0, self.held][np.where(self.lens > 0, ends, 0)], 0.0)
        value = np.where(first & np.isnan(value), last[own], value)  # the last value stands for a missing one
        value = value[np.maximum.accumulate(np.where(np.isnan(value), 0, np.arange(len(value))))] if len(value) else value
        live = np.nonzero(count)[0]
        if self.sections and len(live):
            begin = live[~self.started[live]]
            self.z[begin] = kn.cascade_zi(self.sections) * value[edges[begin]][:, None]
            out, self.z[live] = kn.cascade(self.sections, [value[edges[k]:edges[k + 1]] for k in live], self.z[live])
            value = np.concatenate(out)
        self.started[live] = True
        # behind what was held, in the order of the signals
        where = np.argsort(np.r_[np.repeat(np.arange(n), self.lens), own], kind="stable")
        held, lens = np.r_[self.held, value][where], self.lens + count
        full = lens // self.size
        inside = np.arange(len(held)) - np.repeat(np.cumsum(lens) - lens, lens) < np.repeat(full * self.size, lens)
        told = np.repeat(np.arange(n), full)
        epoch = self.epoch[told] + np.arange(len(told)) - np.repeat(np.cumsum(full) - full, full)
        self.held, self.lens, self.epoch = held[~inside], lens - full * self.size, self.epoch + full
        return told, epoch, held[inside].reshape(-1, self.size)


def bucket_maker(sections, size: int, idx: str = "sample_idx", value: str = "value"):
    """The function that Spark calls with the new rows of a bucket's signals and their states."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = Bucket(sections, size, state.get[0] if state.exists else None)
        rows = pd.concat(list(frames))
        rows = rows[rows[idx].notna()]
        told, epochs, values = bucket.take(rows["_name"].to_numpy(object), rows[idx].to_numpy(np.int64), rows[value].to_numpy(float, na_value=np.nan))
        state.update((bucket.state(),))
        for lo in range(0, len(told), TOLD_AT_ONCE):
            part = slice(lo, lo + TOLD_AT_ONCE)
            yield pd.DataFrame({"_name": [bucket.names[k] for k in told[part]], "epoch_id": epochs[part], "whole": True, "values": list(values[part])})
    return run


def live_epochs(samples: DataFrame, keys: Sequence[str], sections, size: int, timeout_ms: int | None = None, idx: str = "sample_idx",
                value: str = "value", buckets: int = BUCKETS) -> DataFrame:
    """A stream of (keys..., sample_idx, value) to a stream of (keys..., epoch_id,
    whole, values).  A timeout needs a query that keeps running: Spark goes on
    making batches to look for it, so a query that is to stop has none.

    With a timeout, which Spark keeps by signal, a state is that of one signal.
    Without, signals share ``buckets`` states, and a call filters all of a
    bucket's signals together; ``buckets`` stays as it is for a checkpoint."""
    kinds = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)
    told = "epoch_id long, whole boolean, values array<double>"
    if timeout_ms:
        return samples.groupBy(*keys).applyInPandasWithState(
            epoch_maker(keys, sections, size, timeout_ms, idx, value), f"{kinds}, {told}", STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    named = samples.select(F.to_json(F.struct(*keys), exact).alias("_name"), idx, value)
    out = named.withColumn("_bucket", F.pmod(F.xxhash64("_name"), F.lit(buckets))).groupBy("_bucket").applyInPandasWithState(
        bucket_maker(sections, size, idx, value), f"_name string, {told}", "signals binary", "append", GroupStateTimeout.NoTimeout)
    back = out.withColumn("_key", F.from_json("_name", kinds, exact))
    return back.select(*[F.col("_key")[k].alias(k) for k in keys], "epoch_id", "whole", "values")


def start_live(spark: SparkSession, source_dir: str, schema, checkpoint: str, out_dir: str, keys: Sequence[str], sections, size: int,
               files_per_batch: int | None = None) -> StreamingQuery:
    """Parquet files of samples arriving in ``source_dir`` -> filtered epochs in
    ``out_dir``; stops when all files are read and goes on from the checkpoint."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    out = live_epochs(reader.parquet(source_dir), keys, sections, size)
    return out.writeStream.format("parquet").outputMode("append").option("path", out_dir).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
