"""Streaming forms: the regime filter with keyed state, and watermarked windows of events."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, MapState, TimerValues

from tidemark.operators.regimes import FLOOR, densities, filter_from, stationary_distribution

#: Rows of a key that are sorted at once, of a value in the state (1 MB before it is packed), and of a frame that is given out.
HELD, PART, OUT = 1 << 18, 1 << 16, 1 << 14
STORE = "spark.sql.streaming.stateStore."
#: Keyed state on disk, with a bound on what an executor's stores have in memory outside its heap.
ROCKSDB = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.boundedMemoryUsage": "true", "rocksdb.maxMemoryUsageMB": "128", "rocksdb.writeBufferSizeMB": "8"}
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def state_session(spark: SparkSession) -> SparkSession:
    """A session for streams of keyed state, the caller's left as it is: state by RocksDB, in four stores for each core, or in as many as the caller's session has shuffle partitions if those are fewer.

    An executor keeps every store that it has had open, some 10 to 20 MB outside
    its heap even if it is empty.
    """
    own = spark.newSession()
    for name, value in ROCKSDB.items():
        own.conf.set(f"{STORE}{name}", value)
    own.conf.set("spark.sql.shuffle.partitions", str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)))
    return own


def filter_stream(stream: DataFrame, transition, means, stds, key: str = "series_id", order: str = "date", r: str = "return") -> DataFrame:
    """key, order, probabilities of each arriving row: the same recursion as the batch filter, state kept for each key.

    Rows of one key in one micro-batch are put in order; later batches must hold later rows.
    """
    transition, means, stds = (np.asarray(x, float) for x in (transition, means, stds))
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = np.array(state.get[0]) if state.exists else stationary_distribution(transition)
        frame = pd.concat(list(frames)).sort_values(order)
        like, out = densities(frame[r].to_numpy(float), means, stds), []
        for row in like:
            joint = (transition.T @ now) * row
            now = joint / max(float(joint.sum()), FLOOR)
            out.append(now)
        state.update((now.tolist(),))
        yield pd.DataFrame({key: keys[0], order: frame[order], "probabilities": out})

    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, probabilities array<double>"
    some = stream.where(F.col(r).isNotNull()).select(key, order, r)
    return some.groupBy(key).applyInPandasWithState(step, schema, "now array<double>", "append", GroupStateTimeout.NoTimeout)


def _pairs(times: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(time, value) as pairs of integers in the same order, NaN as the largest value."""
    bits = np.where(np.isnan(values), np.nan, values).view(np.int64)
    return np.stack((times, bits ^ ((bits >> 63) & _MOST)), axis=1)


def _values(rows: np.ndarray) -> np.ndarray:
    return (rows[:, 1] ^ ((rows[:, 1] >> 63) & _MOST)).view(np.float64)


def _packed(rows: np.ndarray) -> tuple[int, bytes]:
    """Number of ordered rows, and their times' steps and values compressed."""
    return len(rows), pa.compress(np.stack((np.diff(rows[:, 0], prepend=0), rows[:, 1])).tobytes(), "zstd", asbytes=True)


def _unpacked(n: int, packed: bytes) -> np.ndarray:
    steps, values = np.frombuffer(pa.decompress(bytes(packed), 16 * n, "zstd"), np.int64).reshape(2, n)
    return np.stack((np.cumsum(steps), values), axis=1)


def _in_order(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _before(rows: np.ndarray, time: int, value: int) -> int:
    """How many of the ordered rows come before a pair."""
    a, b = (int(np.searchsorted(rows[:, 0], time, side)) for side in ("left", "right"))
    return a + int(np.searchsorted(rows[a:b, 1], value))


@dataclass
class _Slot:
    """A range of pairs from (time, value) to the next slot's; ``parts`` is -1 for a single pair, of which only the count is kept."""

    time: int
    value: int
    rows: int = 0
    parts: int = 0
    name: int = 0
    first: int = _MOST


class _Held:
    """The rows of a key that wait for the watermark, in slots of some ``size`` rows.

    A slot that grows beyond that is divided at its middle row, and many rows of
    one pair become a count. A slot's rows and those just come are all that is in
    memory, however many rows wait and however they lie in time.
    """

    def __init__(self, store: MapState, slots: list, size: int = HELD) -> None:
        self.store, self.slots, self.size = store, [_Slot(*s) for s in slots] or [_Slot(_LEAST, _LEAST)], size
        self.names = max(s.name for s in self.slots)

    def state(self) -> list[list[int]]:
        return [list(astuple(s)) for s in self.slots]

    def first(self) -> int | None:
        """The earliest time."""
        return next((s.first for s in self.slots if s.rows), None)

    def add(self, rows: np.ndarray) -> None:
        rows, made = _in_order(rows), []
        cuts = [0, *(_before(rows, s.time, s.value) for s in self.slots[1:]), len(rows)]
        for slot, a, b in zip(self.slots, cuts[:-1], cuts[1:], strict=True):
            self._put(slot, rows[a:b])
            made += self._divided(slot) if slot.parts >= 0 and slot.rows > self.size else [slot]
        self.slots = made

    def take(self, until: int) -> Iterator[np.ndarray]:
        """Takes out the rows up to a time, in order; no row of that time or before may be added later."""
        while self.slots and self.slots[0].time <= until:
            slot = self.slots[0]
            if slot.parts < 0:
                for at in range(0, slot.rows, self.size):
                    yield np.full((min(self.size, slot.rows - at), 2), (slot.time, slot.value))
            elif slot.rows:
                rows = self._taken(slot)
                ready = int(np.searchsorted(rows[:, 0], until, "right"))
                self._put(slot, rows[ready:])
                yield rows[:ready]
            if slot.parts >= 0 and (slot.rows or len(self.slots) == 1 or self.slots[1].time > until):
                break
            self.slots.pop(0)
        if not self.slots or self.slots[0].parts < 0:  # rows before a single pair need a slot
            self.slots.insert(0, self._new(_LEAST, _LEAST))
        self.slots[0].time = self.slots[0].value = _LEAST

    def _new(self, time: int, value: int) -> _Slot:
        self.names += 1
        return _Slot(time, value, name=self.names)

    def _put(self, slot: _Slot, rows: np.ndarray) -> None:
        if len(rows):
            slot.rows, slot.first = slot.rows + len(rows), min(slot.first, int(rows[0, 0]))
            for at in range(0, len(rows) if slot.parts >= 0 else 0, PART):
                self.store.updateValue((slot.name, slot.parts), _packed(rows[at : at + PART]))
                slot.parts += 1

    def _taken(self, slot: _Slot) -> np.ndarray:
        names = [(slot.name, k) for k in range(slot.parts)]
        rows = np.concatenate([_unpacked(*self.store.getValue(n)) for n in names])
        for n in names:
            self.store.removeKey(n)
        slot.rows, slot.parts, slot.first = 0, 0, _MOST
        return _in_order(rows)

    def _divided(self, slot: _Slot) -> list[_Slot]:
        rows = self._taken(slot)
        time, value = (int(x) for x in rows[len(rows) // 2])
        a, b = _before(rows, time, value), _before(rows, time, value + 1)
        made, cuts = [slot, self._new(time, value)], [0, a, len(rows)]
        if a == 0 or b - a > self.size // 2:  # many rows of one pair
            made[1].parts = -1
            made, cuts = [*made, self._new(time, value + 1)], [0, a, b, len(rows)]
        for s, x, y in zip(made, cuts[:-1], cuts[1:], strict=True):
            self._put(s, rows[x:y])
        return made


class _TimedFilter(StatefulProcessor):
    """Rows are held as they come; a timer at the earliest of them takes out what the watermark has passed."""

    def __init__(self, key: str, transition: np.ndarray, means: np.ndarray, stds: np.ndarray, silence_ms: int, held_rows: int) -> None:
        self.key, self.law, self.transition, self.silence_ms, self.held_rows = key, (means, stds), transition, silence_ms, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "now array<double>, last long, timer long, slots array<array<long>>")
        self.store = handle.getMapState("held", "slot long, part long", "n long, rows binary")

    def _read(self) -> tuple[np.ndarray, int, int | None, _Held]:
        now, last, timer, slots = self.facts.get() or (stationary_distribution(self.transition), 0, None, [])
        return np.array(now, float), last, timer, _Held(self.store, slots, self.held_rows)

    def _write(self, now: np.ndarray, last: int, timer: int | None, held: _Held) -> None:
        first = held.first()
        due = last // 1000 + self.silence_ms if first is None else -(-first // 1000)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.facts.update((now.tolist(), last, due, held.state()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, last, timer, held = self._read()
        some, n = [], 0
        for frame in rows:
            # By place: Spark gives some names anew here.
            some.append(_pairs(frame.iloc[:, -1].to_numpy(np.int64), frame.iloc[:, -2].to_numpy(float)))
            n += len(frame)
            if n >= self.held_rows:
                held.add(np.concatenate(some))
                some, n = [], 0
        if some:
            held.add(np.concatenate(some))
        self._write(now, last, timer, held)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        now, last, timer, held = self._read()
        for rows in held.take(mark * 1000):
            for at in range(0, len(rows), OUT):
                some = rows[at : at + OUT]
                probabilities, _ = filter_from(densities(_values(some), *self.law), self.transition, now)
                now, last = probabilities[-1], int(some[-1, 0])
                yield pd.DataFrame({self.key: key[0], "_us": some[:, 0], **{f"_p{k}": p for k, p in enumerate(probabilities.T)}})
        if held.first() is None and last // 1000 + self.silence_ms <= mark:
            self.facts.clear()
        else:
            self._write(now, last, timer, held)


def filter_stream_by_time(
    stream: DataFrame, transition, means, stds, key: str = "series_id", order: str = "ts", r: str = "value", late: str = "1 hour", silence_ms: int = 7 * 86_400_000, held_rows: int = HELD,
) -> DataFrame:
    """key, order, probabilities: the rows of the batch filter from a stream whose rows come in any order, up to ``late`` behind the newest.

    A row is held in its key's state until the watermark has passed it, so that
    nothing before it can still come; a timer at the earliest held row releases
    rows of keys that get no new ones. A key without held rows whose last row is
    ``silence_ms`` behind the watermark is forgotten, and starts anew if it comes
    back. Rows behind the watermark are left out; equal times go by value.

    The state, the rows of ``late`` for each key, is kept by RocksDB on disk; a task
    has some ``held_rows`` of them in memory. Spark's default provider can't keep
    it: a session that holds that default gets RocksDB's, any other setting is
    left as it is. A session of few stores for large states is ``state_session``'s.
    """
    transition, means, stds = (np.asarray(x, float) for x in (transition, means, stds))
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    conf = stream.sparkSession.conf
    if conf.get(f"{STORE}providerClass").endswith(".HDFSBackedStateStoreProvider"):
        for name, value in ROCKSDB.items():
            conf.set(f"{STORE}{name}", value)
    names = [f"_p{k}" for k in range(len(means))]
    schema = f"`{key}` {kinds[key]}, _us long, {', '.join(f'{n} double' for n in names)}"
    some = stream.where(F.col(r).isNotNull() & F.col(order).isNotNull()).select(key, F.col(order).cast("timestamp").alias(order), F.col(r).cast("double").alias(r)).withWatermark(order, late)
    # Times go to Python as numbers, which the session's time zone has no part in.
    made = some.withColumn("_us", F.unix_micros(order)).groupBy(key).transformWithStateInPandas(_TimedFilter(key, transition, means, stds, silence_ms, held_rows), schema, "append", "EventTime")
    return made.select(key, F.timestamp_micros("_us").alias(order), F.array(*names).alias("probabilities"))


def windowed_means(stream: DataFrame, ts_column: str = "ts", value: str = "value", keys=("event_type",), width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and mean of a value by window and keys, for streams and batches alike; rows later than ``late`` are left out of streams."""
    timed = stream.withColumn(ts_column, F.col(ts_column).cast("timestamp")).withWatermark(ts_column, late)
    made = timed.groupBy(F.window(ts_column, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
    return made.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean_value")
