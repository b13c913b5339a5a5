"""Stateful streams that end by the clock: a session from which nothing comes for a while is flushed, without a last row.

Both processors take the blocks of a session (session_id, block_idx, samples) in the order of block_idx across micro-batches.
What waits for another channel is kept block by block in a state map under its place, so a batch adds blocks and takes away
those that are used up; nothing that waits is read or written again. A decimator's state is a filter's length of samples.
Whenever a batch brings rows of a session, its timer is set anew; when it expires, what is pending goes out (zeros pad the filter
and the shorter channel), the session is closed and of its state only that stays: rows that come later are dropped. So the time
must exceed any stall that is to be made up for.

Both need the RocksDB state store (spark.sql.streaming.stateStore.providerClass). A query with timers waits for them and so does
not end by itself, not even with the trigger availableNow."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnwise.operators.signal import sinc_kernel

CHANNELS = ("mic", "system")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Decimator:
    """Every factor-th sample behind a low-pass, equal to the batch form whatever the blocks: the samples that outputs yet to come need, the place of the first, and the next output."""

    def __init__(self, factor: int, tail: list | None = None, begin: int = 0, out: int = 0):
        if factor < 1:
            raise ValueError("factor must be 1 or more")
        self.factor, self.taps = factor, np.array(sinc_kernel(factor))[::-1] if factor > 1 else np.ones(1)
        self.half = len(self.taps) // 2
        self.tail = np.zeros(self.half) if tail is None else np.asarray(tail, float)
        self.begin, self.out = (-self.half if tail is None else begin), out

    def push(self, x: np.ndarray, ends: bool = False) -> np.ndarray:
        buffer = np.concatenate([self.tail, np.asarray(x, float), np.zeros(self.half if ends else 0)])
        end = self.begin + len(buffer)
        most = max(self.out, -(-(end - self.half) // self.factor))  # the first output that needs a sample not here
        at = self.out * self.factor - self.half - self.begin
        n, self.out = most - self.out, most
        found = np.lib.stride_tricks.sliding_window_view(buffer[at:], len(self.taps))[:: self.factor][:n] @ self.taps if n else np.empty(0)
        drop = min(max(0, self.out * self.factor - self.half - self.begin), len(buffer))
        self.tail, self.begin = buffer[drop:], self.begin + drop
        return found

    def state(self) -> tuple:
        return self.tail.tolist(), self.begin, self.out


class _Timed(StatefulProcessor):
    """A timer that each batch of a session sets anew, and a flush when it expires."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.clock = handle, handle.getValueState("clock", "timer long, closed boolean")

    def _closed(self) -> bool:
        return self.clock.exists() and self.clock.get()[1]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self._closed():
            for _ in rows:
                pass
            return
        if self.clock.exists():
            self.handle.deleteTimer(self.clock.get()[0])
        blocks = pd.concat(list(rows)).sort_values("block_idx")
        yield from self.take(key[0], blocks)
        if "last" in blocks and blocks["last"].fillna(False).any():
            yield from self._end(key[0])
            return
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(due)
        self.clock.update((due, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self._closed():
            yield from self._end(key[0])

    def _end(self, session) -> Iterator[pd.DataFrame]:
        yield from self.flush(session)
        self.clock.update((0, True))

    def take(self, session, blocks: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def flush(self, session) -> Iterator[pd.DataFrame]:
        raise NotImplementedError


class DecimateProcessor(_Timed):
    def __init__(self, factor: int, idle_ms: int):
        super().__init__(idle_ms)
        self.factor = factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.filter = handle.getValueState("filter", "tail array<double>, begin long, out long")

    def _pushed(self, session, x: np.ndarray, ends: bool) -> Iterator[pd.DataFrame]:
        d = Decimator(self.factor, *(self.filter.get() if self.filter.exists() else ()))
        first, found = d.out, d.push(x, ends)
        if ends:
            self.filter.clear()
        else:
            self.filter.update(d.state())
        yield pd.DataFrame({"session_id": np.full(len(found), session, np.int64), "idx": np.arange(first, first + len(found)), "x": found})

    def take(self, session, blocks: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield from self._pushed(session, np.concatenate([np.asarray(s, float) for s in blocks["samples"]]), False)

    def flush(self, session) -> Iterator[pd.DataFrame]:
        yield from self._pushed(session, np.empty(0), True)


class RecordProcessor(_Timed):
    """Channels brought down by a factor and paired by place, as far as both have come."""

    def __init__(self, factor: int, idle_ms: int):
        super().__init__(idle_ms)
        self.factor = factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.filters = {c: handle.getValueState(f"filter_{c}", "tail array<double>, begin long, out long") for c in CHANNELS}
        self.waiting = {c: handle.getMapState(f"waiting_{c}", "place long", "samples array<double>") for c in CHANNELS}
        # how far each channel has come, and how far both are out
        self.places = handle.getValueState("places", "mic long, system long, out long")

    def _come(self) -> tuple[dict, int]:
        *come, out = self.places.get() if self.places.exists() else (0, 0, 0)
        return dict(zip(CHANNELS, come, strict=True)), out

    def _add(self, channel: str, x: np.ndarray, come: dict, ends: bool) -> None:
        own = self.filters[channel]
        d = Decimator(self.factor, *(own.get() if own.exists() else ()))
        found = d.push(x, ends)
        own.update(d.state())
        if len(found):
            self.waiting[channel].updateValue((come[channel],), (found.tolist(),))
            come[channel] += len(found)

    def _used(self, channel: str, out: int, to: int, come: int) -> np.ndarray:
        """Samples out to `to` of a channel, which go from its state; zeros beyond what has come. A block's key is the place of its first sample that is left."""
        parts, at, most = [], out, min(to, come)
        while at < most:
            x = np.asarray(self.waiting[channel].getValue((at,))[0], float)
            self.waiting[channel].removeKey((at,))
            n = min(len(x), most - at)
            parts.append(x[:n])
            if n < len(x):
                self.waiting[channel].updateValue((at + n,), (x[n:].tolist(),))
            at += n
        return np.concatenate([*parts, np.zeros(to - at)])

    def _paired(self, session, come: dict, out: int, to: int) -> Iterator[pd.DataFrame]:
        if to > out:
            tracks = {c: self._used(c, out, to, come[c]) for c in CHANNELS}
            yield pd.DataFrame({"session_id": np.full(to - out, session, np.int64), "idx": np.arange(out, to), **tracks})
        self.places.update((*come.values(), max(out, to)))

    def take(self, session, blocks: pd.DataFrame) -> Iterator[pd.DataFrame]:
        come, out = self._come()
        for channel, rows in blocks.groupby("channel"):
            self._add(channel, np.concatenate([np.asarray(s, float) for s in rows["samples"]]), come, False)
        yield from self._paired(session, come, out, min(come.values()))

    def flush(self, session) -> Iterator[pd.DataFrame]:
        come, out = self._come()
        for channel in CHANNELS:
            if self.filters[channel].exists():
                self._add(channel, np.empty(0), come, True)
        yield from self._paired(session, come, out, max(come.values()))
        for state in (*self.filters.values(), *self.waiting.values(), self.places):
            state.clear()


def _run(blocks: DataFrame, processor: _Timed, schema: str) -> DataFrame:
    if blocks.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {STORE}")
    return blocks.groupBy("session_id").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def decimate(blocks: DataFrame, factor: int, idle_ms: int = 60_000) -> DataFrame:
    """session_id, idx, x: decimated samples as soon as all they need has come, the rest after idle_ms without a block.

    blocks: session_id long, block_idx long, samples array<double>, and perhaps last boolean, which ends a session at once."""
    Decimator(factor)
    return _run(blocks, DecimateProcessor(factor, idle_ms), "session_id long, idx long, x double")


def record(blocks: DataFrame, factor: int = 1, idle_ms: int = 60_000) -> DataFrame:
    """session_id, idx, mic, system: both channels, brought down by a factor, paired by place as soon as both have come; after idle_ms
    without a block the rest, the shorter channel padded with zeros. A channel that stalls holds its session's pairs back.

    blocks: session_id long, block_idx long, channel string (mic or system), samples array<double>, and perhaps last boolean."""
    Decimator(factor)
    return _run(blocks, RecordProcessor(factor, idle_ms), "session_id long, idx long, mic double, system double")
