"""Structured Streaming forms of the stateful operators, equal to their batch forms on the same rows.

Rows of a session must arrive in the order of i (or block_idx) across micro-batches; within one they are sorted. State
is a few numbers a session for the watchdog and a filter's tail for the decimator."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnwise.operators import sessions as S
from turnwise.operators.signal import sinc_kernel
from turnwise.sources.recordings import write_tracks
from turnwise.streaming.status import Watchdog


def watchdog_stream(blocks: DataFrame, stop: float = S.STOP, poll: float = S.POLL, calibration: float = S.CALIBRATION) -> DataFrame:
    """session_id and stop_i as soon as a session's silence lasts `stop` seconds; at most one row a session.

    blocks: session_id long, i long, mic double, system double (null if there is none)."""
    need = math.ceil(calibration / poll)

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *kept, fired = state.get if state.exists else (None, False)
        dog, out = Watchdog(need, poll, tuple(kept) if state.exists else None), []
        for row in pd.concat(list(batches)).sort_values("i").itertuples():
            dog.update(row.mic, None if pd.isna(row.system) else row.system)
            if not fired and dog.silence >= stop > 0:
                fired = True
                out.append((key[0], int(row.i)))
        state.update((*dog.state(), fired))
        yield pd.DataFrame(out, columns=["session_id", "stop_i"])

    return blocks.groupBy("session_id").applyInPandasWithState(update, "session_id long, stop_i long", "heard array<double>, thr double, silence double, armed boolean, fired boolean", "append", GroupStateTimeout.NoTimeout)


def decimate_stream(blocks: DataFrame, factor: int, taps_per_phase: int = 8) -> DataFrame:
    """session_id, idx, x: decimated samples as soon as all they need has come; a block with last = true flushes the rest.

    blocks: session_id long, block_idx long, samples array<double>, last boolean."""
    if factor < 1:
        raise ValueError("factor must be 1 or more")
    kernel = np.array(sinc_kernel(factor, taps_per_phase))
    half = len(kernel) // 2

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, at, out = state.get if state.exists else ([0.0] * half, 0, 0)
        x, done = np.asarray(tail, float), False
        for row in pd.concat(list(batches)).sort_values("block_idx").itertuples():
            x = np.concatenate([x, np.asarray(row.samples, float)])
            done = done or bool(row.last)
        last = at + len(x) - half  # samples so far; x starts half before sample `at`
        x = np.concatenate([x, np.zeros(half)]) if done else x
        found = []
        while out * factor + half < at + len(x) - half and out * factor < last:
            k = out * factor - at
            found.append((key[0], out, float(x[k : k + len(kernel)] @ kernel[::-1])))
            out += 1
        drop = max(0, min(out * factor - at, len(x)))
        state.update((x[drop:].tolist(), at + drop, out))
        yield pd.DataFrame(found, columns=["session_id", "idx", "x"])

    return blocks.groupBy("session_id").applyInPandasWithState(update, "session_id long, idx long, x double", "tail array<double>, at long, out long", "append", GroupStateTimeout.NoTimeout)


def align_stream(blocks: DataFrame) -> DataFrame:
    """session_id, idx, mic, system: samples of two channels paired by place as soon as both have come; last = true pads the shorter.

    blocks: session_id long, block_idx long, channel string (mic or system), samples array<double>, last boolean."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mic, system, at = state.get if state.exists else ([], [], 0)
        pending, done = {"mic": list(mic), "system": list(system)}, False
        for row in pd.concat(list(batches)).sort_values("block_idx").itertuples():
            pending[row.channel] += [float(v) for v in row.samples]
            done = done or bool(row.last)
        if done:
            n = max(map(len, pending.values()))
            pending = {c: x + [0.0] * (n - len(x)) for c, x in pending.items()}
        n = min(map(len, pending.values()))
        state.update((pending["mic"][n:], pending["system"][n:], at + n))
        yield pd.DataFrame({"session_id": np.full(n, key[0], np.int64), "idx": np.arange(at, at + n), "mic": np.array(pending["mic"][:n], float), "system": np.array(pending["system"][:n], float)})

    return blocks.groupBy("session_id").applyInPandasWithState(update, "session_id long, idx long, mic double, system double", "mic array<double>, system array<double>, at long", "append", GroupStateTimeout.NoTimeout)


def resample_stream(blocks: DataFrame, step: float) -> DataFrame:
    """session_id, idx, x at positions 0, step, 2 * step, ... of the samples, interpolated as soon as both neighbours have come.

    The phase is carried over blocks: state is the samples from the next position on, where they begin and what is out.
    blocks: session_id long, block_idx long, samples array<double>."""
    if step <= 0:
        raise ValueError("step must be above 0")

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, begins, done = state.get if state.exists else ([], 0, 0)
        rows = pd.concat(list(batches)).sort_values("block_idx")
        x = np.concatenate([np.asarray(tail, float), *(np.asarray(s, float) for s in rows["samples"])])
        ready = max(0, begins + len(x) - 1)  # positions below this have both neighbours
        at = np.arange(done, max(done, math.ceil(ready / step)))
        left = np.floor(at * step).astype(np.int64) - begins
        share = at * step - np.floor(at * step)
        found = x[left] * (1 - share) + x[left + 1] * share if len(at) else np.empty(0)
        done += len(at)
        keep = min(max(0, math.floor(done * step) - begins), len(x))
        state.update((x[keep:].tolist(), begins + keep, done))
        yield pd.DataFrame({"session_id": np.full(len(at), key[0], np.int64), "idx": at, "x": found})

    return blocks.groupBy("session_id").applyInPandasWithState(update, "session_id long, idx long, x double", "tail array<double>, begins long, done long", "append", GroupStateTimeout.NoTimeout)


def frames_stream(packets: DataFrame, channels: int) -> DataFrame:
    """session_id, idx, x: raw packets of interleaved 32-bit floats as mono samples; bytes short of a frame wait for the next packet.

    packets: session_id long, packet_idx long, data binary."""
    size = 4 * channels

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, at = state.get if state.exists else (b"", 0)
        data = bytes(rest) + b"".join(bytes(d) for d in pd.concat(list(batches)).sort_values("packet_idx")["data"])
        n = len(data) // size
        x = np.frombuffer(data, "<f4", n * channels).reshape(n, channels).mean(1, dtype=np.float64).astype(np.float32)
        state.update((data[n * size :], at + n))
        yield pd.DataFrame({"session_id": np.full(n, key[0], np.int64), "idx": np.arange(at, at + n), "x": x})

    return packets.groupBy("session_id").applyInPandasWithState(update, "session_id long, idx long, x float", "rest binary, at long", "append", GroupStateTimeout.NoTimeout)


def record_stream(aligned: DataFrame, path: str, checkpoint: str):
    """Starts the recorder: align_stream's samples go to Parquet files by session as they come, each once; recordings() makes files of them. recordings.record_wav writes files at once, where the folder is mounted."""
    silent = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mic", "system")]  # an expression also makes plain rows of Arrow's, which the writer needs
    return aligned.select("session_id", "idx", *silent).writeStream.format("parquet").partitionBy("session_id").option("checkpointLocation", checkpoint).outputMode("append").start(path)


def recordings(spark, path: str, to: str, rate: int) -> None:
    """Makes a stereo WAV file of each recorded session in the folder `to`; no row or task holds a session."""
    rows = spark.read.schema("idx long, mic double, system double, session_id long").parquet(path)
    write_tracks(rows, to, rate)


def with_status(blocks: DataFrame, name: str = "status") -> DataFrame:
    """blocks (mic, system: levels; perhaps state and silence, as states_stream gives them), observed: each micro-batch reports its
    rows, last levels and loudest ones to query listeners."""
    last = lambda c, to: F.max_by(c, "i").alias(to)
    more = [last(c, c) for c in ("state", "silence") if c in blocks.columns]
    return blocks.observe(name, F.count(F.lit(1)).alias("blocks"), last("mic", "mic_rms"), last("system", "system_rms"), F.max("mic").alias("mic_peak"), F.max("system").alias("system_peak"), *more)
