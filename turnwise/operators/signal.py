"""Sampled signals in long form (session_id, idx, x): frames, alignment, resampling, levels and delays."""

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND, SHARPNESS, DTD, ERLE_FRAME = (300.0, 3400.0), 15.0, 0.05, 2048


def array_rms(x: Column) -> Column:
    """Root mean square of an array; 0 if empty."""
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return F.when(F.size(x) > 0, F.sqrt(total / F.size(x))).otherwise(0.0)


def in_order(c: Column) -> Column:
    """The sum of an array's numbers from its first on, nulls left out; null if there are none. A plain sum adds in the order in which rows
    arrive, so two evaluations may differ in the last bit, which decides where a value is compared with a median of its like."""
    some = F.filter(c, lambda v: v.isNotNull())
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v))


def frame_power(track: DataFrame, frame: int, whole: bool = True) -> DataFrame:
    """session_id, frame, power: the mean square of each frame, its samples added in their order; a partial last frame is dropped (or,
    whole=False, padded with zeros). A group holds no more than a frame."""
    rows = F.sort_array(F.collect_list(F.struct("idx", F.col("x").cast("double").alias("x"))))
    cells = track.groupBy("session_id", F.floor(F.col("idx") / frame).alias("frame")).agg(rows.alias("rows"))
    cells = cells.where(F.size("rows") == frame) if whole else cells
    return cells.select("session_id", "frame", (in_order(F.transform("rows", lambda r: r["x"] * r["x"])) / frame).alias("power"))


def active_frames(frames: DataFrame) -> DataFrame:
    """Frames above their session's median power, which counts as 1e-12 at least."""
    limit = frames.groupBy("session_id").agg(F.greatest(F.median("power"), F.lit(1e-12)).alias("limit"))
    return frames.join(limit, "session_id").where("power > limit").drop("limit")


def echo_only(near: DataFrame, far: DataFrame, ratio: float = DTD) -> DataFrame:
    """Frames whose near power is below ratio times the far power."""
    both = near.withColumnRenamed("power", "near").join(far.withColumnRenamed("power", "far"), ["session_id", "frame"])
    return both.where(F.col("near") < ratio * F.col("far"))


def erle(near: DataFrame, far: DataFrame, cleaned: DataFrame, frame: int = ERLE_FRAME, ratio: float = DTD) -> DataFrame:
    """session_id and erle_db: how far the echo fell, over frames with a loud far side, no near speech and measurable power; 0 if none."""
    parts = [frame_power(t, frame).withColumnRenamed("power", n) for t, n in ((near, "before"), (far, "far_p"), (cleaned, "after"))]
    frames = parts[0].join(parts[1], ["session_id", "frame"]).join(parts[2], ["session_id", "frame"])
    loud = frames.groupBy("session_id").agg(F.median("far_p").alias("mid"))
    kept = frames.join(loud, "session_id").where("far_p >= mid and before > 1e-9 and after > 1e-12").where(F.col("before") <= ratio * F.col("far_p"))
    found = kept.groupBy("session_id").agg((10 * F.log10(F.median(F.col("before") / F.col("after")))).alias("db"))
    return loud.join(found, "session_id", "left").select("session_id", F.coalesce("db", F.lit(0.0)).alias("erle_db"))


def delay_summary(segments: DataFrame, sharpness: float = SHARPNESS) -> DataFrame:
    """session_id, lag and sharpness from per-segment measures: the least usable lag (0 if none), the median of all sharpness."""
    usable = (F.col("sharpness") >= sharpness) & (F.col("lag") >= 0)
    return segments.groupBy("session_id").agg(F.coalesce(F.min(F.when(usable, F.col("lag"))), F.lit(0)).alias("lag"), F.coalesce(F.median("sharpness"), F.lit(0.0)).alias("sharpness"))


def gated(summary: DataFrame, sharpness: float = SHARPNESS) -> DataFrame:
    """Whether echo cancelling is worth trying, by session."""
    return summary.withColumn("cancel", F.col("sharpness") >= sharpness)


def align_common(mic: DataFrame, system: DataFrame) -> DataFrame:
    """session_id, idx, mic, system over the samples both have."""
    return mic.withColumnRenamed("x", "mic").join(system.withColumnRenamed("x", "system"), ["session_id", "idx"])


def align_padded(mic: DataFrame, system: DataFrame) -> DataFrame:
    """As align_common, to the longer of the two with zeros."""
    both = mic.withColumnRenamed("x", "mic").join(system.withColumnRenamed("x", "system"), ["session_id", "idx"], "full_outer")
    return both.select("session_id", "idx", F.coalesce("mic", F.lit(0.0)).alias("mic"), F.coalesce("system", F.lit(0.0)).alias("system"))


def lag_aligned(mic: DataFrame, system: DataFrame, lag: int) -> DataFrame:
    """The microphone's sample idx with the system's idx - lag."""
    return align_common(mic, system.withColumn("idx", F.col("idx") + lag))


def positions(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with idx, their place within keys from 0."""
    return blocks.withColumn("idx", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def sinc_kernel(factor: int, taps_per_phase: int = 8) -> list[float]:
    """A Hamming-windowed sinc low-pass of 4 * factor * taps_per_phase + 1 taps that sum to 1."""
    half = 2 * factor * taps_per_phase
    n = 2 * half
    sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
    taps = [sinc(k / factor) * (0.54 - 0.46 * math.cos(2 * math.pi * (k + half) / n)) for k in range(-half, half + 1)]
    return [t / sum(taps) for t in taps]


def fir_decimate(track: DataFrame, factor: int, kernel: list[float] | None = None, block: int = 4096) -> DataFrame:
    """session_id, idx, x: every factor-th sample of the track convolved with a centred kernel, zeros beyond the ends and in gaps;
    places that no sample reaches are left out.

    Samples are dealt to blocks of `block` outputs, those within half a kernel of a border to both sides, so long tracks
    spread over all tasks and a sample is sent little more than once. A task takes its blocks one after another from sorted rows and
    holds one of them; a block is convolved as one array."""
    if factor < 1:
        raise ValueError("factor must be 1 or more")
    if factor == 1 and kernel is None:
        return track
    kernel = kernel or sinc_kernel(factor)
    taps, half, span = np.array(kernel)[::-1], len(kernel) // 2, block * factor
    low, high = F.floor((F.col("idx") - half) / span), F.floor((F.col("idx") + half) / span)
    dealt = track.select(F.col("session_id").cast("long").alias("session_id"), F.explode(F.sequence(F.greatest(low, F.lit(0)), F.greatest(high, F.lit(0)))).alias("_block"), F.col("idx").cast("long").alias("idx"), F.col("x").cast("double").alias("x"))
    size = track.groupBy("session_id").agg(F.max("idx").alias("last"))

    def convolve(batches):
        held, open_at = [], None

        def done():
            at, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            first = open_at[1] * span - half
            n = min(block, (int(at[-1]) - first) // factor + 1)
            line = np.zeros((n - 1) * factor + len(taps))
            use = at - first < len(line)
            line[at[use] - first] = x[use]
            return open_at[0], open_at[1] * block + np.arange(n), np.lib.stride_tricks.sliding_window_view(line, len(taps))[::factor] @ taps

        def given(found):
            ids = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.concatenate([f[k] for f in found])) for k in (1, 2))], names=["session_id", "idx", "x"])

        for batch in batches:
            session, cell, at, x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((session[1:] != session[:-1]) | (cell[1:] != cell[:-1])) + 1
            found = []
            for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(at)]):
                if hi == lo:
                    continue
                if open_at != (session[lo], cell[lo]):
                    if held:
                        found.append(done())
                    held, open_at = [], (session[lo], cell[lo])
                held.append((at[lo:hi], x[lo:hi]))
            if found:
                yield given(found)
        if held:
            yield given([done()])

    rows = dealt.repartition("session_id", "_block").sortWithinPartitions("session_id", "_block", "idx")
    return rows.mapInArrow(convolve, "session_id long, idx long, x double").join(size, "session_id").where(F.col("idx") <= F.floor(F.col("last") / factor)).drop("last")


def linear_resample(track: DataFrame, step: float) -> DataFrame:
    """session_id, idx, x at positions 0, step, 2 * step, ...; only where both neighbours exist. Neighbours meet by an equi-join on
    their place, so one long session spreads over tasks."""
    ahead = track.join(track.select("session_id", (F.col("idx") - 1).alias("idx"), F.col("x").alias("next")), ["session_id", "idx"])
    first, last = F.ceil(F.col("idx") / step), F.ceil((F.col("idx") + 1) / step) - 1
    cells = ahead.where(last >= first).withColumn("out", F.explode(F.sequence(first, last)))
    share = F.col("out") * step - F.col("idx")
    return cells.select("session_id", F.col("out").alias("idx"), (F.col("x") * (1 - share) + F.col("next") * share).alias("x"))


def reassembled(mic: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The microphone's track with the samples that were cleaned in their places; what lies before and behind stays."""
    new = cleaned.select("session_id", "idx", F.col("x").cast("double").alias("_new"))
    return mic.join(new, ["session_id", "idx"], "left").select("session_id", "idx", F.coalesce("_new", F.col("x").cast("double")).alias("x"))


def track_rms(track: DataFrame) -> DataFrame:
    """session_id and rms of the whole track."""
    return track.groupBy("session_id").agg(F.sqrt(F.avg(F.col("x").cast("double") * F.col("x"))).alias("rms"))


def downmix(channels: Column) -> Column:
    """The mean of an array of channel values, as a float; null for no channels."""
    total = F.aggregate(channels, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return F.when(F.size(channels) > 0, total / F.size(channels)).cast("float")


def milliseconds(samples: Column, rate: int) -> Column:
    return 1000.0 * samples / rate


def sample_count(ms: Column, rate: int) -> Column:
    """Whole samples of a time, cut towards zero."""
    return (ms * rate / 1000.0).cast("long")


def zipped(a: Column, b: Column) -> Column:
    """Two arrays by place, as structs a, b; arrays of unequal size are an error."""
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("a"), F.get(b, i).alias("b")))
    return F.when(F.size(a) == F.size(b), pairs).otherwise(F.raise_error(F.lit("arrays of unequal size")))


def clip(x: Column) -> Column:
    """Within [-1, 1]; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def quantize(x: Column) -> Column:
    """16-bit PCM, cut towards zero; NaN becomes 0."""
    return F.when(F.isnan(x), 0).otherwise((clip(x) * 32767).cast("int")).cast("smallint")


def dequantize(v: Column) -> Column:
    return v.cast("double") / 32768


def ascii_bar(value: Column, peak: Column, width: int = 40) -> Column:
    return F.repeat(F.lit("#"), F.bround(width * F.greatest(value, F.lit(0.0)) / peak).cast("int"))
