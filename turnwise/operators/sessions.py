"""Order-dependent operators over sessions: the silence watchdog, islands, drift, peaks and packing."""

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from turnwise.operators import scan

CALIBRATION, FACTOR, MIC_FLOOR, SYSTEM_LIMIT, STOP, POLL = 3.0, 4.0, 1e-3, 5e-4, 45.0, 0.25


def watchdog_thresholds(blocks: DataFrame, poll: float = POLL, calibration: float = CALIBRATION) -> DataFrame:
    """session_id and thr from the first blocks of each session; sessions shorter than the calibration have none."""
    n = math.ceil(calibration / poll)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("mic"))
    first = blocks.where(F.col("i") < n).withColumn("_r", place)  # n rows a session
    upper = F.max(F.when(F.col("_r") == n // 2 + 1, F.col("mic")))
    return first.groupBy("session_id").agg(F.count("*").alias("n"), F.greatest(upper * FACTOR, F.lit(MIC_FLOOR)).alias("thr")).where(F.col("n") == n).select("session_id", "thr")


def silence_runs(blocks: DataFrame, poll: float = POLL, calibration: float = CALIBRATION, span: int | None = None) -> DataFrame:
    """session_id, i, act, silence: seconds since the last activity once a session is armed; 0 before and while active.

    blocks: session_id, i from 0, mic, system (null if there is none). A cell's summary is its last activity."""
    n, keys = math.ceil(calibration / poll), ["session_id"]
    live = blocks.join(watchdog_thresholds(blocks, poll, calibration), "session_id").where(F.col("i") >= n)
    act = (F.col("mic") > F.col("thr")) | F.coalesce(F.col("system") > SYSTEM_LIMIT, F.lit(False))
    rows = live.select("session_id", "i", act.alias("act"), F.floor(F.col("i") / (span or scan.SPAN)).alias("_cell"))
    active = F.when(F.col("act"), F.col("i"))
    lasts = rows.groupBy("session_id", "_cell").agg(F.max(active).alias("_last"))
    known = scan.carried(rows, keys, lasts.select("session_id", "_cell", F.max("_last").over(scan.before(keys)).alias("_carry")))
    last = F.coalesce(F.max(active).over(scan.order(keys, "i").rowsBetween(Window.unboundedPreceding, 0)), F.col("_carry"))
    return known.select("session_id", "i", "act", F.coalesce((F.col("i") - last) * poll, F.lit(0.0)).alias("silence"))


def watchdog_stops(blocks: DataFrame, stop: float = STOP, poll: float = POLL) -> DataFrame:
    """session_id and stop_i, the block at which the session's silence first lasts `stop` seconds; sessions that never stop are absent."""
    return silence_runs(blocks, poll).where((F.col("silence") >= stop) & (F.col("silence") > 0)).groupBy("session_id").agg(F.min("i").alias("stop_i"))


def islands(points: DataFrame, jump: float, span: int | None = None) -> DataFrame:
    """points (session_id, t, d) with island: a new one begins where d changes by more than jump.

    A cell's summary is its first and last d and how often d jumps between; the scan adds the jumps from cell to cell."""
    keys, broken = ["session_id"], lambda a, b: F.coalesce((F.abs(a - b) > jump).cast("int"), F.lit(0))
    rows = scan.in_cells(points, keys, "t", span)
    rows = rows.withColumn("_new", broken(F.col("d"), F.lag("d").over(scan.order(keys, "t"))))
    cells = rows.groupBy("session_id", "_cell").agg(F.sum("_new").alias("_jumps"), F.min_by("d", "t").alias("_first"), F.max_by("d", "t").alias("_end"))
    along = Window.partitionBy("session_id").orderBy("_cell")
    edges = cells.withColumn("_edge", broken(F.col("_first"), F.lag("_end").over(along)))
    ahead = edges.select("session_id", "_cell", (F.sum(F.col("_jumps") + F.col("_edge")).over(along) - F.col("_jumps")).alias("_ahead"))
    own = F.sum("_new").over(scan.order(keys, "t"))
    return scan.carried(rows, keys, ahead).withColumn("island", (own + F.col("_ahead")).cast("long")).drop("_new", "_cell", "_ahead")


def step_count(points: DataFrame, jump: float) -> DataFrame:
    """session_id and n_steps: how often d changes by more than jump."""
    return islands(points, jump).groupBy("session_id").agg(F.max("island").alias("n_steps"))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """turns with turn_idx, their place in the session by start; ties by end, then speaker."""
    return scan.numbered(turns, ["session_id"], ["start", "end", "speaker"], "turn_idx", 0).withColumn("turn_idx", F.col("turn_idx").cast("int"))


def session_dir(started: Column, name: Column, default: str = "meeting") -> Column:
    """A session's folder: its date and its name, or the default."""
    return F.concat(F.date_format(started, "yyyy-MM-dd"), F.lit("-"), F.coalesce(name, F.lit(default)))


def status_line(mic_rms: Column, system_rms: Column, state: Column) -> Column:
    """A recording's status as text; a missing system channel shows as a dash."""
    four = lambda c: F.when(c.isNotNull(), F.format_string("%.4f", c))
    return F.concat(F.lit("mic_rms="), four(mic_rms), F.lit(" sys_rms="), F.coalesce(four(system_rms), F.lit("-")), F.lit(" state="), state)


def drift(points: DataFrame, jump: float, rate: float, least: int = 3) -> DataFrame:
    """session_id, ppm and n_islands: the mean slope of d over t in islands of `least` points or more, in parts per million of rate."""
    slopes = islands(points, jump).groupBy("session_id", "island").agg(F.regr_slope("d", "t").alias("slope"), F.count("*").alias("n")).where(F.col("n") >= least)
    return slopes.groupBy("session_id").agg((1e6 * F.avg("slope") / rate).alias("ppm"), F.count("*").alias("n_islands"))


def argmax(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """key and the place of its largest value, the first of equals."""
    return rows.groupBy(key).agg(F.max_by(at, F.struct(F.col(value), -F.col(at))).alias(at), F.max(value).alias(value))


def top_peaks(rows: DataFrame, key: str, at: str, value: str, apart: int, most: int = 6) -> DataFrame:
    """key, rank, at, value: the largest values, each `apart` places or more from those before it; places are whole numbers.

    A peak shuts out 2 * apart - 1 places at most, so the k-th peak is among the first (k - 1) * (2 * apart - 1) + 1 places by value:
    only these are gathered, whatever the session's length (Spark cuts to them before the shuffle too)."""
    best = rows.groupBy(key, at).agg(F.max(value).alias(value))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(value).desc(), at))
    near_top = best.withColumn("_r", place).where(F.col("_r") <= (most - 1) * (2 * apart - 1) + 1)
    sorted_rows = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(at).alias("p"), F.col(value).alias("v")))), lambda r: F.struct(r["p"].alias("p"), r["v"].alias("v")))
    listed = near_top.groupBy(key).agg(sorted_rows.alias("l"))

    def take(taken, r):
        near = F.exists(taken, lambda t: F.abs(t["p"] - r["p"]) < apart)
        return F.when((F.size(taken) >= most) | near, taken).otherwise(F.concat(taken, F.array(r)))

    taken = F.aggregate("l", F.filter("l", lambda r: F.lit(False)), take)
    return listed.select(key, F.posexplode(taken).alias("rank", "r")).select(key, (F.col("rank") + 1).cast("long").alias("rank"), F.col("r.p").alias(at), F.col("r.v").alias(value))


def pack(items: DataFrame, key: str, order: str, count: str, budget: int) -> DataFrame:
    """items with window_id: in order, an item opens a new window if the current one isn't empty and would exceed the budget.

    Rows are sorted within partitions by key and order and flow by; a task holds a batch and the current window's sum."""
    def placed(batches):
        last, window, used = None, -1, 0
        for batch in batches:
            ids = []
            for k, n in zip(batch.column("_k").to_pylist(), batch.column("_n").to_pylist(), strict=True):
                if (k,) != last:
                    last, window, used = (k,), 0, n
                elif used + n > budget:
                    window, used = window + 1, n
                else:
                    used += n
                ids.append(window)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(ids, pa.int64())], names=["_row", "window_id"])

    rows = items.select(F.struct(*items.columns).alias("_row"), F.col(key).alias("_k"), F.col(count).cast("long").alias("_n"), F.col(order).alias("_o"))
    sorted_rows = rows.repartition("_k").sortWithinPartitions("_k", "_o").select("_row", "_k", "_n")
    schema = StructType([rows.schema["_row"], StructField("window_id", LongType())])
    return sorted_rows.mapInArrow(placed, schema).select("_row.*", "window_id")


def with_overlap(packed: DataFrame, key: str, order: str, lines: int = 2) -> DataFrame:
    """packed rows and, before each window but the first, the last `lines` rows of the window before it (carried = true)."""
    own = packed.withColumn("carried", F.lit(False))
    if lines <= 0:
        return own
    back = F.row_number().over(Window.partitionBy(key, "window_id").orderBy(F.col(order).desc()))
    tail = packed.withColumn("_r", back).where(F.col("_r") <= lines).drop("_r").withColumn("window_id", F.col("window_id") + 1)
    later = packed.select(key, "window_id").distinct()
    return own.unionByName(tail.join(later, [key, "window_id"], "left_semi").withColumn("carried", F.lit(True)))


def pack_budget(context: Column, max_out: int = 1024, overhead: int = 64, fill: float = 0.75) -> Column:
    """Tokens a window may take: fill times what the context leaves, towards zero; it may be negative."""
    return (fill * (context - max_out - overhead)).cast("int")


def fits(prompt_tokens: Column, context: Column, max_out: int = 1024, overhead: int = 64) -> Column:
    """Whether a whole prompt, template included, leaves room for its answer."""
    return prompt_tokens <= context - max_out - overhead


def context_tokens(config: Column, default: int = 8192, cap: int = 32768) -> Column:
    """The context length a model's JSON configuration states, at its top or under text_config."""
    of = lambda path: F.nullif(F.get_json_object(config, path).cast("int"), F.lit(0))
    return F.least(F.coalesce(of("$.max_position_embeddings"), of("$.text_config.max_position_embeddings"), F.lit(default)), F.lit(cap))
