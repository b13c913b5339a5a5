"""Joins of timed rows: overlap, best overlap, anti and semi joins with a text test."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text as T


def interval_join(left: DataFrame, right: DataFrame, key: str, width: float, slack: float = 0.0) -> DataFrame:
    """Pairs of a key whose time spans come within slack of each other; right's other columns get the prefix r_.

    Both sides are dealt to time buckets of `width`, so a long session spreads over (key, bucket) and the join stays an
    equi-join; a pair counts in the first bucket that both reach. Callers add their exact predicate."""
    cell = lambda c: F.floor(c / width).cast("long")
    buckets = lambda s, e: F.explode(F.sequence(cell(s), F.greatest(cell(s), cell(e))))
    a = left.withColumn("_b", buckets(F.col("start") - slack, F.col("end") + slack))
    b = right.select(F.col(key), *(F.col(c).alias(f"r_{c}") for c in right.columns if c != key)).withColumn("_b", buckets(F.col("r_start"), F.col("r_end")))
    first = F.greatest(cell(F.col("start") - slack), cell(F.col("r_start")))
    return a.join(b, [key, "_b"]).where(F.col("_b") == first).drop("_b")


def assign_speakers(segments: DataFrame, turns: DataFrame, width: float = 60.0) -> DataFrame:
    """segments with `speaker` of the turn that overlaps most (the earliest among equals), null where none overlaps.

    segments: session_id, seq, start, end, ...; turns: session_id, turn_idx, start, end, speaker."""
    pairs = interval_join(segments.select("session_id", "seq", "start", "end"), turns, "session_id", width)
    overlap = F.least("end", "r_end") - F.greatest("start", "r_start")
    best = pairs.withColumn("ov", overlap).where("ov > 0").groupBy("session_id", "seq").agg(F.max_by("r_speaker", F.struct("ov", -F.col("r_turn_idx"))).alias("speaker"))
    return segments.drop("speaker").join(best, ["session_id", "seq"], "left")


def _overlaps() -> Column:
    return (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))


def _alike_pairs(mic: DataFrame, system: DataFrame, text: str, width: float, slack: float, meets: Column, alike: Callable[[Column, Column], Column], least: float | None) -> DataFrame:
    """(session_id, seq) of mic rows that meet an alike system row. With least, the ratio that alike asks for, pairs that can't reach
    it by their lengths or their characters go before alike is asked."""
    if least is not None:
        mic, system = (t.withColumn("_chars", T.characters(F.col(text))) for t in (mic, system))
    pairs = interval_join(mic, system, "session_id", width, slack).where(meets)
    a, b = F.col(text), F.col(f"r_{text}")
    if least is not None:
        pairs = pairs.where(T.length_bound(a, b) >= least).where(T.ratio_bound(a, b, F.col("_chars"), F.col("r__chars")) >= least)
    return pairs.where(alike(a, b)).select("session_id", "seq").distinct()


def drop_bleed(segments: DataFrame, alike: Callable[[Column, Column], Column], width: float = 60.0, least: float | None = None) -> DataFrame:
    """segments without the microphone's that repeat a system segment of the same time: a left-anti interval join.

    alike(mic, system) gets normalised texts; least is given where it asks for a text_ratio of that or more. System segments always
    stay; empty normalised text is no bleed. The text test runs after the join and before the anti join, as a UDF can't stand in
    an anti join's condition."""
    normed = segments.withColumn("norm", T.normalize(F.col("text")))
    mic = normed.where("channel = 'mic' and norm <> ''").select("session_id", "seq", "start", "end", "norm")
    system = normed.where("channel = 'system'").select("session_id", "start", "end", "norm")
    bleed = _alike_pairs(mic, system, "norm", width, 0.0, _overlaps(), alike, least)
    return segments.join(bleed.withColumn("channel", F.lit("mic")), ["session_id", "seq", "channel"], "left_anti")


def duplication_rate(segments: DataFrame, alike: Callable[[Column, Column], Column], slack: float = 1.0, width: float = 60.0, least: float | None = None) -> DataFrame:
    """session_id, dup, total and pct: microphone segments with a like system segment within slack seconds (ends included)."""
    plain = segments.withColumn("plain", T.strip(F.lower("text")))
    mic = plain.where("channel = 'mic' and plain <> ''").select("session_id", "seq", "start", "end", "plain")
    system = plain.where("channel = 'system'").select("session_id", "start", "end", "plain")
    near = (F.col("r_end") >= F.col("start") - slack) & (F.col("r_start") <= F.col("end") + slack)
    hit = _alike_pairs(mic, system, "plain", width, slack, near, alike, least).withColumn("hit", F.lit(1))
    counted = mic.join(hit, ["session_id", "seq"], "left").groupBy("session_id").agg(F.count("hit").alias("dup"), F.count("*").alias("total"))
    return counted.withColumn("pct", 100.0 * F.col("dup") / F.greatest("total", F.lit(1)))


def first_match(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes first by `order`, found by an aggregate."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.min_by(whole, order).alias("_first")).select("_first.*")
