"""Filters over segments, and transcripts from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import scan

NO_SPEECH, COMPRESSION = 0.6, 2.4


def _above(name: str, limit: float) -> Column:
    """Strictly above; null counts as 0 and NaN is not above anything."""
    value = F.coalesce(F.col(name), F.lit(0.0))
    return ~F.isnan(value) & (value > limit)


def is_hallucination(no_speech: float = NO_SPEECH, compression: float = COMPRESSION) -> Column:
    text = F.col("text")
    return _above("no_speech_prob", no_speech) | _above("compression_ratio", compression) | T.is_cjk_junk(text) | T.in_blocklist(text)


def drop_hallucinations(segments: DataFrame, no_speech: float = NO_SPEECH, compression: float = COMPRESSION) -> DataFrame:
    return segments.where(~is_hallucination(no_speech, compression))


def add_segments(mic: DataFrame, system: DataFrame) -> DataFrame:
    """Both channels as one table; texts are stripped and empty ones go."""
    both = mic.withColumn("channel", F.lit("mic")).unionByName(system.withColumn("channel", F.lit("system")), allowMissingColumns=True)
    return both.withColumn("text", T.strip(F.col("text"))).where("text <> ''")


def interleave(segments: DataFrame) -> DataFrame:
    """With pos, a session's order by start, channel, seq; seq decides ties."""
    return scan.numbered(segments, ["session_id"], ["start", "channel", "seq"], "pos")


def transcript_line(labeled: bool = True) -> Column:
    stamp = F.concat(F.lit("`["), T.format_timestamp(F.col("start")), F.lit("]`"))
    label = F.concat(F.lit(" **"), T.segment_label(F.col("channel"), F.col("speaker")), F.lit("**: ")) if labeled else F.lit(" ")
    return F.concat(stamp, label, F.col("text"))


def render(segments: DataFrame, sessions: DataFrame | None = None, labeled: bool = True) -> DataFrame:
    """session_id and transcript, the session's lines in order as markdown; sessions without segments get the heading alone."""
    line = F.struct("start", "channel", "seq", transcript_line(labeled).alias("line"))
    lines = segments.groupBy("session_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    lines = lines if sessions is None else sessions.select("session_id").distinct().join(lines, "session_id", "left")
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n\n")
    return lines.select("session_id", F.concat(F.lit("# Transcript\n"), F.when(F.size("l") > 0, F.concat(F.lit("\n"), body, F.lit("\n"))).otherwise("")).alias("transcript"))


def session_header(started: Column, ended: Column) -> Column:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    seconds = F.unix_timestamp(ended.cast("timestamp")) - F.unix_timestamp(started.cast("timestamp"))
    return F.concat(F.lit("**Started:** "), stamp(started), F.lit("  \n**Ended:** "), stamp(ended), F.lit("  \n**Duration:** "), T.format_duration(seconds), F.lit("\n\n"))


def final_document(header: Column, summary: Column, transcript: Column) -> Column:
    return F.concat(header, F.coalesce(F.concat(summary, F.lit("\n\n---\n\n")), F.lit("")), transcript)


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """With unique_name: the second of a name gets -2, the third -3 and so on."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), k.cast("string"))))
