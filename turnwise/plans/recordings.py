"""The offline pass over recordings: measure the echo, cancel it where it is worth it, transcribe, label, interleave, render."""

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import intervals, segments, signal, spectral
from turnwise.sources.views import durable

log = logging.getLogger(__name__)


def clean_microphone(mic: DataFrame, system: DataFrame, rate: int, limit: float = signal.SHARPNESS, measure: dict | None = None, cancel: dict | None = None, frame: int = signal.ERLE_FRAME) -> tuple[DataFrame, DataFrame]:
    """The microphone's track without echo, on its own timeline, and a report a session.

    The microphone trails the system channel by a lag that is measured; sessions in which no echo path stands out are left as
    they are. The report has spectral.echo_delay's columns, lag_ms, erle_db (over frames of `frame` samples; null where nothing was cancelled) and
    `weak`, whether cancelling removed nothing measurable."""
    knobs = cancel or {}
    both = signal.align_common(mic, system)
    delays = durable(spectral.echo_delay(both, limit, rate=rate, **(measure or {})))
    lags = delays.where("cancel").select("session_id", F.col("lag").cast("long").alias("lag"))
    late = both.select("session_id", "idx", "system").join(lags, "session_id").select("session_id", (F.col("idx") + F.col("lag")).alias("idx"), "system", "lag")
    aligned = both.select("session_id", "idx", "mic").join(late, ["session_id", "idx"])
    cleaned = durable(spectral.cancel_echo(aligned.select("session_id", "idx", "mic", "system"), **knobs))
    place = (F.col("idx") - F.col("lag")).alias("idx")
    tracks = [aligned.select("session_id", place, F.col(c).alias("x")) for c in ("mic", "system")]
    erle = signal.erle(*tracks, cleaned.join(lags, "session_id").select("session_id", place, "x"), frame, knobs.get("ratio", signal.DTD))
    report = delays.withColumn("lag_ms", signal.milliseconds(F.col("lag"), rate)).join(erle, "session_id", "left").withColumn("weak", F.coalesce(F.col("erle_db") <= 0, F.lit(False)))
    return signal.reassembled(mic, cleaned), report


def optional(stage: Callable[[], DataFrame], otherwise: DataFrame, name: str) -> DataFrame:
    """What stage() plans, or otherwise, with the error logged, if it can't be planned (a model that is missing, say). Errors
    of running tasks aren't seen here: models.table_function and, for texts, summaries.guarded keep those by session or text."""
    try:
        return stage()
    except Exception:
        log.exception("%s failed; going on without it", name)
        return otherwise


def process_recordings(mic: DataFrame, system: DataFrame, rate: int, transcribe: Callable[[DataFrame], DataFrame], diarize: Callable | None = None, use_aec: bool = True, labeled: bool = True, **knobs) -> DataFrame:
    """session_id and transcript of every session of the two tracks (session_id, idx, x).

    transcribe makes segments (session_id, seq, start, end, text, no_speech_prob, compression_ratio) of a track; diarize makes turns
    (session_id, turn_idx, start, end, speaker) of the system's, or a pair of turns and failed sessions, as models.diarizer does.
    Segments of sessions that it fails on, or all if it can't be had, stay unlabelled. A session without samples in one track is
    neither cancelled nor left out."""
    clean = clean_microphone(mic, system, rate, **knobs)[0] if use_aec else mic
    own, other = (segments.drop_hallucinations(transcribe(track)) for track in (clean, system))
    plain = other.withColumn("speaker", F.lit(None).cast("string"))
    if diarize:
        def named():
            found = diarize(system)
            turns = found[0] if isinstance(found, tuple) else found
            return intervals.assign_speakers(other, turns).withColumn("speaker", F.when(F.col("speaker").isNotNull(), T.speaker_label(F.col("speaker"))))

        plain = optional(named, plain, "diarizing")
    spoken = durable(segments.add_segments(own.withColumn("speaker", F.lit(None).cast("string")), plain))
    kept = intervals.drop_bleed(spoken, lambda a, b: T.text_ratio(a, b) >= 0.6, least=0.6)
    return segments.render(kept, mic.select("session_id").union(system.select("session_id")), labeled)
