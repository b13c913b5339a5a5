"""Speech models as table functions: a session's blocks go in, segments or turns come out, and what fails stays with its session.

No model is shipped. A model is a function `load` that gives another one from a session's samples to a list of tuples; it is
loaded once a Python worker. The table function takes a table of blocks, dealt by session and sorted by block: SQL may call it as
`select * from diarize(table(blocks) partition by session_id order by block_idx)`. A model takes a session's whole track, so one
session is one task's memory (4 bytes a sample).

A session on which loading or running fails gives one row that holds nothing but the session and the error."""

import functools
import logging
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from turnwise.sources.views import durable

log = logging.getLogger(__name__)

BLOCK = 4096
#: Columns that models give, after the session.
TURNS = "start double, end double, speaker int"
SEGMENTS = "start double, end double, text string, no_speech_prob double, compression_ratio double"


def blocks(track: DataFrame, size: int = BLOCK) -> DataFrame:
    """session_id, block_idx, samples: a track (session_id, idx, x) in blocks; places without a sample are silence."""
    at, cell = F.col("idx") % size, F.floor(F.col("idx") / size)
    cells = track.groupBy("session_id", cell.alias("block_idx")).agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int"), F.col("x").cast("float")))).alias("m"), F.max(at.cast("int")).alias("last"))
    last = track.groupBy("session_id").agg(F.max(cell).alias("end"))
    filled = F.transform(F.sequence(F.lit(0), F.when(F.col("block_idx") < F.col("end"), size - 1).otherwise(F.col("last"))), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0).cast("float")))
    return cells.join(last, "session_id").select("session_id", "block_idx", filled.alias("samples"))


@functools.lru_cache(8)
def _loaded(name: str, load: Callable):
    return load()


def table_function(load: Callable[[], Callable[[np.ndarray], list[tuple]]], columns: str, rate: int, expected: int | None = None) -> UserDefinedTableFunction:
    """The table function of a model. One that expects another rate than the track's fails on every session that has samples."""
    width, name = len(columns.split(",")), uuid.uuid4().hex

    class Model:
        def __init__(self):
            self.session, self.parts = None, []

        def eval(self, row: Row):
            self.session = row["session_id"]
            at = row["block_idx"]
            if self.parts and at != self.parts[-1][0] + 1:
                # whole blocks that are missing are silence
                self.parts.append((at - 1, np.zeros((at - 1 - self.parts[-1][0]) * len(self.parts[-1][1]), np.float32)))
            self.parts.append((at, np.asarray(row["samples"], np.float32)))

        def terminate(self):
            track = np.concatenate([p for _, p in self.parts]) if self.parts else np.empty(0, np.float32)
            if not len(track):
                return
            try:
                if expected not in (None, rate):
                    raise ValueError(f"the model expects {expected} Hz, got {rate}")
                found = [(self.session, *row, None) for row in _loaded(name, load)(track)]
                if any(len(row) != width + 2 for row in found):
                    raise ValueError(f"the model gave rows of other than {width} columns")
            except Exception as why:
                logging.getLogger(__name__).exception("a model failed on session %s", self.session)
                found = [(self.session, *[None] * width, f"{type(why).__name__}: {why}")]
            yield from found

    return F.udtf(Model, returnType=f"session_id long, {columns}, error string")


def run(model: UserDefinedTableFunction, track: DataFrame) -> DataFrame:
    """The model's rows for each session of a track (session_id, idx, x), with error."""
    return model(blocks(track).asTable().partitionBy("session_id").orderBy("block_idx"))


def register(spark: SparkSession, name: str, model: UserDefinedTableFunction) -> None:
    """Makes a model known to SQL."""
    spark.udtf.register(name, model)


def parted(found: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of run()'s result, which is computed once: failures are session_id and error, and their number is logged."""
    found = durable(found)
    failed = found.where("error is not null").select("session_id", "error")
    n = failed.count()
    if n:
        log.warning("%s failed for %d sessions; going on without it there", what, n)
    return found.where("error is null").drop("error"), failed


def smooth_turns(turns: DataFrame, least_on: float = 0.3, least_off: float = 0.5) -> DataFrame:
    """session_id, turn_idx, start, end, speaker: turns of one speaker less than least_off apart are one, and of what is then shorter
    than least_on nothing stays; numbered by start, end and speaker. A turn that ends before it starts is none."""
    own = Window.partitionBy("session_id", "speaker").orderBy("start", "end")
    ahead = own.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("start") - F.max("end").over(ahead)
    parts = turns.where(F.col("end") >= F.col("start")).withColumn("_new", F.coalesce((gap >= least_off).cast("int"), F.lit(0)))
    parts = parts.withColumn("_part", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy("session_id", "speaker", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("end") - F.col("start") >= least_on)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("start", "end", "speaker")) - 1
    return merged.select("session_id", place.alias("turn_idx"), "start", "end", "speaker")


def diarizer(load: Callable, rate: int, expected: int | None = None, least_on: float = 0.7, least_off: float = 0.5) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """A function from a track to its turns, smoothed, and to the sessions on which the model failed."""
    model = table_function(load, TURNS, rate, expected)

    def turns_of(track: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows, failed = parted(run(model, track), "diarizing")
        return smooth_turns(rows, least_on, least_off), failed

    return turns_of
