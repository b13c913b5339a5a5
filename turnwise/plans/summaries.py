"""Hierarchical summaries of transcripts: pack lines into windows, summarise each, merge until one is left.

The model is pluggable: a Column function from a prompt's text to its summary, and one that counts tokens. The default
is extractive and deterministic, so plans can be tested; each level is one DataFrame transformation over all sessions."""

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from turnwise.functions.text import strip, word_count
from turnwise.sources.views import durable
from turnwise.operators import sessions


def first_words(text: Column, n: int = 20) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, n), " ")


#: What is asked of a model at each step; {transcript} stands for the text.
PROMPTS = {
    "final": "Summarise this meeting: decisions, open points, who does what.\n\n{transcript}",
    "map": "List the facts, decisions and tasks of this part of a meeting.\n\n{transcript}",
    "merge": "Join these notes on parts of one meeting; leave out what is said twice.\n\n{transcript}",
}


def prompt(template: str, body: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{transcript}"), body)


def guarded(complete: Callable[[str], str]) -> Callable[[Column], Column]:
    """A completion that gives null, with the error logged, for a text on which it fails: the transcript is then kept alone."""
    @pandas_udf("string")
    def tried(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return complete(text)
            except Exception:
                logging.getLogger(__name__).exception("no summary of a text")
                return None

        return texts.map(one)

    return tried


def lines_of(rows: DataFrame, text: str) -> DataFrame:
    """rows with line_no and line for each line of a text; lines of white space alone go, and line_no counts all."""
    ends = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    split = rows.select("*", F.posexplode(F.split(text, ends, -1)).alias("_at", "line"))
    return split.where(strip(F.col("line")) != "").withColumn("line_no", F.col("_at").cast("long")).drop("_at")


def write_notes(summaries: DataFrame, name: str, path: str) -> None:
    """A text file for each summary and a line end, in a folder of its name under path; null summaries write nothing."""
    rows = summaries.where("summary is not null").select(F.col(name).cast("string").alias("name"), F.col("summary").alias("value"))
    rows.write.partitionBy("name").mode("append").text(path)


def _joined(rows: DataFrame, sep: str) -> DataFrame:
    line = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy("session_id", "window_id").agg(F.array_join(F.transform(line, lambda x: x["line"]), sep).alias("body"))


def summarize(lines: DataFrame, context: int, max_out: int = 24, overhead: int = 4, complete: Callable[[Column], Column] = first_words, count: Callable[[Column], Column] = word_count, prompts: dict[str, str] | None = None) -> DataFrame:
    """session_id, summary, levels. lines: session_id, line_no, line; blank lines go.

    With prompts (PROMPTS, say), complete gets whole prompts, whose own tokens count where it is asked whether a text fits.
    A session that fits the context is summarised at once. Others are packed (two lines of overlap), summarised window by
    window, and their notes merged level by level; where packing would not shrink them, pairs are forced."""
    usable, budget = context - max_out - overhead, int(0.75 * (context - max_out - overhead))
    ask = lambda kind, body: complete(prompt(prompts[kind], body) if prompts else body)
    own = count(prompt(prompts["final"], F.lit(""))) if prompts else F.lit(0)
    rows = lines.where(strip(F.col("line")) != "").withColumn("n", count(F.col("line")).cast("long"))
    total = rows.groupBy("session_id").agg(F.sum("n").alias("total"))
    small = rows.join(total.where(F.col("total") + own <= usable), "session_id").withColumn("window_id", F.lit(0).cast("long"))
    done = _joined(small, "\n").select("session_id", ask("final", F.col("body")).alias("summary"), F.lit(0).alias("levels"))
    packed = sessions.pack(rows.join(total.where(F.col("total") + own > usable), "session_id").drop("total"), "session_id", "line_no", "n", budget)
    notes = _joined(sessions.with_overlap(packed, "session_id", "line_no"), "\n").select("session_id", F.col("window_id").alias("line_no"), ask("map", F.col("body")).alias("line"))
    notes, level = durable(notes), 1
    while not notes.isEmpty():
        notes = notes.withColumn("n", count(F.col("line")).cast("long"))
        sizes = notes.groupBy("session_id").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
        ready = sizes.where((F.col("k") == 1) | (F.col("total") + own <= usable)).select("session_id")
        last = _joined(notes.join(ready, "session_id").withColumn("window_id", F.lit(0).cast("long")), "\n\n")
        done = done.unionByName(last.select("session_id", ask("final", F.col("body")).alias("summary"), F.lit(level).alias("levels")))
        open_notes = notes.join(ready, "session_id", "left_anti")
        merged = sessions.pack(open_notes, "session_id", "line_no", "n", budget)
        windows = merged.groupBy("session_id").agg((F.max("window_id") + 1).alias("w"), F.count("*").alias("k"))
        pairs = F.when(F.col("w") >= F.col("k"), F.floor(F.col("line_no") / 2)).otherwise(F.col("window_id"))
        merged = merged.join(windows, "session_id").withColumn("window_id", pairs)
        notes = durable(_joined(merged, "\n\n").select("session_id", F.col("window_id").alias("line_no"), ask("merge", F.col("body")).alias("line")))
        level += 1
    return done
