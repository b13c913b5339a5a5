"""Timed views over the driver's tables, which hold no audio: segments, turns, blocks, tracks and frames by fixed rules."""

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    start = F.col("turn") * 20.0
    return c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("seq"), F.when(F.col("role") == "user", "mic").otherwise("system").alias("channel"),
        start.alias("start"), (start + F.length("text") / 15.0).alias("end"), "text",
        ((F.col("conv_id") * 7 + F.col("turn") * 13) % 100 / 100.0).alias("no_speech_prob"), (1.0 + (F.col("conv_id") + F.col("turn") * 3) % 20 / 10.0).alias("compression_ratio"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of 25 s, three speakers in turn, eight a session."""
    slots = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct().withColumn("turn_idx", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return slots.select("session_id", "turn_idx", (F.col("turn_idx") * 25.0).alias("start"), (F.col("turn_idx") * 25.0 + 25.0).alias("end"), (F.col("turn_idx") % 3).alias("speaker"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return e.select(F.col("user_id").alias("session_id"), i.alias("i"), (F.col("value") / 1000.0).alias("mic"), F.when((F.col("event_type") == "view") & (F.col("value") > 20), F.col("value") / 10000.0).alias("system"))


def track(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == event_type)
    idx = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return e.select(F.col("user_id").alias("session_id"), idx.alias("idx"), (F.col("value") / 100.0).alias("x"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir; a temporary one where none is set and the master is local)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="turnwise-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
