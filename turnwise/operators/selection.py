"""Exact order statistics by selection: a histogram of each key's values, then only the bin that holds the rank.

Unlike percentile() and median(), which keep a key's distinct values in one hash table, and collect_list, nothing grows with a
key's rows but what is sorted on disk: histograms have BINS rows a key, and equal values of a bin are counted before they meet."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def ranked(rows: DataFrame, key: str, value: str, ranks: list[Column], bins: int = BINS) -> DataFrame:
    """key and v0, v1, ...: the values at ranks (from 0, expressions of n, a key's number of values). Null and NaN don't count."""
    v = F.col(value).cast("double")
    real = rows.where(v.isNotNull() & ~F.isnan(v)).select(F.col(key).alias("_key"), v.alias("_v"))
    ranges = real.groupBy("_key").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n"))
    ranges = ranges.select(F.col("_key").alias("_k"), "_lo", "_hi", "n")
    share = F.nanvl((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0))
    binned = real.join(ranges, F.col("_key").eqNullSafe(F.col("_k"))).select("_key", "_v", F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0).alias("_bin"))
    below = F.sum("_c").over(Window.partitionBy("_key").orderBy("_bin")) - F.col("_c")
    histogram = binned.groupBy("_key", "_bin").agg(F.count("*").alias("_c")).withColumn("_below", below)
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), r.cast("long").alias("r")) for i, r in enumerate(ranks))))
    asked = histogram.join(ranges.select("_k", "n"), F.col("_key").eqNullSafe(F.col("_k"))).select(F.col("_key").alias("_k"), F.col("_bin").alias("_b"), "_below", "_c", wanted.alias("_w"))
    asked = asked.where((F.col("_w.r") >= F.col("_below")) & (F.col("_w.r") < F.col("_below") + F.col("_c")))
    bins_of = asked.select("_k", "_b", "_below").distinct()
    counts = binned.join(bins_of, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_bin") == F.col("_b"))).groupBy("_key", "_bin", "_below", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_key", "_bin").orderBy("_v")) + F.col("_below")
    placed = counts.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c")).drop("_below", "_c")
    picked = placed.join(asked.select("_k", "_b", "_w"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_bin") == F.col("_b"))).where((F.col("_w.r") >= F.col("_from")) & (F.col("_w.r") < F.col("_to")))
    return picked.groupBy(F.col("_key").alias(key)).agg(*(F.max(F.when(F.col("_w.i") == i, F.col("_v"))).alias(f"v{i}") for i in range(len(ranks))))


def median(rows: DataFrame, key: str, value: str, bins: int = BINS) -> DataFrame:
    """key and median, the mean of the middle two."""
    n = F.col("n")
    found = ranked(rows, key, value, [F.floor((n - 1) / 2), F.floor(n / 2)], bins)
    return found.select(key, ((F.col("v0") + F.col("v1")) / 2).alias("median"))


def upper_median(rows: DataFrame, key: str, value: str, bins: int = BINS) -> DataFrame:
    """key and upper_median, the upper of the middle two."""
    return ranked(rows, key, value, [F.floor(F.col("n") / 2)], bins).withColumnRenamed("v0", "upper_median")
