"""Running values over a session's order that no single task has to walk: the order is cut into cells, each cell is summed up, the
summaries are scanned (one row for SPAN rows), and every cell is passed over by itself with what the scan carries into it.

A session of 10^8 rows makes some 1,500 summaries and as many cells, which spread over all tasks."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows that a cell holds on average.
SPAN = 1 << 16


def _same(keys: list[str]) -> Column:
    """Keys equal to those of a table whose keys are prefixed; null is a key like others."""
    return reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))


def _prefixed(df: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return df.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *more)


def in_cells(rows: DataFrame, keys: list[str], at: str, span: int | None = None) -> DataFrame:
    """rows with _cell: equal parts of the range of the number `at` within keys, in its order, null first and NaN last.

    Cells hold about span rows where `at` is spread evenly, as times and places are; else they differ in size and stay right."""
    place = F.nanvl(F.col(at).cast("double"), F.lit(None).cast("double"))
    ranges = rows.groupBy(*keys).agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"), F.ceil(F.count(place) / (span or SPAN)).alias("_n"))
    joined = rows.join(_prefixed(ranges, keys, F.col("_lo"), F.col("_hi"), F.col("_n")), _same(keys))
    share = F.nanvl((F.col(at).cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0))
    cell = F.when(F.col(at).isNull(), -1).when(F.isnan(F.col(at).cast("double")), F.col("_n")).when(F.col("_hi") > F.col("_lo"), F.least(F.floor(share * F.col("_n")), F.col("_n") - 1)).otherwise(0)
    return joined.withColumn("_cell", cell.cast("long")).drop(*(f"_k_{k}" for k in keys), "_lo", "_hi", "_n")


def order(keys: list[str], *by: str | Column) -> WindowSpec:
    """A cell's own order."""
    return Window.partitionBy(*keys, "_cell").orderBy(*by)


def carried(rows: DataFrame, keys: list[str], scanned: DataFrame) -> DataFrame:
    """rows in cells with the columns of scanned, a row for each cell of keys."""
    more = [c for c in scanned.columns if c not in (*keys, "_cell")]
    right = _prefixed(scanned, keys, F.col("_cell").alias("_k_cell"), *(F.col(c) for c in more))
    return rows.join(right, _same(keys) & (F.col("_cell") == F.col("_k_cell"))).drop(*(f"_k_{k}" for k in keys), "_k_cell")


def before(keys: list[str]) -> WindowSpec:
    """The cells ahead of a cell."""
    return Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, keys: list[str], by: list[str], name: str, first: int = 1, span: int | None = None) -> DataFrame:
    """rows with their number in the order of `by`, from first; the leading column is a number, which deals them to cells."""
    cells = in_cells(rows, keys, by[0], span)
    sizes = cells.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    ahead = sizes.select(*keys, "_cell", F.coalesce(F.sum("_rows").over(before(keys)), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(order(keys, *by))
    return carried(cells, keys, ahead).withColumn(name, (own + F.col("_ahead") + (first - 1)).cast("long")).drop("_cell", "_ahead")
