"""Ranks over a whole table without putting the table into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from razao.session import materialize

ONE_TASK_ROWS = 100_000


def dense_rank_desc(
    df: DataFrame, column: str, alias: str = "rank", one_task_rows: int = ONE_TASK_ROWS
) -> DataFrame:
    """Dense rank of `column`, largest first.

    The input, usually an aggregate of a much larger table, is written once. Up to `one_task_rows` rows are ranked by a plain window. Beyond, the distinct values are
    range-partitioned and written once, ranked inside each range, and shifted by the number
    of values in the ranges above.
    """
    df = materialize(df, "rank-input")
    if df.count() <= one_task_rows:  # of a written table: read from its footers
        return df.withColumn(alias, F.dense_rank().over(Window.orderBy(F.col(column).desc())))
    value = F.col(column)
    ranges = materialize(
        df.select(column).distinct()
        .repartitionByRange(value.desc())
        .withColumn("_range", F.spark_partition_id()),
        "rank-ranges",
    )
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").count()  # one row per shuffle partition
    offsets = sizes.select(
        "_range", F.coalesce(F.sum("count").over(above), F.lit(0)).alias("_above")
    )
    inside = Window.partitionBy("_range").orderBy(value.desc())
    ranks = (
        ranges.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, "_range")
        .select(column, (F.col("_above") + F.col("_inside")).cast("int").alias(alias))
    )
    return df.join(ranks, [column], "inner")
