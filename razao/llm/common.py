"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from razao.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The whole input row in one struct column `row`, so that no name of the input can clash; and columns made from it."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(row, *[c.alias(name) for name, c in more.items()])


def root_bins(rows: int) -> int:
    """About the square root of a row count: as many bins as rows in a bin."""
    return max(1, int(rows**0.5))


def running_total(
    df: DataFrame, group: list[str], bin_: str, order: list[Column], value: Column, out: str
) -> DataFrame:
    """Sum of `value` over the rows before each one, within `group`, in the order of `bin_`, then `order`.

    `bin_` must not decrease along the order. No task sees a whole group: windows run inside one
    bin, and over one sum for each bin.
    """
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_bin", F.col(bin_)).withColumn("_value", value)
    sums = rows.groupBy(*group, "_bin").agg(F.sum("_value").alias("_sum"))
    if not group:  # one row for each bin, of which there are about the root of the row count
        before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "_bin", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    here = rows.withColumn("_here", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return (
        here.join(starts, [*group, "_bin"])
        .withColumn(out, F.col("_start") + F.col("_here"))
        .drop("_bin", "_value", "_start", "_here")
    )


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the cluster's shared folder."""
    return materialize(df, f"llm-{label}")
