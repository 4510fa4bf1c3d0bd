"""Any page of a large sorted table at the cost of one range of it.

The sorted table is written once, dealt into ranges of its order, with a small table of how many rows lie
before each range. A row knows its place in its range, so a page names the ranges it overlaps and the places
there, and only its own rows are sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from razao.operators.views import PAGE_SIZE, sort_order

#: Rows of a range: few enough to sort for one page, many enough for a file.
RANGE_ROWS = 250_000
#: Most ranges of a table: their borders come from a sample that passes through the driver and grows with them.
MOST_RANGES = 512
_PLACE = (1 << 33) - 1  # the bits of Spark's increasing id that count the rows of a task


def write_pages(
    view: DataFrame, folder: str, key: str = "date", descending: bool = True, range_rows: int = RANGE_ROWS
) -> PagedTable:
    """Deal a view into ranges of its order at `folder`.

    The order is total (value, day, id), so rows of one hot value or day fill many ranges. The view is
    read three times (count, borders, rows) and shuffled once: pass one that is cheap to read. Tables of more
    than `MOST_RANGES` ranges get larger ranges; inside one, rows lie by their place, which row groups are skipped by.
    """
    spark = view.sparkSession
    order = sort_order(key, descending)
    ranges = min(MOST_RANGES, max(1, -(-view.count() // range_rows)))
    dealt = view.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    placed = dealt.sortWithinPartitions("_range", *order).withColumn(
        "_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))
    )
    placed.write.mode("errorifexists").partitionBy("_range").parquet(f"{folder}/rows")
    sizes = spark.read.schema("_range int").parquet(f"{folder}/rows").groupBy("_range").agg(F.count("*").alias("rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.withColumn("above", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    starts.write.mode("errorifexists").parquet(f"{folder}/starts")
    return PagedTable(spark, folder, view.schema, key, descending)


class PagedTable:
    """A view dealt into ranges by `write_pages`; other sessions open it with the same key and direction."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str = "date", descending: bool = True) -> None:
        self.folder, self.order = folder, sort_order(key, descending)
        ranged = T.StructType([
            *schema.fields, T.StructField("_place", T.LongType()), T.StructField("_range", T.IntegerType()),
        ])
        self.rows = spark.read.schema(ranged).parquet(f"{folder}/rows")
        self.starts = spark.read.schema("_range int, rows long, above long").parquet(f"{folder}/starts")

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """The same rows as `views.page`; the driver sees the ranges of one page, at most one for each of its rows."""
        first = number * size
        met = self.starts.filter((F.col("above") < first + size) & (F.col("above") + F.col("rows") > first)).collect()
        rows = self.rows.filter(F.col("_range").isin([r["_range"] for r in met]))
        here = [
            (F.col("_range") == r["_range"]) & F.col("_place").between(first - r.above, first + size - 1 - r.above) for r in met
        ]
        rows = rows.filter(reduce(Column.__or__, here, F.lit(False)))
        return rows.drop("_place", "_range").orderBy(*self.order).limit(size)
