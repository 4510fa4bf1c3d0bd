"""Reports over the ledger: hash aggregates with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from razao.operators.ranking import dense_rank_desc
from razao.session import materialize


def _units(direction: str):
    return F.when(F.col("direction") == direction, F.col("amount_in_units")).otherwise(F.lit(0))


def monthly_summary(ledger: DataFrame) -> DataFrame:
    """Count and sum per month, direction and bank, with subtotals.

    The ledger is aggregated once at the finest grain; only that result is rolled up.
    `level` is 0 for a detail row, 1 without bank, 3 without direction, 7 for the total.
    """
    keys = ["month", "direction", "bank"]
    detail = (
        ledger.withColumn("month", F.trunc("date", "month"))
        .withColumn("bank", F.coalesce("bank_name", "source"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount_in_units").alias("u"))
    )
    return detail.rollup(*keys).agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("n").alias("transactions"),
        F.sum("u").alias("units"),
    )


def counterparty_totals(ledger: DataFrame) -> DataFrame:
    """Money exchanged with every counterparty, own transfers left out."""
    others = ledger.filter(
        F.col("counterparty_normalized").isNotNull() & F.col("own_transfer").isNull()
    )
    return (
        others.groupBy("counterparty_normalized")
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            F.sum(_units("in")).alias("in_units"),
            F.sum(_units("out")).alias("out_units"),
        )
        .withColumn("net_units", F.col("in_units") - F.col("out_units"))
        .withColumn("volume_units", F.col("in_units") + F.col("out_units"))
    )


def counterparty_ranking(ledger: DataFrame, **limits) -> DataFrame:
    """All counterparties with their dense rank by volume."""
    return dense_rank_desc(counterparty_totals(ledger), "volume_units", "rank", **limits)


def spending_clusters(ledger: DataFrame) -> DataFrame:
    """Transactions grouped by the stable part of their description."""
    units = F.col("amount_in_units")
    clustered = ledger.filter(F.col("description_normalized") != "")
    totals = (
        clustered.groupBy("description_normalized")
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            F.sum(units).alias("units"),
            F.min("date").alias("first_day"),
            F.max("date").alias("last_day"),
        )
        .withColumn("mean_units", F.col("units") / F.col("transactions"))
    )
    # The sample in an aggregate of its own: a string buffer would turn the sums into a sort aggregate.
    texts = clustered.select("description_normalized", "description").distinct()
    sample = texts.groupBy("description_normalized").agg(F.min("description").alias("sample"))
    return totals.join(sample, "description_normalized").select(
        "description_normalized", "transactions", "units", "first_day", "last_day", "sample", "mean_units"
    )


def recurring_patterns(ledger: DataFrame, min_days: int = 3) -> DataFrame:
    """Clusters seen on several days, with the gaps between days and the spread of amounts.

    Rows are first reduced to one per cluster and day, so the window over a cluster sees at
    most as many rows as the calendar has days, however many transactions a cluster holds.
    """
    units = F.col("amount_in_units")
    days = (
        ledger.filter(F.col("description_normalized") != "")
        .groupBy("description_normalized", "direction", "date")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(units).alias("u"),
            F.min(units).alias("low"), F.max(units).alias("high"),
        )
    )
    key = ["description_normalized", "direction"]
    before = F.lag("date").over(Window.partitionBy(*key).orderBy("date"))
    return (
        days.withColumn("gap", F.date_diff(F.col("date"), before))
        .groupBy(*key)
        .agg(
            F.sum("n").alias("transactions"),
            F.count(F.lit(1)).alias("days"),
            F.avg("gap").alias("mean_gap"),
            F.min("gap").alias("min_gap"),
            F.max("gap").alias("max_gap"),
            (F.sum("u") / F.sum("n")).alias("mean_units"),
            (F.max("high") - F.min("low")).alias("spread_units"),
        )
        .filter(F.col("days") >= min_days)
    )


def suspected_duplicates(ledger: DataFrame) -> DataFrame:
    """Groups of transactions with the same day, amount and direction."""
    return (
        ledger.groupBy("possible_duplicate_key", "date", "amount_in_units", "direction", "file_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("possible_duplicate_key", "date", "amount_in_units", "direction")
        .agg(F.sum("n").alias("transactions"), F.count(F.lit(1)).alias("files"))
        .filter("transactions > 1")
    )


def suspected_rows(ledger: DataFrame) -> DataFrame:
    """The transactions behind `suspected_duplicates`."""
    keys = materialize(suspected_duplicates(ledger).select("possible_duplicate_key"), "suspected")
    return ledger.join(keys, ["possible_duplicate_key"], "left_semi")
