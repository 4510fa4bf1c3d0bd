"""What a user sees of the ledger: projections, filters, order, pages, totals."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.fixed_values import PAGE_SIZE, PRECISION, SOURCE_LABELS
from razao.functions import money

SORT_KEYS = {"date": "data", "value": "amount_in_units"}


def transaction_view(ledger: DataFrame) -> DataFrame:
    """One row per transaction as shown; `amount_in_units` stays for exact work."""
    col = F.col
    signed = F.when(col("direction") == "in", col("amount_in_units")).otherwise(
        -col("amount_in_units")
    )
    return ledger.select(
        "id",
        col("date").alias("data"),
        F.when(col("direction") == "in", "entrada").otherwise("saida").alias("tipo"),
        F.coalesce("counterparty", "description").alias("destinatario"),
        col("description").alias("descricao"),
        money.to_decimal(signed).alias("valor"),
        F.coalesce("bank_name", "source").alias("banco_origem"),
        F.coalesce("own_transfer", F.lit(False)).alias("propria"),
        "amount_in_units",
    )


def filter_view(
    view: DataFrame,
    *,
    bank: str = "",
    kind: str = "",
    own: bool | None = None,
    min_value: float | str = 0,
    search: str = "",
) -> DataFrame:
    """The five controls of the table; an empty control filters nothing.

    Kind and least value compare stored columns, so they reach the Parquet scan.
    """
    if bank:
        view = view.filter(F.col("banco_origem") == bank)
    if kind in ("entrada", "saida"):
        view = view.filter(F.col("tipo") == kind)
    if own is not None:
        view = view.filter(F.col("propria") == F.lit(own))
    least = math.ceil(Decimal(str(min_value or 0)) * 10**PRECISION)
    if least > 0:
        view = view.filter(F.col("amount_in_units") >= F.lit(least))
    if search:
        wanted = F.lower(F.lit(search))
        view = view.filter(
            F.lower("destinatario").contains(wanted) | F.lower("descricao").contains(wanted)
        )
    return view


def sort_order(key: str, descending: bool) -> list[Column]:
    lead = F.col(SORT_KEYS[key])
    return [
        lead.desc() if descending else lead.asc(), F.col("data").desc(), F.col("id").desc()
    ]


def sort_view(view: DataFrame, key: str = "date", descending: bool = True) -> DataFrame:
    """By day or absolute value; ties keep the load order (newest first, then id)."""
    return view.orderBy(*sort_order(key, descending))


def page(
    view: DataFrame, number: int = 0, key: str = "date", descending: bool = True,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """One page of the sorted table, as a top-k instead of a full sort.

    The work grows with the offset; walk deep tables with `page_after`, or write them with `pages.write_pages`.
    """
    return sort_view(view, key, descending).offset(number * size).limit(size)


def page_after(
    view: DataFrame, last, key: str = "date", descending: bool = True, size: int = PAGE_SIZE
) -> DataFrame:
    """The page behind `last`, a row of the page before: any depth at the cost of one page."""
    lead, value = F.col(SORT_KEYS[key]), F.lit(last[SORT_KEYS[key]])
    day, row_id = F.lit(last["data"]), F.lit(last["id"])
    beyond = lead < value if descending else lead > value
    tie = (F.col("data") < day) | ((F.col("data") == day) & (F.col("id") < row_id))
    rest = view.filter(beyond | ((lead == value) & tie))
    return sort_view(rest, key, descending).limit(size)


def page_count(view: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    pages = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(size)))
    return view.agg(pages.cast("bigint").alias("pages"))


def totals_with_pages(view: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """The totals of a view and its number of pages, in one pass."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("transactions") / F.lit(size)))
    return totals(view).withColumn("pages", pages.cast("bigint"))


def totals(view: DataFrame) -> DataFrame:
    """Count, volume, money in and money out of a view, summed as integers."""
    units, zero = F.col("amount_in_units"), F.lit(0).cast("bigint")
    return view.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.coalesce(F.sum(units), zero).alias("volume_units"),
        F.coalesce(F.sum(F.when(F.col("tipo") == "entrada", units)), zero).alias("in_units"),
        F.coalesce(F.sum(F.when(F.col("tipo") == "saida", units)), zero).alias("out_units"),
    )


def summary_cards(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """The cards above the table. Both inputs of the join are single-row aggregates."""
    return totals(transaction_view(ledger)).crossJoin(
        files.agg(F.count(F.lit(1)).alias("files"))
    )


def file_view(files: DataFrame) -> DataFrame:
    col = F.col
    label = F.coalesce(
        *[F.when(col("source_type") == k, F.lit(v)) for k, v in SOURCE_LABELS.items()],
        F.lit(SOURCE_LABELS["generic"]),
    )
    noun = F.when(col("valid_row_count") == 1, "transação").otherwise("transações")
    meta = F.concat(label, F.lit(" · "), col("valid_row_count").cast("string"), F.lit(" "), noun)
    return files.select(
        "id",
        col("name").alias("nome"),
        meta.alias("meta"),
        F.when(col("ignored_row_count") > 0, "warn").otherwise("ok").alias("status"),
    )


def currency_totals(ledger: DataFrame) -> DataFrame:
    """Sums that never mix currencies or precisions."""
    units = F.col("amount_in_units")
    return ledger.groupBy("currency", "precision").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum(units).alias("volume_units"),
        F.sum(F.when(F.col("direction") == "in", units).otherwise(-units)).alias("net_units"),
    )


def single_total(ledger: DataFrame) -> DataFrame:
    """The one total of a ledger; refuses to add different currencies or precisions."""
    per_currency = currency_totals(ledger)
    if len(per_currency.limit(2).collect()) > 1:
        raise ValueError("amounts of different currencies or precisions cannot be added")
    return per_currency
