"""Staged statement rows to transactions: one projection, no shuffle, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from razao.fixed_values import CURRENCY, PRECISION, STATEMENT_DATE_FORMAT
from razao.functions import dates, identity, money, text

# Why a row is no valid transaction, in the order in which they are reported.
ROW_ERRORS = (
    "date_empty",
    "date_invalid",
    "amount_empty",
    "amount_without_digits",
    "amount_invalid",
    "amount_zero",
    "direction_invalid",
    "amount_sign_conflict",
    "amount_out_of_range",
)


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A one-row generator: unlike those of a projection, its expressions are not copied into
    the filters and projections above, where nested ones would multiply.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline(F.array(made)))


def normalize(
    staging: DataFrame,
    *,
    date_format: str | None = STATEMENT_DATE_FORMAT,
    negative_means_outflow: bool = True,
    decimal_separator: str | None = None,
    fingerprint: bool = False,
) -> DataFrame:
    """Add the transaction columns and `error`, the reason a row is no valid transaction.

    Bad rows are kept and marked; whether they cost their whole file is decided later.
    Amount, date, error and the folded texts are computed once per row. The text keys are plain
    projections on top, so a query that does not use a key does not pay for it.
    """
    col = F.col
    parsed = compute_once(staging, {
        "_digits": money.amount_digits(col("amount_raw")),
        "_parts": dates.date_parts(col("date_raw"), date_format),
        "_given": text.blank_to_null(col("direction")),
        "description": F.coalesce(col("description"), F.lit("")),
    })
    valued = compute_once(parsed, {
        "_value": money.amount_value(col("_digits"), decimal_separator),
        "date": dates.day_of_parts(col("_parts"), date_format),
    })
    rounded = compute_once(valued, {
        "amount_in_units": money.to_units(col("_value")),
        "direction": F.coalesce(
            col("_given"), money.signed_direction(col("_value"), negative_means_outflow)
        ),
    })
    checked = compute_once(rounded, {
        "error": F.coalesce(
            dates.date_error(col("date_raw"), col("date")),
            money.amount_error(col("amount_raw"), col("_digits"), col("_value")),
            money.direction_error(col("_value"), col("_given")),
            F.when(col("amount_in_units").isNull(), "amount_out_of_range"),
        ),
    })
    return _with_keys(checked, fingerprint).drop(
        "_digits", "_parts", "_given", "_value", "date_raw", "amount_raw"
    )


def _with_keys(rows: DataFrame, fingerprint: bool) -> DataFrame:
    col = F.col
    day_amount = (col("date"), col("amount_in_units"), col("direction"))
    folded = compute_once(rows, {
        "_folded": text.fold(col("description"), exact=fingerprint),
        "_party_words": text.plain_words(col("counterparty")),
    })
    keyed = folded.withColumns({
        "description_normalized": text.cluster_of_folded(col("_folded")),
        "counterparty_normalized": text.party_of_words(col("_party_words")),
        "own_transfer": text.own_of_words(
            text.words_of_folded(col("_folded")), col("_party_words")
        ),
        "_identity": identity.identity_string(
            *day_amount, text.collapse(col("_folded")), col("source_row_id")
        ),
    })
    return keyed.withColumns({
        "id": identity.content_key(col("_identity")),
        "possible_duplicate_key": identity.content_key(identity.suspicion_string(*day_amount)),
        "currency": F.lit(CURRENCY),
        "precision": F.lit(PRECISION),
        "fingerprint": identity.fnv_fingerprint(col("_identity"))
        if fingerprint
        else F.lit(None).cast("string"),
    }).drop("_folded", "_party_words", "_identity")
