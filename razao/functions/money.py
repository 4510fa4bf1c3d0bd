"""Money as integer minor units; every function is a Column expression."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from razao.fixed_values import CURRENCY_SYMBOLS, PRECISION, WHITESPACE_CHARS
from razao.functions.text import blank_to_null

DECIMAL = "decimal(38,10)"


def amount_digits(raw: Column) -> Column:
    """Digits and separators of an amount, with a leading '-' if it is negative.

    Negative means: a '-' anywhere, or the whole amount in parentheses.
    """
    packed = F.translate(raw, WHITESPACE_CHARS, "")
    negative = packed.contains("-") | (packed.startswith("(") & packed.endswith(")"))
    digits = F.regexp_replace(packed, "[^0-9.,]", "")
    return F.when(negative, F.concat(F.lit("-"), digits)).otherwise(digits)


def amount_value(digits: Column, decimal_separator: str | None = None) -> Column:
    """Decimal value of `amount_digits`, null if it is not a number.

    Without a given decimal separator: of two kinds of separators the last one is the
    decimal one; a single separator is decimal before one or two digits, else it groups
    thousands; a repeated separator groups thousands.
    """
    if decimal_separator == ",":
        plain = F.translate(digits, ",.", ".")
    elif decimal_separator == ".":
        plain = F.translate(digits, ",", "")
    else:
        plain = (
            F.when(digits.rlike(r"^-?[0-9]*[.,][0-9]{1,2}$"), F.translate(digits, ",", "."))
            .when(digits.rlike(r"^-?[0-9]*[.,]$"), F.lit(None).cast("string"))
            .when(
                digits.contains(",") & digits.contains("."),
                F.when(digits.rlike(r"^-?[0-9.]+,[0-9]*$"), F.translate(digits, ",.", ".")).when(
                    digits.rlike(r"^-?[0-9,]+\.[0-9]*$"), F.translate(digits, ",", "")
                ),
            )
            .otherwise(F.translate(digits, ".,", ""))
        )
    return plain.try_cast(DECIMAL)


def parse_amount(raw: Column, decimal_separator: str | None = None) -> Column:
    return amount_value(amount_digits(raw), decimal_separator)


def amount_error(raw: Column, digits: Column, value: Column) -> Column:
    """Why an amount cannot become a transaction, null if it can."""
    return (
        F.when(raw.isNull() | (F.translate(raw, WHITESPACE_CHARS, "") == ""), "amount_empty")
        .when(~digits.rlike("[0-9]"), "amount_without_digits")
        .when(value.isNull(), "amount_invalid")
        .when(value == 0, "amount_zero")
    )


def signed_direction(value: Column, negative_means_outflow: bool = True) -> Column:
    low, high = ("out", "in") if negative_means_outflow else ("in", "out")
    return F.when(value < 0, low).when(value > 0, high)


def direction_error(value: Column, direction: Column) -> Column:
    """A given direction must be known and must not contradict a minus sign."""
    return F.when(~direction.isin("in", "out"), "direction_invalid").when(
        (direction == "in") & (value < 0), "amount_sign_conflict"
    )


def to_units(value: Column, precision: int = PRECISION) -> Column:
    """Positive integer minor units, null if nothing is left after rounding or it overflows."""
    units = F.round(F.abs(value) * F.lit(10**precision), 0).try_cast("bigint")
    return F.when(units > 0, units)


def to_decimal(units: Column, precision: int = PRECISION) -> Column:
    return (units.cast("decimal(38,0)") / F.lit(10**precision)).cast(f"decimal(38,{precision})")


def to_display(units: Column, precision: int = PRECISION) -> Column:
    return to_decimal(units, precision).cast("string")


def format_money(units: Column, currency: Column, precision: int = PRECISION) -> Column:
    """Amount as Brazilian readers write it, for example 'R$ 1.234,56'."""
    symbols = F.create_map(*[F.lit(x) for x in chain.from_iterable(CURRENCY_SYMBOLS.items())])
    number = F.translate(F.format_number(to_decimal(F.abs(units), precision), precision), ",.", ".,")
    sign = F.when(units < 0, "-").otherwise("")
    symbol = F.coalesce(F.element_at(symbols, currency), currency)
    return F.concat(sign, symbol, F.lit("\u00a0"), number)


def format_view_amount(value: Column) -> Column:
    """Absolute amount of a view row, always in Reais."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(F.abs(value), 2), ",.", ".,"))


__all__ = [
    "amount_digits", "amount_error", "amount_value", "blank_to_null", "direction_error",
    "format_money", "format_view_amount", "parse_amount", "signed_direction", "to_decimal",
    "to_display", "to_units",
]
