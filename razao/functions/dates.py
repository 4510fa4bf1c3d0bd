"""Statement dates as Column expressions; days are UTC days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from razao.fixed_values import DAY_MILLIS
from razao.functions.text import trim

# The accepted date formats and the order of their parts.
DATE_FORMATS = {
    "dd/MM/yyyy": ("day", "month", "year"),
    "MM/dd/yyyy": ("month", "day", "year"),
    "yyyy-MM-dd": ("year", "month", "day"),
}
_PARTS = r"^[0-9]{2,4}[/-][0-9]{2}[/-][0-9]{2,4}$"
_ISO_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_ISO_TIME = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?"
    r"(Z|[+-][0-9]{2}:?[0-9]{2})?$"
)


def date_parts(raw: Column, date_format: str | None = None) -> Column:
    """The three parts of a date string in the order they are written, null if it has not
    the shape of `date_format`; without a format, of an ISO day or moment."""
    text = trim(raw)
    if date_format is None:
        utc = F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone())
        moment = F.when(text.rlike(_ISO_TIME), F.to_date(utc))
        day = F.when(text.rlike(_ISO_DAY), text).otherwise(moment.cast("string"))
        return F.split(day, "-")
    return F.when(text.rlike(_PARTS), F.split(text, "[/-]"))


def day_of_parts(parts: Column, date_format: str | None = None) -> Column:
    """The day, null if the calendar has none; years below 100 are refused."""
    names = DATE_FORMATS[date_format or "yyyy-MM-dd"]
    year, month, day = (parts[names.index(name)] for name in ("year", "month", "day"))
    day_number = day.try_cast("int")
    text = F.concat_ws(
        "-", F.lpad(year, 4, "0"), month, F.lpad(day_number.cast("string"), 2, "0")
    )
    return F.when(
        (year.try_cast("int") >= 100) & day_number.between(1, 31), text.try_cast("date")
    )


def parse_date(raw: Column, date_format: str | None = None) -> Column:
    """Day of a date string, null if it is invalid, or ambiguous without a format."""
    if date_format is not None and date_format not in DATE_FORMATS:
        raise ValueError(f"unsupported date format: {date_format}")
    return day_of_parts(date_parts(raw, date_format), date_format)


def date_error(raw: Column, day: Column) -> Column:
    return F.when(raw.isNull() | (trim(raw) == ""), "date_empty").when(
        day.isNull(), "date_invalid"
    )


def day_millis(day: Column) -> Column:
    """Epoch milliseconds at the day's UTC midnight."""
    return F.unix_date(day).cast("bigint") * F.lit(DAY_MILLIS)


def day_of_millis(millis: Column) -> Column:
    """UTC day of an epoch-millisecond moment."""
    return F.date_from_unix_date(F.floor(millis / F.lit(DAY_MILLIS)).cast("int"))


def display_date(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")
