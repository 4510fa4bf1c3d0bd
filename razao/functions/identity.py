"""Content identity of a transaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from razao.fixed_values import FNV_OFFSET_BASIS, FNV_PRIME
from razao.functions.dates import day_millis


def _day_amount(day: Column, units: Column, direction: Column) -> list[Column]:
    return [day_millis(day).cast("string"), units.cast("string"), direction]


def identity_string(
    day: Column, units: Column, direction: Column, text: Column, source_row_id: Column
) -> Column:
    """What makes a row itself; `text` is `identity_text` of the description."""
    return F.concat_ws("|", *_day_amount(day, units, direction), text, source_row_id)


def suspicion_string(day: Column, units: Column, direction: Column) -> Column:
    return F.concat_ws("|", *_day_amount(day, units, direction))


def content_key(serialized: Column) -> Column:
    return F.sha2(serialized, 256)


def fnv_fingerprint(serialized: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units as `fp_` and 8 hex digits.

    Kept for comparison with old ledgers only: 32 bits collide at scale, so rows are
    de-duplicated on `content_key`.
    """

    def absorb(state: Column, unit: Column) -> Column:
        mixed = state.bitwiseXOR(unit) * F.lit(FNV_PRIME).cast("bigint")
        return mixed.bitwiseAND(F.lit(0xFFFFFFFF))

    def step(state: Column, char: Column) -> Column:
        point = F.ascii(char).cast("bigint")
        above = point - F.lit(0x10000)
        high = F.lit(0xD800) + F.shiftright(above, 10)
        low = F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))
        return F.when(point < 0x10000, absorb(state, point)).otherwise(
            absorb(absorb(state, high), low)
        )

    state = F.aggregate(F.split(serialized, ""), F.lit(FNV_OFFSET_BASIS).cast("bigint"), step)
    return F.concat(F.lit("fp_"), F.lpad(F.lower(F.hex(state)), 8, "0"))
