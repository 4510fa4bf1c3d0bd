"""Text keys as Column expressions (no UDF on the default path)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from razao.fixed_values import (
    COUNTERPARTY_CAPTURE_PATTERN,
    COUNTERPARTY_PREFIX_PATTERN,
    COUNTERPARTY_STOP_TERMS,
    EMOJI_PATTERN,
    OWN_TRANSFER_STRONG_TERMS,
    WHITESPACE_CHARS,
    WHITESPACE_CLASS,
)

_MARKS = "[\u0300-\u036f]"


def _java(pattern: str) -> str:
    """A pattern with the wide white-space class and the narrow dot in Java's syntax."""
    narrow = pattern.replace("(.+?)", r"([^\n\r\u2028\u2029]+?)")
    return narrow.replace(r"\s", WHITESPACE_CLASS)


@lru_cache(maxsize=1)
def _accent_map() -> tuple[str, str]:
    """Characters whose canonical decomposition, less its accents, is one other character."""
    accented, plain = [], []
    for code in range(0x80, 0x30000):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or not unicodedata.decomposition(char):
            continue
        base = [c for c in unicodedata.normalize("NFD", char) if not "\u0300" <= c <= "\u036f"]
        if len(base) == 1 and base[0] != char:
            accented.append(char)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def trim(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE_CHARS))


def collapse(col: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(col, f"{WHITESPACE_CLASS}+", " "))


def blank_to_null(col: Column) -> Column:
    """Null for the empty string; evaluates its argument once, unlike a comparison."""
    return F.get(F.array_remove(F.array(col), ""), 0)


def strip_accents(col: Column) -> Column:
    """Base letters for accented ones; ASCII text, the common case, is passed through."""
    accented, plain = _accent_map()
    mapped = F.regexp_replace(F.translate(col, accented, plain), _MARKS, "")
    return F.when(F.octet_length(col) == F.char_length(col), col).otherwise(mapped)


@F.pandas_udf(StringType())
def strip_accents_exact(values: pd.Series) -> pd.Series:
    """Full canonical decomposition, also for scripts the character map cannot express
    (Hangul, kana with voicing marks). Opt-in: needed only for legacy fingerprints."""
    return values.str.normalize("NFD").str.replace(_MARKS, "", regex=True)


def fold(col: Column, *, exact: bool = False) -> Column:
    """Lower case without accents: the common first step of all keys."""
    return F.lower(strip_accents_exact(col) if exact else strip_accents(col))


def cluster_of_folded(folded: Column) -> Column:
    text = F.regexp_replace(folded, EMOJI_PATTERN, "")
    # (?=[0-9]) leaves most characters before the slow look behind them
    text = F.regexp_replace(text, r"(?=[0-9])(?<![a-z0-9_])[0-9]{3,}+(?![a-z0-9_])", "")
    return words_of_folded(text)


def words_of_folded(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def party_of_words(words: Column) -> Column:
    stop = r"\b(?:" + "|".join(COUNTERPARTY_STOP_TERMS) + r")\b"
    left = F.regexp_replace(F.regexp_replace(words, stop, " "), " +", " ")
    return blank_to_null(F.trim(left))


def own_of_words(description_words: Column, counterparty_words: Column) -> Column:
    words = F.concat_ws(" ", description_words, counterparty_words)
    return F.when(words.rlike("|".join(OWN_TRANSFER_STRONG_TERMS)), F.lit(True))


def identity_text(col: Column, *, exact: bool = False) -> Column:
    """Text as it enters a row's identity: no accents, lower case, single blanks."""
    return collapse(fold(col, exact=exact))


def cluster_key(col: Column) -> Column:
    """Description without the parts that vary between visits to the same merchant."""
    return cluster_of_folded(fold(col))


def plain_words(col: Column) -> Column:
    """Lower-case ASCII letters and digits, separated by single blanks."""
    return words_of_folded(fold(col))


def captured_name(trimmed: Column) -> Column:
    """Name before a masked or plain tax number, empty if there is none.

    Texts without a hyphen before a digit or bullet are not searched at all.
    """
    pattern = "(?iu)" + _java(COUNTERPARTY_CAPTURE_PATTERN)
    candidate = trimmed.rlike(rf"-{WHITESPACE_CLASS}*[•0-9]")
    return F.when(candidate, F.regexp_extract(trimmed, pattern, 1)).otherwise("")


def remaining_name(trimmed: Column) -> Column:
    """What is left of a description without its kind, its second part and its remark."""
    ws = WHITESPACE_CLASS
    name = F.regexp_replace(trimmed, "(?iu)" + _java(COUNTERPARTY_PREFIX_PATTERN), "")
    name = F.get(F.split(name, f"{ws}+-{ws}+", 2), 0)
    name = F.regexp_replace(name, rf"{ws}*+\([^)]*\){ws}*\z", "")
    return blank_to_null(collapse(F.btrim(name, F.lit("-" + WHITESPACE_CHARS))))


def name_of(trimmed: Column, captured: Column) -> Column:
    return F.when(captured != "", blank_to_null(trim(captured))).otherwise(
        remaining_name(trimmed)
    )


def counterparty_name(col: Column) -> Column:
    """Name of the person or company inside a raw description; null if none is left."""
    trimmed = trim(col)
    return name_of(trimmed, captured_name(trimmed))


def counterparty_key(col: Column) -> Column:
    """Key under which a counterparty's transactions are grouped; null if only noise."""
    return party_of_words(plain_words(col))


def own_transfer(description: Column, counterparty: Column) -> Column:
    """True for transfers between own accounts, else null (never false)."""
    return own_of_words(plain_words(description), plain_words(counterparty))
