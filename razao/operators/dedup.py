"""Row and file de-duplication, and the rule that a bad row rejects its file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.operators.normalize import ROW_ERRORS
from razao.session import materialize


def first_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key.

    An aggregate rather than a window: copies of a hot key collapse inside each map task,
    and no task ever sees a whole group.
    """
    others = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("_first")
    return rows.groupBy(key).agg(first).select(key, "_first.*").select(*rows.columns)


def stored_keys(keys: DataFrame, stored: DataFrame, key: str, work: str | None = None) -> DataFrame:
    """Those of `keys` that occur in `stored`, each once.

    The keys are written first, so Spark knows their bytes: a small batch is broadcast to the
    scan of the stored table, which is then not shuffled; a large one takes a shuffle join.
    """
    keys = materialize(keys.select(key), "keys", work)
    return stored.select(key).join(keys, key, "left_semi").distinct()


def new_rows(
    rows: DataFrame, stored: DataFrame | None, key: str = "id", order: list[str] | None = None
) -> DataFrame:
    """Rows to accept: the first of each key in the batch whose key is not stored yet."""
    return split_rows(rows, stored, key, order)[0]


def split_rows(
    rows: DataFrame, stored: DataFrame | None, key: str = "id", order: list[str] | None = None,
    work: str | None = None, known_of: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and blocked rows: copies inside the batch, and rows stored before.

    Keys with copies are found by hash aggregates of narrow rows. Only rows of these keys go through the
    aggregate that picks the first one; all others are not shuffled as long as the keys with copies and the
    stored ones are few. `rows` is read several times: pass a written table. `work` is the folder for intermediate tables; the
    caller removes it when the results are written.
    `known_of` gives those of a table of keys that are stored, each once, as a written table, in place of a scan
    of `stored`.
    """
    order = order or ["file_path", "record_index"]
    copied = materialize(copied_keys(rows, key, work), "copied-keys", work)
    again = rows.join(copied, key, "left_semi")
    first = first_per_key(again, key, order)
    accepted = rows.join(copied, key, "left_anti").unionByName(first)
    later = again.join(first.select(key, *order).withColumn("_first", F.lit(True)), [key, *order], "left_anti")
    if known_of is None and stored is None:
        return accepted, later.select(*rows.columns)
    keys = rows.select(key)
    known = known_of(keys) if known_of else materialize(stored_keys(keys, stored, key, work), "known-keys", work)
    blocked = later.select(*rows.columns).unionByName(accepted.join(known, key, "left_semi").select(*rows.columns))
    return accepted.join(known, key, "left_anti"), blocked


def copied_keys(rows: DataFrame, key: str, work: str | None = None) -> DataFrame:
    """Keys of more than one row. Their 64-bit hashes are counted first; keys themselves are counted only
    where a hash occurs twice, so that few of them are shuffled."""
    hashed = rows.select(key, F.xxhash64(key).alias("_hash"))
    twice = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1").select("_hash")
    found = hashed.join(materialize(twice, "hashes", work), "_hash", "left_semi")
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1").select(key)


def file_summary(rows: DataFrame) -> DataFrame:
    """One row per file: facts of the file, row and error counts, first error.

    `rows` hold one empty row (null `record_index`) for a file without transactions.
    Strings are grouping keys and the error travels as a number, so this stays a hash
    aggregate with map-side partial results.
    """
    has_row = F.col("record_index").isNotNull()
    codes = F.array(*[F.lit(e) for e in ROW_ERRORS])
    code = F.when(has_row & F.col("error").isNotNull(), F.array_position(codes, F.col("error")))
    return (
        rows.groupBy("file_path", "file_name", "file_hash", "source", "file_error")
        .agg(
            F.count(F.when(has_row, 1)).alias("row_count"),
            F.count(code).alias("error_count"),
            F.min(code).alias("_code"),
            F.min("date").alias("first_day"),
            F.max("date").alias("last_day"),
        )
        .withColumn("row_error", F.get(codes, F.col("_code").cast("int") - 1))
        .drop("_code")
    )


def new_files(files: DataFrame, stored_hashes: DataFrame | None, work: str | None = None) -> DataFrame:
    """Mark files whose content is stored, or came earlier in the batch, as `repeated`."""
    first = files.groupBy("file_hash").agg(F.min("file_path").alias("file_path"))
    if stored_hashes is not None:
        known = stored_keys(first.select("file_hash"), stored_hashes, "file_hash", work)
        first = first.join(known, "file_hash", "left_anti")
    kept = first.select("file_path", F.lit(False).alias("repeated"))
    return files.join(kept, "file_path", "left").fillna(True, ["repeated"])


def without_bad_files(rows: DataFrame, file_key: str = "file_id") -> DataFrame:
    """Rows of the files that have no row with an error."""
    bad = materialize(rows.filter(F.col("error").isNotNull()).select(file_key).distinct(), "bad-files")
    return rows.join(bad, [file_key], "left_anti")
