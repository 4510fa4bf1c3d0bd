"""Table schemas and the template of a generic statement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RAW = T.StructType([
    T.StructField("linha_original", T.StringType()),
    T.StructField("index_no_arquivo", T.LongType()),
    T.StructField("arquivo_fonte", T.StringType()),
])

# One statement row before normalization, with the facts of its file. Rows with a defect are no transactions.
STAGING = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_hash", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("file_error", T.StringType()),
    T.StructField("record_index", T.LongType()),
    T.StructField("source_row_id", T.StringType()),
    T.StructField("date_raw", T.StringType()),
    T.StructField("amount_raw", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("counterparty", T.StringType()),
    T.StructField("bank_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("raw", RAW),
    T.StructField("defect", T.StringType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("file_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("amount_in_units", T.LongType()),
    T.StructField("currency", T.StringType()),
    T.StructField("precision", T.IntegerType()),
    T.StructField("direction", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("description_normalized", T.StringType()),
    T.StructField("source_row_id", T.StringType()),
    T.StructField("counterparty", T.StringType()),
    T.StructField("counterparty_normalized", T.StringType()),
    T.StructField("bank_name", T.StringType()),
    T.StructField("own_transfer", T.BooleanType()),
    T.StructField("category", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("possible_duplicate_key", T.StringType()),
    T.StructField("raw", RAW),
])

# One imported file; a version of this table is the ledger's list of visible rows. `folder` is where its rows
# are now, `batch_id` the import that brought them.
FILES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("uploaded_at", T.TimestampType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("valid_row_count", T.LongType()),
    T.StructField("ignored_row_count", T.LongType()),
    T.StructField("template_id", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("batch_id", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("deleted", T.BooleanType()),
])

# One zone of stored rows: the days it spans.
ZONES = T.StructType([
    T.StructField("folder", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("first_day", T.DateType()),
    T.StructField("last_day", T.DateType()),
    T.StructField("rows", T.LongType()),
])

REPORT = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("total_count", T.LongType()),
    T.StructField("new_count", T.LongType()),
    T.StructField("duplicate_count", T.LongType()),
    T.StructField("rejected_count", T.LongType()),
    T.StructField("defect_count", T.LongType()),
])

# What is wrong with a file or one of its records, although the file was read.
DEFECTS = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("defect", T.StringType()),
    T.StructField("record_index", T.LongType()),
    T.StructField("text", T.StringType()),
])


@dataclass(frozen=True)
class ImportTemplate:
    """How to read a bank's CSV that has no reader of its own."""

    id: str
    name: str
    date_column: str
    description_column: str
    amount_column: str | None = None
    credit_column: str | None = None
    debit_column: str | None = None
    counterparty_column: str | None = None
    delimiter: str = ","
    header_row_index: int = 0
    date_format: str = "dd/MM/yyyy"
    decimal_separator: str = ","
    negative_means_outflow: bool = True

    def __post_init__(self) -> None:
        if self.delimiter not in (",", ";", "\t"):
            raise ValueError(f"unsupported delimiter: {self.delimiter!r}")
        if self.decimal_separator not in (",", "."):
            raise ValueError(f"unsupported decimal separator: {self.decimal_separator!r}")
        if not self.amount_column and not (self.credit_column and self.debit_column):
            raise ValueError("give amount_column, or credit_column and debit_column")
