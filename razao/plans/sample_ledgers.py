"""Ledgers derived from order and event tables, as staged rows and as statement files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.functions.text import counterparty_name
from razao.operators.normalize import normalize
from razao.schema import STAGING

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows cost much work each; how it is split is the session's
    `spark.sql.files.maxPartitionBytes`."""
    return table(spark, sf_dir, name)


def brazilian(amount: Column) -> Column:
    """A number as Brazilian statements print it."""
    return F.translate(F.format_number(amount, 2), ",.", ".,")


def plain(amount: Column) -> Column:
    return amount.cast("decimal(18,2)").cast("string")


def as_staging(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Staged rows from named expressions; columns that are not named are null."""
    return rows.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in STAGING.fields
    ])


def orders_with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = wide_table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))


def order_direction() -> Column:
    return F.when(F.col("o_orderstatus") == "F", "in").otherwise("out")


def order_description() -> Column:
    return F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string"))


def orders_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey").cast("string")
    return as_staging(orders_with_customers(spark, sf_dir), {
        "file_path": nation,
        "file_name": nation,
        "source": F.lit("generic"),
        "record_index": F.col("o_orderkey"),
        "source_row_id": F.concat(F.lit("row-"), F.col("o_orderkey").cast("string")),
        "date_raw": F.date_format("o_orderdate", "dd/MM/yyyy"),
        "amount_raw": brazilian(F.col("o_totalprice")),
        "description": order_description(),
        "direction": order_direction(),
        "counterparty": counterparty_name(F.concat(F.lit("Pix enviado - "), F.col("c_name"))),
        "bank_name": F.col("c_mktsegment"),
    })


def orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a transaction; the customer's nation stands for the file."""
    rows = normalize(orders_staging(spark, sf_dir)).filter(F.col("error").isNull())
    return rows.withColumn("file_id", F.col("file_path"))


def event_direction() -> Column:
    return F.when(F.col("event_type").isin("signup", "purchase"), "in").otherwise("out")


def events_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    return as_staging(wide_table(spark, sf_dir, "events"), {
        "file_path": F.col("event_type"),
        "file_name": F.col("event_type"),
        "source": F.lit("generic"),
        "record_index": F.col("event_id"),
        "source_row_id": F.concat(F.lit("row-"), F.col("event_id").cast("string")),
        "date_raw": F.date_format("ts", ISO_MILLIS),
        "amount_raw": plain(F.col("value")),
        "description": F.concat_ws(" ", "event_type", F.lit("user"), user),
        "direction": event_direction(),
        "counterparty": F.concat(F.lit("User "), user),
    })


def events_ledger(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Every event with a value as a transaction; the event type stands for the file."""
    rows = normalize(events_staging(spark, sf_dir), date_format=None, **options)
    return rows.filter(F.col("error").isNull()).withColumn("file_id", F.col("file_path"))


def lineitem_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    supplier = F.col("l_suppkey").cast("string")
    return as_staging(wide_table(spark, sf_dir, "lineitem"), {
        "file_path": supplier,
        "file_name": supplier,
        "source": F.lit("generic"),
        "record_index": F.col("l_orderkey"),
        "source_row_id": F.concat(F.lit("row-"), line),
        "date_raw": F.date_format("l_shipdate", "dd/MM/yyyy"),
        "amount_raw": brazilian(F.col("l_extendedprice")),
        "description": F.concat_ws(" ", F.lit("Peça"), F.col("l_partkey").cast("string")),
        "direction": F.when(F.col("l_returnflag") == "R", "in").otherwise("out"),
        "counterparty": F.concat(F.lit("Pix enviado - Fornecedor "), supplier),
        "bank_name": F.lit("Inter"),
    })


def write_inter_statements(spark: SparkSession, sf_dir: str, path: str, rows_per_file: int) -> None:
    """Orders as Inter statements: each output file carries its own header line."""
    (
        wide_table(spark, sf_dir, "orders")
        .select(
            F.date_format("o_orderdate", "dd/MM/yyyy").alias("Data Lançamento"),
            F.when(F.col("o_orderstatus") == "F", "Pix recebido").otherwise("Pix enviado")
            .alias("Histórico"),
            order_description().alias("Descrição"),
            brazilian(
                F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
                .otherwise(-F.col("o_totalprice"))
            ).alias("Valor"),
            F.lit("0,00").alias("Saldo"),
        )
        .write.option("header", True).option("sep", ";").option("escape", '"')
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def write_nubank_statements(
    spark: SparkSession, sf_dir: str, path: str, rows_per_file: int
) -> None:
    """All events as Nubank statements, with quoted separators, quotes and line breaks."""
    signed = F.when(event_direction() == "in", F.col("value")).otherwise(-F.col("value"))
    text = F.concat(
        F.lit('Transferência "'), F.col("event_type"), F.lit('",\nevento '),
        F.col("event_id").cast("string"),
    )
    (
        wide_table(spark, sf_dir, "events")
        .select(
            F.date_format("ts", "dd/MM/yyyy").alias("Data"),
            plain(signed).alias("Valor"),
            F.concat(F.lit("id-"), F.col("event_id").cast("string")).alias("Identificador"),
            text.alias("Descrição"),
        )
        .write.option("header", True).option("escape", '"')
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (file, number, line) as one text file for each `file`, in the order of the numbers; added to the folder."""
    placed = lines.repartition("file").sortWithinPartitions("file", "number")
    placed.select("file", "line").write.mode("append").partitionBy("file").text(path)


def write_flawed_statements(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Events by type and orders by status as statements whose lines are not all transactions.

    Views have three cells, clicks no amount, and the errors end inside quotes; orders that are open
    have a text for an amount, those in part no date.
    """

    def file_of(header: str, rows: DataFrame, last: DataFrame) -> DataFrame:
        files = rows.select("file").distinct()
        head = files.select("file", F.lit(-1).cast("bigint").alias("number"), F.lit(header).alias("line"))
        return head.unionByName(rows).unionByName(last)

    type_, id_ = F.col("event_type"), F.col("event_id").cast("string")
    amount = F.when(type_ == "click", "").otherwise(plain(F.col("value")))
    cells = F.concat_ws(",", F.date_format("ts", "dd/MM/yyyy"), amount, F.concat(F.lit("id-"), id_))
    line = F.when(type_ == "view", cells).otherwise(F.concat(cells, F.lit(",Compra "), id_))
    events = wide_table(spark, sf_dir, "events").select(
        type_.alias("file"), F.col("event_id").cast("bigint").alias("number"), line.alias("line")
    )
    open_quote = events.filter("file = 'error'").groupBy("file").agg((F.max("number") + 1).alias("number")).withColumn(
        "line", F.lit('"aberta')
    )
    write_lines(file_of("Data,Valor,Identificador,Descrição", events, open_quote), path)

    status = F.col("o_orderstatus")
    cells = F.concat_ws(
        ";", F.when(status == "P", " ").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")), F.lit("Pix"),
        order_description(), F.when(status == "O", "a combinar").otherwise(brazilian(F.col("o_totalprice"))),
    )
    orders = wide_table(spark, sf_dir, "orders").select(
        status.alias("file"), F.col("o_orderkey").cast("bigint").alias("number"), cells.alias("line")
    )
    write_lines(file_of("Data Lançamento;Histórico;Descrição;Valor", orders, orders.limit(0)), path)
