"""The registered queries: every operator of the library over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.functions import csv, dates, identity, money, text
from razao.operators import analytics, views
from razao.operators.dedup import file_summary, new_files, new_rows, split_rows, without_bad_files
from razao.operators.normalize import normalize
from razao.operators.occurrence import with_occurrence_ids
from razao.operators.pages import write_pages
from razao.plans import sample_ledgers as sample
from razao.plans.importer import import_batch, import_staged
from razao.plans.sample_ledgers import events_ledger, orders_ledger, table, wide_table
from razao.schema import ImportTemplate
from razao.session import materialize, scratch_root
from razao.sources import files as source_files
from razao.sources import statements
from razao.sources.store import LedgerStore
from razao.streaming.arrivals import follow_folder

Query = Callable[[SparkSession, str], DataFrame]
col = F.col
ROWS_PER_FILE = 5000
#: Files of a table offered to the stream, unless they would be too large to be read whole.
STREAMED_FILES, MOST_ROWS_PER_FILE = 15, 300_000


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files behind the orders ledger: one per nation that has customers."""
    return table(spark, sf_dir, "customer").select("c_nationkey").distinct()


# -- totals and views --------------------------------------------------------------------


def summary_cards(spark, sf_dir):
    return views.summary_cards(orders_ledger(spark, sf_dir), order_files(spark, sf_dir))


def monthly_totals(spark, sf_dir):
    """Flagship: staged rows, normalized, de-duplicated, summed per month."""
    rows = normalize(sample.orders_staging(spark, sf_dir)).filter(col("error").isNull())
    rows = rows.select("id", "file_path", "record_index", "date", "amount_in_units", "direction")
    kept = new_rows(materialize(rows, "ledger"), None).withColumn("month", F.trunc("date", "month"))
    units = col("amount_in_units")
    return kept.groupBy("month").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum(F.when(col("direction") == "in", units).otherwise(F.lit(0))).alias("in_units"),
        F.sum(F.when(col("direction") == "out", units).otherwise(F.lit(0))).alias("out_units"),
    )


FILTERS = {
    "bank": "BUILDING", "kind": "saida", "own": False, "min_value": "1500.50", "search": "uRGent",
}


def filtered_view(spark, sf_dir):
    view = views.filter_view(views.transaction_view(orders_ledger(spark, sf_dir)), **FILTERS)
    return view.drop("amount_in_units").withColumn("valor", col("valor").cast("double"))


def own_transfers_view(spark, sf_dir):
    """Orders of low priority as transfers between own accounts; the table without them."""
    own = F.when(
        col("description").startswith("5-LOW"), F.concat(F.lit("Transferência entre contas "), "description")
    ).otherwise(col("description"))
    rows = normalize(sample.orders_staging(spark, sf_dir).withColumn("description", own))
    view = views.filter_view(views.transaction_view(rows.filter(col("error").isNull())), own=False)
    return view.select("data", "descricao", "propria", "amount_in_units")


def filtered_totals(spark, sf_dir):
    view = views.filter_view(
        views.transaction_view(orders_ledger(spark, sf_dir)), kind="entrada", search="customer#0000"
    )
    return views.totals_with_pages(view)


def _shown(view: DataFrame) -> DataFrame:
    return view.select("id", "data", "amount_in_units")


def table_page(spark, sf_dir):
    view = views.transaction_view(orders_ledger(spark, sf_dir))
    return _shown(views.page(view, 3, key="value"))


def table_page_by_date(spark, sf_dir):
    view = views.transaction_view(orders_ledger(spark, sf_dir))
    return _shown(views.page(view, 0, descending=False))


def table_page_after(spark, sf_dir):
    """The second page, found from the last row of the first one."""
    view = views.transaction_view(orders_ledger(spark, sf_dir))
    first = _shown(views.page(view, 0)).orderBy(col("data"), col("id")).first()
    return _shown(views.page_after(view, first))


def table_page_of_range(spark, sf_dir):
    """A page far down, from the one range of the sorted table that holds it."""
    view = _shown(views.transaction_view(orders_ledger(spark, sf_dir)))
    folder = f"{scratch_root(spark)}/pages-{uuid.uuid4().hex}"
    return write_pages(view, folder, "value", descending=False, range_rows=1000).page(61)


def newest_first(spark, sf_dir):
    """The whole table, newest first."""
    view = views.transaction_view(orders_ledger(spark, sf_dir))
    return views.sort_view(view).select("id", "data", "tipo", "destinatario", "banco_origem")


def file_overview(spark, sf_dir):
    ledger = orders_ledger(spark, sf_dir)
    per_file = ledger.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(F.when(col("amount_in_units") >= 100000, 1)).alias("valid_row_count"),
    )
    files = per_file.select(
        col("file_id").alias("id"),
        F.concat(F.lit("extrato-"), col("file_id"), F.lit(".csv")).alias("name"),
        F.when(col("file_id").cast("int") < 8, "inter")
        .when(col("file_id").cast("int") < 16, "nubank").otherwise("generic").alias("source_type"),
        "valid_row_count",
        (col("row_count") - col("valid_row_count")).alias("ignored_row_count"),
    )
    return views.file_view(files)


def currency_totals(spark, sf_dir):
    """Totals per currency, the currency given by the region of the customer."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), col("n_regionkey") == col("r_regionkey")
    ).select(
        col("n_nationkey").cast("string").alias("file_id"),
        F.when(col("r_name") == "AMERICA", "USD").when(col("r_name") == "EUROPE", "EUR")
        .otherwise("BRL").alias("currency"),
    )
    ledger = orders_ledger(spark, sf_dir).drop("currency")
    return views.currency_totals(
        ledger.join(nations, ["file_id"], "inner")
    )


def money_display(spark, sf_dir):
    ledger = orders_ledger(spark, sf_dir)
    units = col("amount_in_units")
    return ledger.select(
        col("source_row_id"),
        money.to_display(units).alias("display"),
        money.format_money(units, col("currency")).alias("local"),
        money.format_view_amount(money.to_decimal(units)).alias("shown"),
        dates.display_date(col("date")).alias("shown_date"),
    )


# -- scalar expressions ------------------------------------------------------------------


def money_parse_formats(spark, sf_dir):
    price = col("l_extendedprice")
    brazilian = sample.brazilian(price)
    items = wide_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.explode(F.array(
            F.struct(F.lit("pt").alias("style"), F.concat(F.lit("R$ "), brazilian).alias("raw")),
            F.struct(F.lit("en").alias("style"), F.format_number(price, 2).alias("raw")),
            F.struct(F.lit("paren").alias("style"), F.concat(F.lit("("), brazilian, F.lit(")"))
                     .alias("raw")),
            F.struct(F.lit("minus").alias("style"), F.concat(F.lit("- "), brazilian).alias("raw")),
        )).alias("amount"),
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "amount.*")
    valued = items.withColumn("digits", money.amount_digits(col("raw"))).withColumn(
        "value", money.amount_value(col("digits"))
    )
    return valued.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "style",
        money.to_units(col("value")).alias("units"),
        money.signed_direction(col("value")).alias("direction"),
    )


def date_parse_formats(spark, sf_dir):
    day = col("o_orderdate")
    orders = wide_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.parse_date(F.date_format(day, "dd/MM/yyyy"), "dd/MM/yyyy").alias("br"),
        dates.parse_date(F.date_format(day, "MM-dd-yyyy"), "MM/dd/yyyy").alias("us"),
        dates.parse_date(F.date_format(day, "yyyy-MM-dd"), "yyyy-MM-dd").alias("iso"),
        dates.parse_date(F.date_format(day, sample.ISO_MILLIS)).alias("moment"),
        dates.parse_date(F.date_format(day, "dd/MM/yyyy")).alias("ambiguous"),
        dates.parse_date(F.date_format(day, "'31'/MM/yyyy"), "dd/MM/yyyy").alias("day_31"),
    )
    return orders.withColumn("millis", dates.day_millis(col("br")))


def event_days(spark, sf_dir):
    millis = F.unix_millis(col("ts").cast("timestamp"))
    return wide_table(spark, sf_dir, "events").select(
        "event_id", dates.day_of_millis(millis).alias("day"),
        dates.day_millis(dates.day_of_millis(millis)).alias("day_ms"),
    )


def identity_texts(spark, sf_dir):
    return wide_table(spark, sf_dir, "documents").select(
        "doc_id", text.identity_text(col("text")).alias("key")
    )


def cluster_keys(spark, sf_dir):
    return wide_table(spark, sf_dir, "documents").select(
        "doc_id", text.cluster_key(col("text")).alias("key")
    )


def text_safety(spark, sf_dir):
    pages = wide_table(spark, sf_dir, "pages").select(
        "page_id", col("html").alias("description"), text.cluster_key(col("html")).alias("key"),
        text.counterparty_key(col("html")).alias("party"),
    )
    unsafe = '[<>"()]'
    return pages.select(
        "page_id", "key", "party",
        (col("key").rlike(unsafe) | F.coalesce(col("party"), F.lit("")).rlike(unsafe))
        .alias("unsafe"),
    )


def counterparty_keys(spark, sf_dir):
    nation = F.col("c_nationkey").cast("string")
    raw = F.concat(
        F.when(col("o_orderstatus") == "F", "Transferência recebida pelo Pix - ")
        .when(col("o_orderstatus") == "O", "PIX enviado - ").otherwise("Compra no débito "),
        col("c_name"),
        F.when(col("o_orderstatus") == "F", F.concat(F.lit(" - •••.000.000-•• - BCO "), nation))
        .when(col("o_orderstatus") == "O", " (Transferência enviada)").otherwise("   Ltda"),
    )
    rows = sample.orders_with_customers(spark, sf_dir).select("o_orderkey", raw.alias("raw"))
    named = rows.withColumn("name", text.counterparty_name(col("raw")))
    return named.select(
        "o_orderkey", "name", text.counterparty_key(col("name")).alias("key"),
        text.counterparty_key(col("raw")).alias("raw_key"),
    )


def own_transfer_flag(spark, sf_dir):
    orders = wide_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(col("o_orderpriority") == "5-LOW", "Transferência  entre CONTAS")
        .otherwise(sample.order_description()).alias("description"),
        F.when(col("o_orderpriority") == "1-URGENT", "Conta própria").alias("counterparty"),
    )
    return orders.select(
        "o_orderkey", text.own_transfer(col("description"), col("counterparty")).alias("own")
    )


def row_identity(spark, sf_dir):
    return events_ledger(spark, sf_dir).select("source_row_id", "id", "possible_duplicate_key")


def row_identity_fnv(spark, sf_dir):
    return events_ledger(spark, sf_dir, fingerprint=True).select("source_row_id", "fingerprint")


# -- sources -----------------------------------------------------------------------------


def _records(rows: DataFrame, source: str, headers: list[str], delimiter: str) -> DataFrame:
    """Records of the readers' shape from one CSV line per row."""
    return rows.select(
        F.lit(source).alias("file_path"), F.lit(source).alias("file_name"),
        F.lit(None).cast("string").alias("file_hash"), F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("file_error"),
        F.lit(0).cast("bigint").alias("header_line"),
        F.array(*[F.lit(h) for h in headers]).alias("headers"),
        "record_index",
        csv.split_fields(col("line"), F.lit(delimiter)).alias("fields"),
    )


def inter_line_roundtrip(spark, sf_dir):
    orders = wide_table(spark, sf_dir, "orders")
    sign = F.when(col("o_orderstatus") == "F", "").otherwise("-")
    line = F.concat_ws(
        ";", F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("Pix "), sample.order_description(),
        F.concat(sign, sample.brazilian(col("o_totalprice"))), F.lit("0,00"),
    )
    headers = ["data lancamento", "historico", "descricao", "valor", "saldo"]
    lines = orders.select(col("o_orderkey").alias("record_index"), line.alias("line"))
    rows = normalize(statements.statement_rows(_records(lines, "inter", headers, ";")))
    return rows.select(
        "record_index", "date", "amount_in_units", "direction", "description", "bank_name", "error"
    )


def nubank_line_roundtrip(spark, sf_dir):
    events = wide_table(spark, sf_dir, "events")
    signed = F.when(sample.event_direction() == "in", col("value")).otherwise(-col("value"))
    line = F.concat_ws(
        ",", F.date_format("ts", "dd/MM/yyyy"), sample.plain(signed),
        F.concat(F.lit("id-"), col("event_id").cast("string")),
        F.concat(F.lit('"Compra, ""'), col("event_type"), F.lit('""\nuser '),
                 col("user_id").cast("string"), F.lit('"')),
    )
    headers = ["data", "valor", "identificador", "descricao"]
    lines = events.select(col("event_id").alias("record_index"), line.alias("line"))
    rows = normalize(statements.statement_rows(_records(lines, "nubank", headers, ",")))
    return rows.select("record_index", "date", "amount_in_units", "direction", "description", "error")


def generic_line_roundtrip(spark, sf_dir):
    template = ImportTemplate(
        id="parts", name="Peças", delimiter="\t", date_column="Dia", description_column="Peça",
        credit_column="Crédito", debit_column="Débito", date_format="yyyy-MM-dd",
        decimal_separator=".",
    )
    credit = col("l_returnflag") == "R"
    amount = F.format_number("l_extendedprice", 2)
    line = F.concat_ws(
        "\t", F.date_format("l_shipdate", "yyyy-MM-dd"), col("l_partkey").cast("string"),
        F.when(credit, amount).otherwise(""), F.when(credit, "").otherwise(amount),
    )
    lines = wide_table(spark, sf_dir, "lineitem").select(
        (col("l_orderkey") * 10 + col("l_linenumber")).alias("record_index"), line.alias("line")
    )
    records = _records(lines, "generic", ["dia", "peca", "credito", "debito"], "\t")
    rows = normalize(
        statements.generic_rows(records, template), date_format=template.date_format,
        decimal_separator=template.decimal_separator,
    )
    return rows.groupBy("record_index", "date", "description", "direction", "error").agg(
        F.sum("amount_in_units").alias("units"), F.count(F.lit(1)).alias("lines")
    )


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape of whole files."""
    return wide_table(spark, sf_dir, "documents").select(
        col("doc_id").cast("string").alias("file_path"), "source", "lang",
        col("doc_id").cast("string").alias("file_name"),
        csv.clean_text(col("text")).alias("text"),
    ).withColumn("file_hash", F.sha2("text", 256))


def detect_dialect(spark, sf_dir):
    """Dialect and delimiter of every document, taken as a file with a Nubank header if it
    is English and an Inter header if it is French."""
    header = (
        F.when(col("lang") == "en", "Data,Valor,Identificador,Descrição\n")
        .when(col("lang") == "fr", "Extrato\nDATA LANÇAMENTO;Valor\n").otherwise("")
    )
    files = _document_files(spark, sf_dir).withColumn("text", F.concat(header, col("text")))
    return statements.detect_files(files.drop("source", "lang")).select(
        "file_path", "source_type", "confidence", "delimiter"
    )


def detect_header_lines(spark, sf_dir):
    """Dialect and first line of the table of files made of documents.

    English: a Nubank table whose last row says "data lançamento". French: the document as the preamble
    of an Inter table, which also names an identifier. German: marks in prose alone. Spanish: none.
    """
    movement = "\nData Lançamento;Histórico;Descrição;Valor\n01/01/2024;Pix;Ana;1,00"
    marked = (
        F.when(col("lang") == "en", F.concat(
            F.lit("Data,Valor,Identificador,Descrição\n"), F.regexp_replace("text", "[,;\t]", " "),
            F.lit("\n02/01/2024,-9.00,id-1,data lançamento")))
        .when(col("lang") == "fr", F.concat(F.lit("Identificador;77\n"), "text", F.lit(movement)))
        .when(col("lang") == "de", F.concat("text", F.lit("\no identificador da conta")))
        .otherwise(col("text"))
    )
    files = _document_files(spark, sf_dir).withColumn("text", marked)
    return source_files.with_header(files.drop("source", "lang")).select(
        "file_path", F.coalesce("source", F.lit("unknown")).alias("source_type"), "header_line", "file_error"
    )


def byte_order_marks(spark, sf_dir):
    """Documents with a byte-order mark and carriage returns as a spreadsheet writes them, cleaned."""
    written = F.concat(F.lit("\ufeff"), F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return wide_table(spark, sf_dir, "documents").select("doc_id", F.sha2(csv.clean_text(written), 256).alias("hash"))


def blank_files(spark, sf_dir):
    """Which documents hold no record at all, once English ones have lost their letters."""
    spaced = F.when(col("lang") == "en", F.translate("text", "".join(map(chr, range(33, 0x250))), " ")).otherwise(col("text"))
    return wide_table(spark, sf_dir, "documents").select("doc_id", csv.is_empty(spaced).alias("is_empty"))


def file_preview(spark, sf_dir):
    """The first three records of every document read as a file with tab-separated cells.

    A quote that does not begin a cell is an ordinary character.
    """
    template = ImportTemplate(
        id="doc", name="doc", delimiter="\t", date_column="d", description_column="t",
        amount_column="a",
    )
    files = _document_files(spark, sf_dir).withColumn(
        "text", F.concat(F.lit("linha\n"), "text")
    ).drop("source", "lang")
    first = source_files.preview(source_files.file_records(files, template), 3)
    return first.select(
        "file_path", "record_index", F.concat_ws("\t", "fields").alias("line")
    )


def encoding_fallback(spark, sf_dir):
    """Texts that fit ISO-8859-1 stored in it, all others in UTF-8, read back by 'auto'."""
    fits = col("text").rlike(r"\A[\x{00}-\x{FF}]*+\z")
    stored = wide_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(fits, F.encode(F.when(fits, col("text")), "ISO-8859-1"))
        .otherwise(F.encode("text", "UTF-8")).cast("string").alias("bytes"),
    )
    return stored.select(
        "doc_id", F.sha2(source_files.decode_text(col("bytes"), "auto"), 256).alias("hash")
    )


# -- de-duplication ----------------------------------------------------------------------


def dedup_reimport(spark, sf_dir):
    """A second import that repeats the stored purchases and errors among all events, and
    every row of the batch twice."""
    rows = events_ledger(spark, sf_dir).select(
        "id", "file_id", "file_path", "record_index", "amount_in_units"
    )
    stored = rows.filter(col("file_id").isin("purchase", "error")).select("id")
    batch = materialize(rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))), "batch")
    accepted = new_rows(batch, stored, order=["file_path", "record_index", "copy"])
    totals = batch.groupBy("file_id").agg(F.count(F.lit(1)).alias("total_count"))
    new = accepted.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("new_count"), F.sum("amount_in_units").alias("new_units")
    )
    zero = F.lit(0).cast("bigint")
    return totals.join(new, "file_id", "left").select(
        "file_id", "total_count",
        F.coalesce("new_count", zero).alias("new_count"),
        F.coalesce("new_units", zero).alias("new_units"),
        (col("total_count") - F.coalesce("new_count", zero)).alias("duplicate_count"),
    )


def file_hash_guard(spark, sf_dir):
    """Documents as files: texts of French ones are stored, of equal texts one is taken."""
    files = _document_files(spark, sf_dir).select("file_path", "file_hash", "lang")
    stored = files.filter(col("lang") == "fr").select("file_hash")
    judged = new_files(files.filter(col("lang") != "fr"), stored)
    return judged.filter(~col("repeated")).select("file_path", "file_hash")


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer balances as incoming rows; five customers in a row make one file."""
    file = F.floor(col("c_custkey") / 5).cast("string")
    return sample.as_staging(table(spark, sf_dir, "customer"), {
        "file_path": file, "file_name": file, "source": F.lit("generic"), "file_hash": file,
        "record_index": col("c_custkey"), "source_row_id": col("c_custkey").cast("string"),
        "date_raw": F.lit("2024-03-15"), "amount_raw": sample.brazilian(col("c_acctbal")),
        "direction": F.lit("in"), "description": col("c_name"),
    })


def reject_file_on_error(spark, sf_dir):
    rows = normalize(_balances(spark, sf_dir), date_format="yyyy-MM-dd")
    kept = without_bad_files(rows, "file_path")
    return kept.select("source_row_id", "file_path", "amount_in_units")


def row_errors(spark, sf_dir):
    rows = normalize(_balances(spark, sf_dir), date_format="yyyy-MM-dd")
    return file_summary(rows).select(
        "file_path", "row_count", "error_count", "row_error", "first_day", "last_day"
    )


def direction_guard(spark, sf_dir):
    """Events that name their direction, rightly or not, by what is wrong with them."""
    named = (
        F.when(col("file_path") == "view", "sideways").when(col("file_path") == "click", "IN")
        .otherwise(col("direction"))
    )
    minus = F.when(col("file_path") == "signup", F.concat(F.lit("-"), "amount_raw")).otherwise(col("amount_raw"))
    staging = sample.events_staging(spark, sf_dir).withColumns({"direction": named, "amount_raw": minus})
    rows = normalize(staging, date_format=None)
    return rows.groupBy("file_path", "error").agg(F.count(F.lit(1)).alias("rows"))


def occurrence_identity(spark, sf_dir):
    """Events of one type on one day are equal rows but for their amount's full units; each
    gets its rank among equals."""
    staging = sample.events_staging(spark, sf_dir).withColumns({
        "source_row_id": F.lit(""), "description": col("file_path"),
        "amount_raw": F.concat(F.substring_index("amount_raw", ".", 1), F.lit(".01")),
    })
    rows = normalize(staging, date_format=None)
    ranked = with_occurrence_ids(rows, chunk_records=1000)
    return ranked.groupBy("file_path", "date", "amount_in_units", "source_row_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("record_index").alias("event_id")
    )


def suspected_duplicates(spark, sf_dir):
    return analytics.suspected_duplicates(events_ledger(spark, sf_dir)).select(
        "date", "amount_in_units", "direction", "transactions", "files"
    )


def suspected_rows(spark, sf_dir):
    return analytics.suspected_rows(events_ledger(spark, sf_dir)).select(
        "source_row_id", "date", "amount_in_units", "direction"
    )


# -- reports -----------------------------------------------------------------------------


def monthly_rollup(spark, sf_dir):
    return analytics.monthly_summary(orders_ledger(spark, sf_dir))


def counterparty_ranking(spark, sf_dir):
    return analytics.counterparty_ranking(orders_ledger(spark, sf_dir))


def counterparty_ranking_by_ranges(spark, sf_dir):
    """The same ranking by the way taken when the counterparties do not fit one task."""
    return analytics.counterparty_ranking(orders_ledger(spark, sf_dir), one_task_rows=0)


def spending_clusters(spark, sf_dir):
    return analytics.spending_clusters(orders_ledger(spark, sf_dir))


def recurring_patterns(spark, sf_dir):
    return analytics.recurring_patterns(events_ledger(spark, sf_dir))


# -- the store ---------------------------------------------------------------------------


def _new_store(spark: SparkSession) -> LedgerStore:
    return LedgerStore(spark, f"{scratch_root(spark)}/ledger-{uuid.uuid4().hex}")


def _monthly(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("month", F.trunc("date", "month")).groupBy(
        "month", "source", "direction"
    ).agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("amount_in_units").alias("units"),
    )


def _imported(spark: SparkSession, sf_dir: str) -> LedgerStore:
    store = _new_store(spark)
    inbox = f"{store.root}-inbox"
    sample.write_inter_statements(spark, sf_dir, f"{inbox}/inter", ROWS_PER_FILE)
    sample.write_nubank_statements(spark, sf_dir, f"{inbox}/nubank", ROWS_PER_FILE)
    import_batch(
        spark, store, [f"{inbox}/inter", f"{inbox}/nubank"], batch_id="first", on_error="quarantine"
    )
    return store


def import_statements(spark, sf_dir):
    """Statement files written from orders and events, imported; the ledger by month."""
    return _monthly(_imported(spark, sf_dir).ledger())


def _offered(*reports: DataFrame) -> DataFrame:
    """Reports summed by source and by whether the file was taken."""
    every = reports[0]
    for report in reports[1:]:
        every = every.unionByName(report)
    taken = F.when(col("status") == "err", "err").otherwise("ok").alias("status")
    return every.groupBy("source", taken).agg(
        F.sum("total_count").alias("offered"), F.sum("new_count").alias("accepted"),
        F.sum("duplicate_count").alias("duplicates"), F.sum("rejected_count").alias("rejected"),
    )


def import_again(spark, sf_dir):
    """The same files offered twice: all are refused, the ledger stays the same."""
    store = _imported(spark, sf_dir)
    inbox = f"{store.root}-inbox"
    again = import_batch(
        spark, store, [f"{inbox}/inter", f"{inbox}/nubank"], batch_id="second", on_error="quarantine"
    )
    return _offered(store.report("first"), again)


def blocked_rows(spark, sf_dir):
    """The rows that `dedup_reimport` skips: stored before, or copies inside the batch."""
    rows = events_ledger(spark, sf_dir).select(
        "id", "file_id", "file_path", "record_index", "amount_in_units"
    )
    stored = rows.filter(col("file_id").isin("purchase", "error")).select("id")
    batch = materialize(rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))), "batch")
    blocked = split_rows(batch, stored, order=["file_path", "record_index", "copy"])[1]
    return blocked.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("blocked_count"), F.sum("amount_in_units").alias("blocked_units")
    )


def import_across_sizes(spark, sf_dir):
    """The same files read whole, then line by line: the second import refuses them by hash."""
    store = _imported(spark, sf_dir)
    inbox = f"{store.root}-inbox"
    again = import_batch(
        spark, store, [f"{inbox}/inter", f"{inbox}/nubank"], batch_id="lines", whole_file_bytes=0,
        on_error="quarantine",
    )
    return _offered(store.report("first"), again)


def import_large_files(spark, sf_dir):
    """The statement files read line by line in small splits, as files beyond the whole-file bound are.

    Quoted line breaks cross the splits.
    """
    store = _new_store(spark)
    inbox = f"{store.root}-inbox"
    sample.write_inter_statements(spark, sf_dir, f"{inbox}/inter", 0)
    sample.write_nubank_statements(spark, sf_dir, f"{inbox}/nubank", 0)
    import_batch(
        spark, store, [f"{inbox}/inter", f"{inbox}/nubank"], batch_id="large", whole_file_bytes=0, split_bytes="256k",
        on_error="quarantine",
    )
    return _monthly(store.ledger())


def import_defects(spark, sf_dir):
    """Lines that are no transactions and files that end inside quotes, by file, and what was imported."""
    store = _new_store(spark)
    inbox = f"{store.root}-inbox"
    sample.write_flawed_statements(spark, sf_dir, inbox)
    report = import_batch(spark, store, inbox, batch_id="flawed", on_error="quarantine")
    name = F.regexp_extract("file_path", "file=([^/]+)", 1).alias("file")
    flaws = store.defects("flawed").groupBy(name, "defect").agg(
        F.count(F.lit(1)).alias("lines"), F.max("record_index").alias("last_record")
    )
    files = report.select(name, "total_count", "new_count", "defect_count", "error")
    return files.join(flaws, "file", "left")


def _rows_per_streamed_file(rows: DataFrame) -> int:
    """Statement files grow with their table, so that the number of batches of a stream hardly does."""
    return min(MOST_ROWS_PER_FILE, max(ROWS_PER_FILE, -(-rows.count() // STREAMED_FILES)))


def import_stream(spark, sf_dir):
    """The statement files imported as a stream of arrivals, three files at a time."""
    store = _new_store(spark)
    inbox = f"{store.root}-inbox"
    orders, events = (_rows_per_streamed_file(table(spark, sf_dir, name)) for name in ("orders", "events"))
    sample.write_inter_statements(spark, sf_dir, f"{inbox}/inter", orders)
    sample.write_nubank_statements(spark, sf_dir, f"{inbox}/nubank", events)
    stream = follow_folder(
        spark, store, inbox, f"{store.root}-checkpoint", files_per_trigger=3, once=True, on_error="quarantine"
    )
    stream.awaitTermination()
    return _monthly(store.ledger())


def _orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.orders_staging(spark, sf_dir).withColumn("file_hash", col("file_path"))


def _delete_africa(store: LedgerStore, sf_dir: str) -> None:
    nations = table(store.spark, sf_dir, "nation").join(
        table(store.spark, sf_dir, "region").filter(col("r_name") == "AFRICA"),
        col("n_regionkey") == col("r_regionkey"),
    ).select(col("n_nationkey").cast("string").alias("name"))
    store.delete_files(store.files().join(nations, "name", "left_semi").select("id"))


def _by_nation(store: LedgerStore) -> DataFrame:
    names = store.files().select(col("id").alias("file_id"), col("name").alias("nation"))
    ledger = store.ledger().join(names, ["file_id"], "inner")
    return ledger.groupBy("nation").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("amount_in_units").alias("units")
    )


def cascade_delete(spark, sf_dir):
    """The orders ledger stored as one file per nation, the nations of AFRICA deleted."""
    store = _new_store(spark)
    import_staged(store, _orders_by_nation(spark, sf_dir), batch_id="orders")
    _delete_africa(store, sf_dir)
    return _by_nation(store)


def replayed_batch(spark, sf_dir):
    """A batch replayed after files of it were deleted, after its rows were moved, and by a new process."""
    store = _new_store(spark)
    staging = _orders_by_nation(spark, sf_dir)
    import_staged(store, staging, batch_id="orders")
    _delete_africa(store, sf_dir)
    import_staged(store, staging, batch_id="orders")
    store.compact()
    import_staged(store, staging, batch_id="orders")
    restarted = LedgerStore(spark, store.root)
    import_staged(restarted, staging, batch_id="orders")
    return _by_nation(restarted)


def packed_ledger(spark, sf_dir):
    """Orders imported in batches by status, AFRICA deleted, packed into one folder and swept; the folders left."""
    store = _new_store(spark)
    staging = _orders_by_nation(spark, sf_dir)
    for status, of in (("F", "in"), ("other", "out")):  # an order's status tells its direction
        part = staging.filter(col("direction") == of).withColumns({
            "file_hash": F.concat_ws("-", F.lit(status), "file_path"),
        })
        import_staged(store, part, batch_id=status)
    _delete_africa(store, sf_dir)
    store.compact()
    store.sweep(keep_versions=1, older_than_seconds=0)
    folders = spark.read.parquet(f"{store.root}/transactions").select(F.countDistinct("folder").alias("folders"))
    return _by_nation(store).crossJoin(F.broadcast(folders))  # one row


def import_by_key_index(spark, sf_dir):
    """Orders imported before and after the ids are indexed, and again when AFRICA is deleted: new rows and known ones."""
    store = _new_store(spark)
    store.indexed_rows = 0  # every batch meets the index
    staging = materialize(_orders_by_nation(spark, sf_dir), "orders", scratch_root(spark))  # imported more than once

    def put(batch: str, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("file_hash", F.concat_ws("-", F.lit(batch), "file_path"))
        report = import_staged(store, rows, batch_id=batch)
        return report.select(F.lit(batch).alias("batch"), col("file_name").alias("nation"), "new_count", "duplicate_count")

    settled = put("settled", staging.filter(col("direction") == "in"))
    store.index_keys(16)
    every = put("every", staging)
    _delete_africa(store, sf_dir)
    store.compact()
    return settled.unionByName(every).unionByName(put("again", staging))


def ledger_of_days(spark, sf_dir):
    """All stored orders of the days on which an urgent order was placed that is shipped in part."""
    store = _new_store(spark)
    import_staged(store, _orders_by_nation(spark, sf_dir), batch_id="orders")
    days = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(
        F.to_date("o_orderdate").alias("date")
    ).distinct()
    rows = store.rows_of_days(days, store.new_staging("days")).join(days, "date", "left_semi")
    return rows.groupBy("date").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("amount_in_units").alias("units")
    )


def rows_of_file(spark, sf_dir):
    """The stored rows of the file with one nation's content, found by its hash, then by its id."""
    store = _new_store(spark)
    import_staged(store, _orders_by_nation(spark, sf_dir), batch_id="orders")
    found = store.file_by_hash("7").first()
    rows = store.transactions_of_file(found.id if found else "")
    return rows.select("source_row_id", "date", "amount_in_units", "direction")


def cleared_ledger(spark, sf_dir):
    """A store that is cleared and given the orders again as a new batch."""
    store = _new_store(spark)
    staging = materialize(_orders_by_nation(spark, sf_dir), "orders", scratch_root(spark))  # imported more than once
    import_staged(store, staging, batch_id="orders")
    store.clear_all()
    gone = store.ledger().count()
    import_staged(store, staging, batch_id="orders again")
    return _by_nation(store).withColumn("rows_when_cleared", F.lit(gone).cast("bigint"))


def export_roundtrip(spark, sf_dir):
    """The orders ledger exported as CSV and read back."""
    store = _new_store(spark)
    staging = sample.orders_staging(spark, sf_dir).withColumn("file_hash", col("file_path"))
    import_staged(store, staging, batch_id="orders")
    out = f"{store.root}-export"
    store.export(out, "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(out)
    return back.select("description", "amount", "direction", "counterparty", "currency")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        summary_cards, monthly_totals, filtered_view, own_transfers_view, filtered_totals, table_page,
        table_page_by_date, table_page_after, table_page_of_range, newest_first, file_overview, currency_totals,
        money_display, money_parse_formats, date_parse_formats, event_days, identity_texts,
        cluster_keys, text_safety, counterparty_keys, own_transfer_flag, row_identity,
        row_identity_fnv, inter_line_roundtrip, nubank_line_roundtrip, generic_line_roundtrip,
        detect_dialect, detect_header_lines, byte_order_marks, blank_files, file_preview, encoding_fallback,
        dedup_reimport, file_hash_guard, reject_file_on_error, row_errors, direction_guard, occurrence_identity, suspected_duplicates, suspected_rows, monthly_rollup,
        counterparty_ranking, counterparty_ranking_by_ranges, spending_clusters,
        recurring_patterns, import_statements, import_again, import_across_sizes, blocked_rows, import_large_files,
        import_defects, import_stream, cascade_delete, replayed_batch, packed_ledger, import_by_key_index, ledger_of_days, rows_of_file,
        cleared_ledger, export_roundtrip,
    )
}
