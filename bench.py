"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
import uuid

from razao.operators.dedup import new_rows
from razao.operators.normalize import normalize
from razao.plans import sample_ledgers as sample
from razao.plans.importer import import_staged
from razao.plans.queries import QUERIES
from razao.session import local_session, materialize, scratch_root
from razao.sources.store import LedgerStore

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "summary_cards", "monthly_totals", "filtered_view", "table_page", "currency_totals",
    "money_parse_formats", "cluster_keys", "counterparty_keys", "row_identity",
    "row_identity_fnv", "inter_line_roundtrip", "nubank_line_roundtrip", "dedup_reimport",
    "file_hash_guard", "reject_file_on_error", "suspected_duplicates", "monthly_rollup",
    "counterparty_ranking", "spending_clusters", "recurring_patterns", "import_statements",
)


def normalize_lineitem(spark, sf_dir):
    """Normalize and de-duplicate every line item."""
    rows = normalize(sample.lineitem_staging(spark, sf_dir))
    return new_rows(materialize(rows.filter("error IS NULL"), "lineitem"), None)


def import_lineitem(spark, sf_dir):
    """Import every line item into a new store: the baseline's import, at scale."""
    store = LedgerStore(spark, f"{scratch_root(spark)}/bench-{uuid.uuid4().hex}")
    staging = sample.lineitem_staging(spark, sf_dir).withColumn("file_hash", sample.F.col("file_path"))
    return import_staged(store, staging)


def timed(spark, query) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, "razao-bench")
    timed(spark, QUERIES["summary_cards"])  # not counted: loads classes, starts threads
    queries = {name: QUERIES[name] for name in HEADLINE}
    queries |= {"normalize_lineitem": normalize_lineitem, "import_lineitem": import_lineitem}
    seconds = {name: round(timed(spark, query), 3) for name, query in queries.items()}
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "import_rows_per_second": round(rows / seconds["import_lineitem"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
