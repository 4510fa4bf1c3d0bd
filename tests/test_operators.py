"""Views, reports and skew-safe operators against brute force, and the plans they get."""

import datetime as dt
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_store import scans

from razao.functions import csv, money
from razao.operators import analytics, dedup, pages, views
from razao.operators.normalize import normalize
from razao.operators.occurrence import with_occurrence_ids
from razao.operators.ranking import dense_rank_desc
from razao.schema import STAGING, TRANSACTIONS
from razao.sources.store import LedgerStore


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(900):
        out.append({
            **dict.fromkeys(TRANSACTIONS.names), "id": f"{rng.getrandbits(64):016x}",
            "file_id": rng.choice("abc"), "source": rng.choice(["inter", "generic"]),
            "date": dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(40)),
            "amount_in_units": rng.choice([100, 250, 999, rng.randrange(1, 100000)]),
            "currency": "BRL", "precision": 2, "direction": rng.choice(["in", "out"]),
            "description": rng.choice(["Padaria Alfa", "MERCADO", "Luz 100%"]),
            "description_normalized": rng.choice(["padaria alfa", "mercado", "luz", ""]),
            "counterparty": rng.choice([None, "Ana", "Bruno"]),
            "counterparty_normalized": rng.choice([None, "ana", "bruno", "caio"]),
            "bank_name": rng.choice([None, "Inter"]), "own_transfer": rng.choice([None, True]),
            "possible_duplicate_key": str(rng.randrange(300)),
        })
    return out


@pytest.fixture(scope="module")
def ledger(spark, rows):
    return spark.createDataFrame(rows, TRANSACTIONS).cache()


def shown(r):
    return r["counterparty"] or r["description"]


@pytest.mark.parametrize("controls, keep", [
    ({}, lambda r: True),
    ({"bank": "Inter"}, lambda r: (r["bank_name"] or r["source"]) == "Inter"),
    ({"bank": "generic"}, lambda r: (r["bank_name"] or r["source"]) == "generic"),
    ({"kind": "entrada"}, lambda r: r["direction"] == "in"),
    ({"kind": "saida", "own": True}, lambda r: r["direction"] == "out" and r["own_transfer"]),
    ({"own": False}, lambda r: not r["own_transfer"]),
    ({"min_value": "9.99"}, lambda r: r["amount_in_units"] >= 999),
    ({"min_value": 9.995}, lambda r: r["amount_in_units"] >= 1000),
    ({"search": "PADARIA"}, lambda r: "padaria" in (shown(r) + r["description"]).lower()),
    ({"search": "0%"}, lambda r: "0%" in shown(r) + r["description"]),
])
def test_filters_and_totals(ledger, rows, controls, keep):
    want = [r for r in rows if keep(r)]
    view = views.filter_view(views.transaction_view(ledger), **controls)
    assert {r.id for r in view.select("id").collect()} == {r["id"] for r in want}
    money_in = sum(r["amount_in_units"] for r in want if r["direction"] == "in")
    volume = sum(r["amount_in_units"] for r in want)
    assert views.totals(view).first() == (len(want), volume, money_in, volume - money_in)


def test_empty_totals(ledger):
    nothing = views.transaction_view(ledger.filter("id = 'x'"))
    assert views.totals(nothing).first() == (0, 0, 0, 0)
    assert views.page_count(nothing).first().pages == 1


@pytest.mark.parametrize("key", ["date", "value"])
@pytest.mark.parametrize("descending", [True, False])
def test_pages(ledger, rows, key, descending):
    field = {"date": "date", "value": "amount_in_units"}[key]
    order = sorted(rows, key=lambda r: (r["date"], r["id"]), reverse=True)
    order.sort(key=lambda r: r[field], reverse=descending)
    want = [r["id"] for r in order]
    view = views.transaction_view(ledger)
    assert [r.id for r in views.sort_view(view, key, descending).collect()] == want
    page = views.page(view, 0, key, descending).collect()
    second = views.page(view, 1, key, descending)
    after = views.page_after(view, page[-1], key, descending).collect()
    assert [r.id for r in page] == want[:200]
    assert [r.id for r in after] == [r.id for r in second.collect()] == want[200:400]
    assert views.page_count(view).first().pages == 5
    assert "TakeOrderedAndProject" in plan(second) and "rangepartitioning" not in plan(second)


@pytest.mark.parametrize("key", ["date", "value"])
@pytest.mark.parametrize("descending", [True, False])
def test_pages_of_ranges(ledger, tmp_path, key, descending):
    view = views.transaction_view(ledger).select("id", "data", "amount_in_units").cache()
    paged = pages.write_pages(view, str(tmp_path / "pages"), key, descending, range_rows=150)
    ranges = paged.starts.count()
    assert ranges > 4
    for number in (0, 1, 3, 4, 5, 9):
        found = paged.page(number)
        assert found.collect() == views.page(view, number, key, descending).collect()
        opened = sum(s.metrics().apply("numFiles").value() for s in scans(found._jdf.queryExecution().executedPlan()))
        assert opened <= 4 < ranges or not found.count()
    again = pages.PagedTable(view.sparkSession, paged.folder, view.schema, key, descending)
    assert again.page(7, 30).collect() == views.page(view, 7, key, descending, 30).collect()
    assert pages.write_pages(view.filter("id = 'x'"), str(tmp_path / "none"), key, descending).page(0).count() == 0


def test_pages_of_few_large_ranges(ledger, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "MOST_RANGES", 3)
    view = views.transaction_view(ledger).select("id", "data", "amount_in_units").cache()
    paged = pages.write_pages(view, str(tmp_path / "pages"), "value", False, range_rows=20)
    assert paged.starts.count() <= 3  # the sample of their borders grows with the ranges
    for number in (0, 2, 4, 9):
        assert paged.page(number).collect() == views.page(view, number, "value", False).collect()
    assert paged.page(7, 30).collect() == views.page(view, 7, "value", False, 30).collect()


def test_money_of_different_currencies_is_not_added(ledger):
    assert views.single_total(ledger).first().currency == "BRL"
    mixed = ledger.withColumn("currency", F.when(F.col("direction") == "in", "USD").otherwise("BRL"))
    assert views.currency_totals(mixed).count() == 2
    with pytest.raises(ValueError):
        views.single_total(mixed).collect()


def test_suspected_duplicates(ledger, rows):
    groups = Counter(
        (r["possible_duplicate_key"], r["date"], r["amount_in_units"], r["direction"]) for r in rows
    )
    got = analytics.suspected_duplicates(ledger).collect()
    assert {(r[0], r[1], r[2], r[3]): r.transactions for r in got} == {
        k: n for k, n in groups.items() if n > 1
    }


def test_recurring_patterns(ledger, rows):
    days = defaultdict(set)
    for r in rows:
        days[r["description_normalized"], r["direction"]].add(r["date"])
    days.pop(("", "in")), days.pop(("", "out"))
    got = {(r[0], r[1]): r for r in analytics.recurring_patterns(ledger).collect()}
    assert set(got) == set(days)
    for key, seen in days.items():
        ordered = sorted(seen)
        gaps = [(b - a).days for a, b in zip(ordered, ordered[1:])]
        assert got[key].days == len(ordered)
        assert got[key].mean_gap == pytest.approx(sum(gaps) / len(gaps))
        assert (got[key].min_gap, got[key].max_gap) == (min(gaps), max(gaps))


def test_rank_by_ranges_equals_rank_in_one_task(spark):
    rng = random.Random(5)
    values = spark.createDataFrame([(i, rng.randrange(60)) for i in range(500)], "k int, v int")
    one = dense_rank_desc(values, "v").select("k", "rank")
    many = dense_rank_desc(values, "v", one_task_rows=0).select("k", "rank")
    assert sorted(one.collect()) == sorted(many.collect())


def test_first_of_a_hot_key(spark):
    rows = spark.range(6000).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id % 700 as string)) as id",
        "concat('f', cast(id % 7 as string)) as file_path", "id as record_index",
    )
    first = {}
    for r in sorted(rows.collect(), key=lambda r: (r.file_path, r.record_index)):
        first.setdefault(r.id, r.record_index)
    stored = spark.createDataFrame([("hot",), ("5",), ("5",), ("zz",)], "id string")
    kept = dedup.new_rows(rows, None)
    assert {r.id: r.record_index for r in kept.collect()} == first
    fresh = dedup.new_rows(rows, stored)
    assert {r.id for r in fresh.collect()} == set(first) - {"hot", "5"}
    assert "partial_min_by" in plan(kept) and "Window" not in plan(kept)
    accepted, blocked = dedup.split_rows(rows, stored)
    both = sorted(r.record_index for r in accepted.unionByName(blocked).collect())
    assert both == list(range(6000)) and accepted.count() == len(set(first) - {"hot", "5"})


def test_rows_without_copies_are_not_aggregated(spark):
    rows = spark.range(500).selectExpr("cast(id as string) as id", "'f' as file_path", "id as record_index", "'wide' as text")
    shown = plan(dedup.new_rows(rows, None))
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown


def test_keys_of_one_hash_are_no_copies(spark, monkeypatch):
    """Copies are counted by hash first; keys that only share a hash, and null keys, are accepted all the same."""
    rows = spark.createDataFrame(
        [("a", "f", 1), ("b", "f", 2), ("a", "f", 3), (None, "f", 4), (None, "f", 5)],
        "id string, file_path string, record_index int",
    )
    monkeypatch.setattr(dedup.F, "xxhash64", lambda *_: F.lit(1).cast("bigint"))
    assert [r.id for r in dedup.copied_keys(rows, "id").collect() if r.id] == ["a"]
    accepted, blocked = dedup.split_rows(rows, rows.filter("id = 'b'").select("id"))
    assert sorted(r.record_index for r in accepted.collect()) == [1, 4, 5]
    assert sorted(r.record_index for r in blocked.collect()) == [2, 3]


def test_stored_table_is_not_shuffled_for_a_small_batch(spark):
    batch = spark.range(10).selectExpr("cast(id as string) as id")
    stored = spark.range(1000).selectExpr("cast(id * 2 as string) as id")
    hits = dedup.stored_keys(batch, stored, "id")
    assert "BroadcastHashJoin" in plan(hits) and "SortMergeJoin" not in plan(hits)
    assert sorted(r.id for r in hits.collect()) == ["0", "2", "4", "6", "8"]


def test_occurrences_across_chunks(spark):
    rows = spark.range(500).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id % 5 as string)) as id", "'f' as file_path",
        "id as record_index", "'' as source_row_id",
    )
    seen, want = Counter(), {}
    for r in sorted(rows.collect(), key=lambda r: r.record_index):
        want[r.record_index] = f"occ-{seen[r.id]}"
        seen[r.id] += 1
    got = with_occurrence_ids(rows, chunk_records=7).collect()
    assert {r.record_index: r.source_row_id for r in got} == want
    assert len({r.id for r in got}) == 500


def test_normalize_is_one_stage_without_python(spark):
    staging = spark.createDataFrame([], STAGING)
    text = plan(normalize(staging.filter("file_path IS NOT NULL")).filter("error IS NULL"))
    assert "Exchange" not in text and "Python" not in text


def test_folded_texts_are_computed_once(spark):
    staging = spark.createDataFrame([], STAGING)
    shown = plan(normalize(staging.filter("file_path IS NOT NULL")))
    assert re.search(r"_folded#\d+, _party_words#\d+\]", shown) and shown.count("Generate inline") == 5


def test_view_filters_reach_the_scan(spark, ledger, tmp_path):
    store = LedgerStore(spark, str(tmp_path / "s"))
    stored = store.write_transactions(ledger, "b1")
    view = views.filter_view(views.transaction_view(stored), kind="saida", min_value=5)
    text = plan(views.totals(view))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "GreaterThanOrEqual(amount_in_units,500)" in pushed
    assert "description" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def expected_amount(raw):
    """The rules for amounts, restated: sign, then separators, then the number."""
    packed = "".join(raw.split())
    digits = "".join(c for c in packed if c in "0123456789.,")
    if not any(c.isdigit() for c in digits):
        return None
    negative = "-" in packed or (packed.startswith("(") and packed.endswith(")"))
    kinds = set(digits) & {".", ","}
    if len(kinds) == 2:
        point = max(kinds, key=digits.rfind)
        plain = digits.replace(({".", ","} - {point}).pop(), "")
        if plain.count(point) > 1:
            return None
        plain = plain.replace(point, ".")
    elif len(kinds) == 1:
        (mark,) = kinds
        head, *rest = digits.split(mark)
        if len(rest) == 1 and not rest[0]:
            return None
        plain = f"{head}.{rest[0]}" if len(rest) == 1 and len(rest[0]) <= 2 else digits.replace(mark, "")
    else:
        plain = digits
    value = Decimal(plain if plain[0] != "." else "0" + plain)
    return -value if negative else value


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.,-() R$a", max_size=12), min_size=40, max_size=80))
def test_amounts_follow_the_rules(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", money.parse_amount(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [expected_amount(t) for t in texts]


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.lists(st.text(alphabet='ab,;"\n é', max_size=6), min_size=2, max_size=4),
        min_size=1, max_size=12,
    ),
    st.sampled_from(csv.DELIMITERS),
)
def test_quoted_records_come_back(spark, records, delimiter):
    text = "\n".join(
        delimiter.join('"' + cell.replace('"', '""') + '"' for cell in record) for record in records
    )
    df = spark.createDataFrame([(text,)], "t string")
    split = csv.split_records(F.col("t"), F.lit(delimiter))
    fields = F.transform(split, lambda r: csv.split_fields(r, F.lit(delimiter)))
    assert df.select(fields.alias("f")).first().f == records
