"""The registered queries against SQL, and the pipeline against plain versions of its stages."""

import collections
import re
import sys
from pathlib import Path

import pytest
from conftest import WORDS
from test_operators_exact import brute_components

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import TESTDATA, connect, difference  # noqa: E402

import corpus_pipeline  # noqa: E402
from razao.llm import queries  # noqa: E402

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[name]) is None


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def plain_form(text):
    return " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower()))


def test_pipeline_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, given, steps = docs.columns, docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF_DIR), "test-stage")
        steps[name], docs = out.collect(), out
        if name != "sharding":
            assert out.columns == columns
    kept = {r.doc_id: r for r in steps["quality rules"]}
    assert all(kept[i].text == r.text for i, r in ((r.doc_id, r) for r in given) if i in kept)
    assert all(len(WORDS.findall(r.text)) >= 50 for r in kept.values())

    components = brute_components([(r.doc_id, r.text) for r in kept.values()], 5, 80)
    assert {r.doc_id for r in steps["near duplicates"]} == {i for i, (_, c) in components.items() if i == c}

    items = [f for (t,) in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("text").collect() if (f := plain_form(t))]
    clean = {r.doc_id for r in steps["near duplicates"] if not any(i in plain_form(r.text) for i in items)}
    assert {r.doc_id for r in steps["decontamination"]} == clean

    words = lambda rows: collections.Counter({s: sum(len(WORDS.findall(r.text)) for r in rows if r.source == s) for s in {r.source for r in rows}})
    before, after = words(steps["decontamination"]), words(steps["mixing"])
    times = collections.Counter(r.doc_id for r in steps["mixing"])
    assert set(times) <= clean and max(times.values()) <= 3
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(before))}
    full = set()
    while True:
        rest = sum(before.values()) - sum(3 * before[s] for s in full)
        share = {s: rest * w / sum(weights[x] for x in weights if x not in full) for s, w in weights.items() if s not in full}
        above = {s for s, t in share.items() if t > 3 * before[s]}
        if not above:
            break
        full |= above
    longest = max(len(WORDS.findall(r.text)) for r in steps["decontamination"])
    assert all(abs(after[s] - share.get(s, 3 * before[s])) <= longest for s in before)

    shards = collections.defaultdict(list)
    for r in steps["sharding"]:
        shards[r.shard].append(r)
    assert collections.Counter(r.doc_id for r in steps["sharding"]) == times
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in shards.values())
    assert all(r.size == len(r.text.encode()) + 8 for r in steps["sharding"])
