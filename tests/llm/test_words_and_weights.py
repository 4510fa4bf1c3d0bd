"""Spelling variants, token counts and importance resampling against plain Python versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import ROWS, frame, taken
from pyspark.sql import functions as F
from test_operators_exact import lower
from tokenizers import Tokenizer

from razao.llm import importance, spelling, token_counts
from razao.llm.spans import MATRIX_WIDTH, crc32_spans, distinct_spans

# --- spans


def test_crc_of_spans_equals_the_library():
    rnd = random.Random(3)
    data = np.frombuffer(rnd.randbytes(9000), np.uint8)
    start = np.array([rnd.randrange(4000) for _ in range(300)] + [0, 7])
    length = np.array([rnd.choice([0, 1, 2, 9, 40, MATRIX_WIDTH, MATRIX_WIDTH + 1]) for _ in range(300)] + [0, 5000])
    before = np.array([rnd.getrandbits(32) for _ in start], np.uint32)
    spans = [data[s : s + n].tobytes() for s, n in zip(start, length)]
    assert crc32_spans(data, start, length).tolist() == [zlib.crc32(b) for b in spans]
    assert crc32_spans(data, start, length, before).tolist() == [zlib.crc32(b, int(c)) for b, c in zip(spans, before)]
    assert len(crc32_spans(data, start[:0], length[:0])) == 0


def test_distinct_spans_are_exact():
    data = np.frombuffer(b"ab ab c", np.uint8)
    number, values = distinct_spans(data, np.array([0, 3, 6]), np.array([2, 5, 7]))
    assert [values[i].as_py() for i in number] == [b"ab", b"ab", b"c"] and len(values) == 2


# --- spelling


def plain_counts(rows, least=5, times=3, every=97):
    count = collections.Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                count[word] += 1
    return {w: n for w, n in count.items() if n >= times}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(count):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    form = {}
    for w, of in near.items():
        best = min(of, key=lambda v: (-count[v], v), default=None)
        if best and count[best] >= 2 * count[w]:
            form[w] = best
    out = []
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, count[w], len(near[w]), count.get(form.get(w))))
    return sorted(out, key=repr)


def test_variants_equal_all_pairs(spark):
    rnd = random.Random(5)
    words = {"".join(rnd.choices("abé", k=rnd.randint(1, 6))): rnd.randint(1, 40) for _ in range(300)}
    words |= {"aaaa": 9, "aaaaa": 3, "aaa": 30, "zzzzzzzz": 1}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(7)
    got = taken(spelling.variants(table), "word", "form", "root", "n", "n_near", "form_n")
    assert got == plain_variants(words) and any(r[1] for r in got)


def test_nodes_are_equal_exactly_for_equal_beginnings(spark):
    rnd = random.Random(6)
    words = sorted({"".join(rnd.choices("ab", k=rnd.randint(1, 9))) for _ in range(400)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = spelling.trie(spark.createDataFrame([(w,) for w in words], "word string"), "test-words").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len({r.no // spelling._RANGE for r in rows}) > 5
    assert [r.word for r in sorted(rows, key=lambda r: r.no)] == words
    named = {}
    for r in rows:
        assert len(r.nodes) == len(r.word)
        for i, node in enumerate(r.nodes):
            assert named.setdefault(r.word[: i + 1], node) == node
    assert len(set(named.values())) == len(named)


def test_word_counts_of_messy_and_empty_rows(messy, none, corpus):
    for rows, table in (([(r[0], r[1]) for r in ROWS], messy), ([r[:2] for r in corpus[0]], corpus[1])):
        for every in (97, 3):
            got = dict(map(tuple, spelling.word_counts(table, typo_every=every).collect()))
            assert got == plain_counts(rows, every=every)
    assert spelling.variants(spelling.word_counts(none)).count() == 0


def test_runs_keep_to_their_text(spark):
    rows = [(1, "abcde"), (2, "fghij"), (3, None), (4, "Ã©tude× ABCDE Āabcde 中abcde")]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert dict(map(tuple, spelling.word_counts(table, least_count=1).collect())) == plain_counts(rows, times=1)


# --- token counts


@pytest.mark.parametrize(
    "name, runs, most", [("word_bpe_49k.json", True, 1 << 16), ("word_bpe_49k.json", True, 3), ("word_bpe_49k.json", False, 40), ("byte_bpe_50k.json", False, 40)]
)
def test_token_counts_equal_the_library(spark, messy, name, runs, most):
    hard = [
        "a<|endoftext|>b <|endoftext|><|startoftext|>x<|endoftext| >", "İstanbul ΣΑΣ é ́x a nbsp  em\u0085nel\x1cfs",
        "'s't DON'T I'LL 12345 ½² 　全角 \U0001f468‍\U0001f469", "ﬁ ẞ ŉ Ǆ \x00 \x1f\x7f a\x00b", "word " * 3000,
    ]
    rows = [(r[0], r[1], r[2], r[3]) for r in ROWS] + [(100 + i, t, None, None) for i, t in enumerate(hard)]
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    want = [(r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    out = token_counts.token_counts(frame(spark, rows).repartition(3), path, runs=runs, most_frequent=most)
    assert out.select("row.*").columns == messy.columns
    assert taken(out, "row.doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)


def test_token_counts_of_an_empty_table(none):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.token_counts(none, path, runs=True).count() == 0


def test_what_is_sent_to_tasks_is_bounded(spark):
    rows = [(f"t{i}", 1 + i, 1) for i in range(1000)]
    words = spark.createDataFrame(rows, "unit string, n long, pieces long")
    for most in (0, 10, 600, 5000):
        known = {r.unit for r in token_counts.frequent(words, most).collect()}
        assert len(known) <= most
        rest = max((n for t, n, _ in rows if t not in known), default=0)
        assert not most or rest <= 2 * sum(r[1] for r in rows) / most


def test_runs_are_cut_as_alone():
    path = public_tokenizers.path("word_bpe_49k.json")
    runs = ["plain", "two,parts", "it's", "a\u00a0b", "\u2003", "x<|endoftext|>y", "\u0301e", "İ", "ς", "½", "\x1c", "l'été"]
    for of in (runs, runs[:3], ["\u2003"], []):
        assert token_counts.pre_tokens_of_runs(path, of) == [token_counts.pre_tokens(path, r) for r in of]


# --- importance resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_draw(rows, target, percent, least):
    of = [(r[0], *plain_features(r[1])) for r in rows]
    raw, wanted = collections.Counter(), collections.Counter()
    for _, _, f in of:
        raw.update(f)
    for t in target:
        wanted.update(plain_features(t)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000))))
    scored = []
    for id_, n, f in of:
        h = int(hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        scored.append([id_, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    scored.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    enough = sum(r[1] >= least for r in scored)
    out, place = [], 0
    for r in scored:
        place += r[1] >= least
        out.append((r[0], *r[2:], place if r[1] >= least and place <= percent * enough // 100 else None))
    return out


@pytest.mark.parametrize("which, percent, least", [("messy", 50, 2), ("corpus", 30, 20), ("corpus", 100, 0)])
def test_draw_equals_a_plain_version(spark, messy, corpus, which, percent, least):
    rows, table = (ROWS, messy) if which == "messy" else corpus
    target = [None, "", "lang w1 w2 w3 one", *[r[1] for r in corpus[0][:9]]]
    texts = spark.createDataFrame([(t,) for t in target], "text string")
    gain = importance.gains(importance.bucket_counts(table), importance.bucket_counts(texts))
    out = importance.draw(importance.weigh(table, gain), percent, least)
    assert out.select("row.*").columns == table.columns
    got = taken(out, "row.doc_id", "n_features", "weight", "score", "rank")
    want = plain_draw([(r[0], r[1]) for r in rows], target, percent, least)
    assert [r[:4] for r in got] == [r[:4] for r in sorted(want, key=repr)]
    ranks = lambda of: collections.Counter((r[0], r[4]) for r in of if r[4])
    assert ranks(got) == ranks(want)


def test_long_texts_are_numbered_in_parts(monkeypatch, corpus):
    texts = importance.pa.array([r[1] for r in corpus[0]])
    whole = sorted((int(t), int(b)) for _, of, bucket in importance.features(texts) for t, b in zip(of, bucket))
    monkeypatch.setattr(importance, "_STEP", 7)
    parts = sorted((int(t), int(b)) for _, of, bucket in importance.features(texts) for t, b in zip(of, bucket))
    assert parts == whole == sorted((i, b) for i, r in enumerate(corpus[0]) for b in plain_features(r[1])[1])


def test_equal_rows_are_ranked_apart_and_in_many_parts(spark):
    table = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text")).repartition(5)
    weighed = importance.weigh(table, np.zeros(importance.BUCKETS, np.int64))
    got = importance.draw(weighed, 10, 1).select("rank").filter("rank IS NOT NULL").collect()
    assert sorted(r[0] for r in got) == list(range(1, 101))


def test_draw_from_an_empty_table(none):
    gain = importance.gains(importance.bucket_counts(none), importance.bucket_counts(none))
    assert importance.draw(importance.weigh(none, gain)).count() == 0
