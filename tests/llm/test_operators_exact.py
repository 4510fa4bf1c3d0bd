"""Operators against plain Python versions on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from conftest import BASE, ROWS, WORDS, frame, taken
from pyspark.sql import functions as F

from razao.llm.components import components
from razao.llm import (
    chat, decontaminate, importance, mixing, near_dup, pii, ppm, quality, quality_rules, sharding, substring_dedup, token_counts,
)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- sharding


def test_sharding_is_even_and_keeps_equal_texts_together(spark):
    rows = [(i, f"text {i // 2}" if i < 200 else f"alone {i} " * (i % 7 + 1)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_rows(docs, sharding.row_bytes(F.col("text")), sharding.text_key(F.col("text")), 6)
    got = out.select("row.doc_id", "size", "shard", "slot").collect()
    assert sorted(r[0] for r in got) == list(range(1500))
    loads, slots, groups = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for id_, size, shard, slot in got:
        assert size == len(rows[id_][1].encode()) + 8
        loads[shard] += size
        slots[shard].append(slot)
        if id_ < 200:
            groups[id_ // 2].add(shard)
    assert set(loads) == set(range(6)) and max(loads.values()) - min(loads.values()) <= 200
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(g) == 1 for g in groups.values()) >= 95


def test_one_hot_group_does_not_break_the_even_sizes(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = sharding.shard_rows(docs, sharding.row_bytes(F.col("text")), sharding.text_key(F.col("text")), 6)
    loads = [r[0] for r in out.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(loads) == 6 and max(loads) - min(loads) <= 40


def test_sharding_of_messy_and_empty_rows(messy, none):
    size, key = sharding.row_bytes(F.col("text")), sharding.text_key(F.col("text"))
    out = sharding.shard_rows(messy, size, key, 3)
    assert out.count() == len(ROWS) and out.select("row.*").columns == messy.columns
    assert sharding.shard_rows(none, size, key, 3).count() == 0


# --- near duplicates


def brute_components(rows, n, percent):
    sets = {}
    for id_, text in rows:
        w = WORDS.findall(lower(text))
        sets[id_] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates_equal_all_pairs(corpus):
    rows, docs = corpus
    for n, percent, band in ((3, 85, 5), (5, 80, 4)):
        out = near_dup.near_duplicates(docs, n, percent, band)
        got = {r[0]: (r[1], r[2]) for r in out.select("row.doc_id", "n_shingles", "component").collect()}
        assert got == brute_components([r[:2] for r in rows], n, percent)


def test_large_groups_are_cut_into_tiles(corpus, monkeypatch):
    rows, docs = corpus
    monkeypatch.setattr(near_dup, "TILE_BYTES", 3000)
    monkeypatch.setattr(near_dup, "TILE_MEMBERS", 3)
    got = {r[0]: r[1] for r in near_dup.near_duplicates(docs).select("row.doc_id", "component").collect()}
    assert got == {i: c for i, (_, c) in brute_components([r[:2] for r in rows], 3, 85).items()}


def test_tasks_of_a_hot_group_of_near_copies_are_bounded(spark, monkeypatch):
    """One group of near copies is confirmed in tasks whose bytes do not grow with the group."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 60] + [f"x{i}"] + base[i % 60 + 1 :])) for i in range(300)]
    confirm = near_dup._confirm

    def checked(words, percent):
        run = confirm(words, percent)

        def bounded(tiles):
            sent = sum(map(len, tiles["text"].to_pylist()))
            assert sent <= 20_000, f"{sent} bytes in one task"
            return run(tiles)

        return bounded

    monkeypatch.setattr(near_dup, "_confirm", checked)
    for name, value in (("TILE_BYTES", 2000), ("TASK_BYTES", 2000), ("LEAST_TASKS", 1)):
        monkeypatch.setattr(near_dup, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r[1] for r in near_dup.near_duplicates(docs).select("row.doc_id", "component").collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 3, 85).items()}


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    rows = [(1, BASE)] * 40 + [(None, BASE + " more")] * 40 + [(2, BASE + " end")]
    confirm = near_dup._confirm

    def checked(words, percent):
        run = confirm(words, percent)

        def few(tiles):
            assert tiles.num_rows <= 3, f"{tiles.num_rows} rows in one task"
            return run(tiles)

        return few

    monkeypatch.setattr(near_dup, "_confirm", checked)
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert [r[0] for r in out.select("component").collect()] == [1] * len(rows)


def test_the_stage_keeps_different_texts_of_one_id(spark):
    rows = [(9, BASE, "a"), (9, "an unrelated text", "a"), (1, BASE + " end", "a"), (3, "once", "a"), (3, "once", "a")]
    rows += [(None, None, "a"), (None, None, "b"), (None, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=repr) == sorted({*rows[1:]}, key=repr)


def test_near_duplicates_of_messy_rows(messy, none):
    out = near_dup.near_duplicates(messy).select("row.doc_id", "n_shingles", "component").collect()
    assert len(out) == len(ROWS)
    component = collections.defaultdict(set)
    for id_, _, c in out:
        component[id_].add(c)
    assert component[1] == component[2] == {1} and component[8] == {8} and component[9] == {1}
    assert component[3] == {3} and component[4] == {4} and component[5] == {5}  # empty sets are linked with nothing
    assert 1 in component[None]  # the copy without an id belongs to document 1
    one = near_dup.one_of_each(messy)
    assert one.columns == messy.columns
    kept = [r[0] for r in one.select("doc_id").collect()]
    assert sorted(i for i in kept if i is not None) == [1, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13] and kept.count(None) == 1
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.one_of_each(none).count() == 0


# --- quality classifier


def test_quality_separates_held_out_rows(spark):
    good = [(i, f"a plain text number {i} about water and stones " * 3, "h", "p") for i in range(300)]
    bad = [(1000 + i, f"BUY!!! $$$ {i} NOW!!! %%% " * 6, "h", "p") for i in range(300)]
    rude = [(2000 + i, f"a plain text about water and stones, you idiot {i} " * 3, "h", "p") for i in range(300)]
    docs = spark.createDataFrame(good + bad + rude, "doc_id long, text string, host string, path string")
    labels = docs.filter("doc_id % 2 = 0").select(
        "doc_id", F.when(F.col("doc_id").between(1000, 1999), 0).otherwise(1).alias("quality"), (F.col("doc_id") >= 2000).cast("int").alias("toxic")
    )
    weights = quality.fit(docs, labels)
    out = quality.classify(docs, weights, F.col("host"), F.col("path")).filter("row.doc_id % 2 = 1")
    assert {(r[0] < 1000) == r[1] for r in out.select("row.doc_id", "kept").collect()} == {True}


def test_sparse_sites_shrink_towards_their_host_and_the_corpus(spark):
    sites = [("big", "x", 3.0)] * 400 + [("bad", "x", -3.0)] * 400 + [("big", "tiny", -3.0)] + [("new", "tiny", -3.0)]
    scored = spark.createDataFrame(sites, "host string, path string, quality double")
    posts, corpus_mean = quality.site_posteriors(scored, "quality")
    post = {(h, p): v for h, p, v in posts.collect()}
    assert post["bad", "x"] < 0.1 < 0.9 < post["big", "x"]
    assert post["bad", "x"] < post["new", "tiny"] < corpus_mean  # one row says little
    assert post["new", "tiny"] < post["big", "tiny"] < post["big", "x"]  # its host speaks for it


def test_quality_of_messy_rows_and_without_labels(spark, messy, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    weights = quality.fit(messy, labels)
    out = quality.classify(messy, weights, F.col("source"), F.col("lang"))
    assert out.count() == len(ROWS) and {r[0] for r in out.select("kept").collect()} == {True}
    assert quality.classify(none, weights, F.col("source"), F.col("lang")).count() == 0
    one_side = spark.createDataFrame([(1, 1, None), (2, 1, None), (None, 0, 1)], labels.schema)
    assert quality.classify(messy, quality.fit(messy, one_side), F.col("source"), F.col("lang")).count() == len(ROWS)


# --- substring de-duplication


def brute_removed(rows, k):
    """Kept words by row; rows: (id, text), in any order."""
    first = {}
    for id_, text in rows:
        w = WORDS.findall(text or "")
        order = math.inf if id_ is None else id_
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, (math.inf, math.inf)), (order, i))
    out = []
    for id_, text in rows:
        w = WORDS.findall(text or "")
        order, covered = math.inf if id_ is None else id_, set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (order, i):
                covered |= set(range(i, i + k))
        out.append((id_, len(w), len(covered), " ".join(x for i, x in enumerate(w) if i not in covered)))
    return sorted(out, key=repr)


def test_repeats_equal_plain_search(corpus, monkeypatch):
    rows, docs = corpus
    want = brute_removed([r[:2] for r in rows], 20)
    assert taken(substring_dedup.remove_repeats(docs), "row.doc_id", "n_words", "n_removed", "kept_text") == want
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 400)  # almost every minimiser is a hot one
    assert taken(substring_dedup.remove_repeats(docs), "row.doc_id", "n_words", "n_removed", "kept_text") == want


def test_a_large_corpus_still_travels_in_long_strings(spark, monkeypatch):
    """With more bytes than the least number of slots can tell apart, only frequent minimisers go window by window."""
    rnd = random.Random(3)
    rows = [(i, " ".join(f"v{rnd.randrange(10**6)}" for _ in range(1000))) for i in range(1300)]
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 1600)

    def counted(k):
        def run(group):
            n = sum(len(zstandard.decompress(p)) // 32 for p in group["places"].to_pylist())
            return pa.table({"id": [0], "version": [0], "start": pa.array([n], pa.int32()), "length": pa.array([0], pa.int32())})

        return run

    monkeypatch.setattr(substring_dedup, "_meet", counted)
    docs = spark.createDataFrame(rows, "id long, text string").repartition(8).select("id", F.lit(0).cast("long").alias("version"), "text")
    strings = substring_dedup.repeated_runs(docs).agg(F.sum("start")).first()[0]
    windows = 1300 * (1000 - 19)
    assert strings < windows / 4


def test_repeats_in_messy_rows(messy, none):
    got = taken(substring_dedup.remove_repeats(messy), "row.doc_id", "n_words", "n_removed", "kept_text")
    assert got == brute_removed([r[:2] for r in ROWS], 20)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_repeated_rows_are_searched_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    text = " ".join(words + words[:25] + ["x"] + words[10:40])
    rows = [(1, text)] * 400 + [(None, text + " more")] * 400 + [(2, "apart " + text), (2, "another"), (2, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    later = substring_dedup._meet

    def few(k):
        def run(group):
            out = later(k)(group)
            assert out.num_rows <= 40, f"{out.num_rows} runs of four texts in one bucket"
            return out

        return run

    monkeypatch.setattr(substring_dedup, "_meet", few)
    got = taken(substring_dedup.remove_repeats(docs), "row.doc_id", "n_words", "n_removed", "kept_text")
    assert got == brute_removed(rows, 20)


def test_windows_with_one_hash_are_told_apart_by_their_bytes(spark, monkeypatch):
    import numpy as np

    from razao.llm import words

    rows = [(i, f"a b c d{i % 3} e f") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    data = "\n".join(t for _, t in rows).encode()
    table = np.array([[i for i, _ in rows], [0] * 9, [0] * 9, [3] * 9])
    monkeypatch.setattr(words.Words, "_windows_all", lambda self, n: np.ones(len(self) - n + 1, np.uint64))
    runs = substring_dedup._later_windows(table, data, 4).T.tolist()
    monkeypatch.undo()
    marked = {(i, s + j) for i, _, s, n in runs for j in range(n)}
    seen, want = set(), set()
    for i, text in rows:
        for s in range(3):
            window = tuple(text.split()[s : s + 4])
            if window in seen:
                want.add((i, s))
            seen.add(window)
    assert marked == want and docs.count() == 9


# --- language model


def brute_ppm(train, order):
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        s = [0xFE] * order + list((t or "").encode()) + [0xFF]
        for i in range(order, len(s)):
            for j in range(order + 1):
                counts[tuple(s[i - j : i])][s[i]] += 1

    def score(t):
        s, total = [0xFE] * order + list((t or "").encode()) + [0xFF], 0.0
        for i in range(order, len(s)):
            gone = set()
            for j in range(order, -1, -1):
                live = {c: n for c, n in counts.get(tuple(s[i - j : i]), {}).items() if c not in gone}
                if not live:
                    continue
                all_ = sum(live.values()) + len(live)
                if s[i] in live:
                    total += math.log10(live[s[i]] / all_)
                    break
                total += math.log10(len(live) / all_)
                gone |= set(live)
            else:
                total -= math.log10(256 - len(gone))
        return total

    return score


def brute_scores(rows, order):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*WORDS.findall(lower(t)), None]
    train = [t for i, t in rows if not out(i)]
    count = collections.Counter(x for t in train for x in tokens(t))
    total, score = sum(count.values()), brute_ppm(train, order)
    result = []
    for i, t in rows:
        base = sum(math.log10((count[x] + 1) / (total + len(count) + 1)) for x in tokens(t))
        known = sum(count[x] > 0 for x in tokens(t))
        result.append((i, out(i), len(tokens(t)), known, total, round(base, 4), round(score(t), 3)))
    return sorted(result, key=repr)


def test_scores_equal_a_plain_model(corpus, monkeypatch):
    rows, docs = corpus
    monkeypatch.setattr(ppm, "LEAST_CHUNKS", 70)  # two rounds of merging
    out = ppm.score_texts(docs)
    got = [(*r[:5], round(r[5], 4), round(r[6], 3)) for r in out.select("row.doc_id", *out.columns[1:]).collect()]
    assert sorted(got, key=repr) == brute_scores([r[:2] for r in rows], ppm.ORDER)


def test_scores_of_messy_rows(messy, none):
    out = ppm.score_texts(messy)
    got = [(*r[:5], round(r[5], 1), round(r[6], 0)) for r in out.select("row.doc_id", *out.columns[1:]).collect()]
    want = [(*r[:5], round(r[5], 1), round(r[6], 0)) for r in brute_scores([r[:2] for r in ROWS], ppm.ORDER)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ppm.score_texts(none).count() == 0


# --- quality rules


def brute_counts(text):
    w = WORDS.findall(text or "")
    threes = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_counts_equal_plain_python(spark, messy, none, corpus):
    weights = quality_rules.fit(messy, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not weights.any()
    for rows, docs in ((ROWS, messy), (corpus[0], corpus[1])):
        out = quality_rules.judge(docs, weights)
        got = taken(out, "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got == sorted(((r[0], *brute_counts(r[1])) for r in rows), key=repr)
        assert out.filter("kept = base_failed").count() == 0
    assert quality_rules.judge(messy, weights).select("row.*").columns == messy.columns
    assert quality_rules.judge(none, weights).count() == 0


def test_ratio_rejects_what_the_trusted_target_never_shows(spark):
    plain = [(i, " ".join(f"word{(i * 7 + j) % 40}" for j in range(80))) for i in range(200)]
    junk = [(1000 + i, " ".join(f"junk{(i * 3 + j) % 40}%%%" for j in range(80))) for i in range(60)]
    docs = spark.createDataFrame(plain + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs, quality_rules.fit(docs, labels))
    score = {r[0]: r[1] for r in out.select("row.doc_id", "score").collect()}
    assert min(score[i] for i, _ in plain) > quality_rules.THRESHOLD > max(score[i] for i, _ in junk)


# --- personal data

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None,
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c_d@e.fg x@y", "..@-.- @a.b a@@b.c a@b..c é@é.de a@b.c.d-e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.9 1..2.3.4.5",
    "4111-1111 1111-1111 4111  1111 378282246310005 4111111111111112 0000000000000", "+1 (555) 010-9999 +1+23 456 7890 1 ++49 30 123456",
    "é\U0001f600 4111111111111111 x +4930123456 1.1.1.1", "4465758382889437 4465758382889437", "+1 (826) 555-4081 190.137.223.204",
    "9" * 5000, "a" * 5000 + "@", "a@" * 3000, "1." * 3000, "+1 " + "( )" * 3000, "john (at) mail [dot] com",
]


def test_base_spans_equal_the_rules(spark, messy):
    rows = [(100 + i, t, None, None) for i, t in enumerate(TRICKY)] + ROWS
    out = pii.find_spans(frame(spark, rows))
    got = sorted(((i, [tuple(s) for s in b]) for i, b in out.select("row.doc_id", "base").collect()), key=repr)
    assert got == sorted(((r[0], brute_spans(r[1])) for r in rows), key=repr)
    assert out.filter("size(array_except(base, spans)) > 0").count() == 0
    added = {r[0]: [tuple(s) for s in r[1]] for r in out.select("row.doc_id", "spans").collect()}
    assert (0, 3, 17) in added[107]  # the phone number beside an address


def test_no_personal_data(spark, none):
    assert pii.find_spans(none).count() == 0
    out = pii.find_spans(frame(spark, [(1, "nothing here", None, None)]))
    assert [tuple(r) for r in out.select("base", "spans").collect()] == [([], [])]


# --- mixing


def test_mix_meets_targets_with_whole_epochs(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), "abc"[i % 3] if i % 10 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for block in (7, 50, 4096):
        out, schedule = mixing.mix(docs, block=block)
        got = out.select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
        assert sorted((r[0], r[2]) for r in got) == [(i, i % 9) for i, _, _ in rows]
        assert all(0 <= r[5] <= 3 * r[2] for r in got)
        target = {r[1]: r[4] for r in got}
        took = collections.Counter()
        for r in got:
            took[r[1]] += r[5]
        assert all(abs(took[s] - target[s]) < 1 for s in target)
        assert abs(sum(target.values()) - sum(r[2] for r in got)) < 1e-6
        assert schedule.groupBy("sid", "rank").count().filter("count > 1").count() == 0


def test_targets_stop_at_three_times_a_source(spark):
    rows = [("a", 10), ("b", 1000), ("c", 5), (None, 1)]
    out = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert out["a"] == 30 and out["c"] == 15 and out[None] == 3 and abs(out["b"] - (1016 - 48)) < 1e-9


def test_mix_of_messy_and_empty_rows(spark, messy, none):
    out, _ = mixing.mix(messy)
    assert out.count() == len(ROWS) and out.select("row.*").columns == messy.columns
    assert mixing.mix(none)[0].count() == 0
    silent, _ = mixing.mix(frame(spark, [(1, None, None, "a"), (2, "", None, "b")]))
    assert [tuple(r) for r in silent.select("target", "taken").collect()] == [(0.0, 0)] * 2


# --- benchmark decontamination

ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and runs into the dark forest near the old mill."),
    (2, "Water boils at one hundred degrees; ice melts at zero.\nWhy does the kettle sing before it boils?"),
    (3, "It is"), (4, ""), (5, None), (None, "an item without an id but with enough words in it"),
]


def test_leaks_are_found_with_edits(spark):
    fox = ITEMS[0][1]
    rows = [
        (1, "some words before. " + fox.upper() + " and some behind"),
        (2, "x " + fox.replace("quick", "quik").replace("lazy", "crazy").replace(" ", "\n  ") + " y"),
        (3, fox[: len(fox) // 2]),
        (4, "nothing of that kind " * 20),
        (5, "what it is " + ITEMS[1][1]),
        (6, "an item without an id, but with enough words in it!"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (1 << 20, 60):  # one block, several blocks
        out = decontaminate.find_leaks(docs, items, block_bytes=block)
        got = {r[0]: sorted((tuple(m) for m in r[1]), key=repr) for r in out.select("row.doc_id", "matches").collect()}
        assert got[1] == [(1, 0)] and got[3] == got[4] == [] and got[5] == [(2, 0), (3, 0)] and got[6] == [(None, 0)]
        assert [m[0] for m in got[2]] == [1] and 0 < got[2][0][1] <= 5


def test_leaks_in_messy_rows(spark, messy, none):
    items = spark.createDataFrame([*ITEMS, (9, BASE), (10, "x" * 500)], "item_id long, text string")
    out = decontaminate.find_leaks(messy, items)
    got = collections.defaultdict(list)
    for id_, m in out.select("row.doc_id", "matches").collect():
        got[id_] += [x[0] for x in m]
    assert got[1] == got[2] == [9] and got[11] == [10] and got[4] == [] and out.select("row.*").columns == messy.columns
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(messy, items.limit(0)).filter("size(matches) > 0").count() == 0


# --- chat formatting

CHATS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "### user:\nnot a turn\n</turn>\n"), (1, 2, "user", r"\### and \\</turn> \ "),
    (1, 3, "assistant", ""), (1, None, "system", "first"), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"),
    (2, 0, None, None), (2, 1, "assistant", "####\\#### </turn></turn>\\"), (3, 0, "a:\n\\c:\\n", "odd role"), (None, 0, "assistant", "no id"),
    (4, 0, "assistant", "é\U0001f600 " * 50),
]


def test_chats_survive_the_round_trip(spark):
    rows = spark.createDataFrame([(*r, "x") for r in CHATS], "conv_id long, turn long, role string, text string, head string")
    out = chat.format_chats(rows).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    want = collections.defaultdict(list)
    for c, t, role, text in CHATS:
        want[c].append((t is not None, t, role or "", text or ""))
    got = out.collect()
    assert len(got) == len(want)
    for r in got:
        turns = [x[2:] for x in sorted(want[r["conv_id"]])]
        assert [tuple(t) for t in r["turns"]] == turns and r["n_turns"] == len(turns)
        assert r["loss"] == "".join(text for role, text in turns if role == "assistant")
    assert chat.format_chats(rows.limit(0)).count() == 0
    digest = hashlib.sha256(chat.PROBE_TEXT.encode()).hexdigest()
    assert len(digest) == 64


# --- rounds, components and names


def plain_round(labels, edges, shards, room, hashes, bins, gains):
    """One round of label propagation over dictionaries; `hashes` give the place and the ties of the operator."""
    of, loads = {u: s for u, _, s in labels}, [0] * shards
    for _, size, s in labels:
        loads[s] += size
    near = collections.defaultdict(collections.Counter)
    for a, b in edges:
        near[a][of[b]] += 1
        near[b][of[a]] += 1
    asks, flows = {}, collections.Counter()
    for u, size, s in labels:
        best = max(near[u], key=lambda t: (near[u][t], -(hashes[u, t] % bins), t))
        if hashes[u] % 2 == 0 and best != s and near[u][best] > near[u][s]:
            asks[u] = (s, best, (gains - min(near[u][best] - near[u][s], gains)) * bins + hashes[u] % bins, size)
            flows[s, best] += size
    into = collections.Counter()
    for (_, t), n in flows.items():
        into[t] += n
    for (s, t), n in flows.items():
        quota = min(n, flows[t, s]) + max(0, room - loads[t]) * n / into[t]
        mine = sorted((place, u, size) for u, (a, b, place, size) in asks.items() if (a, b) == (s, t))
        for last in sorted({p for p, _, _ in mine}, reverse=True):
            if sum(x for p, _, x in mine if p <= last) <= quota:
                of.update({u: t for p, u, _ in mine if p <= last})
                break
    return of


def test_a_round_of_propagation_equals_a_plain_one(spark):
    rnd = random.Random(11)
    shards, room = 5, 700
    labels = [(u, rnd.randint(1, 30), rnd.randrange(shards)) for u in range(200)]
    edges = sorted({tuple(sorted(rnd.sample(range(200), 2))) for _ in range(500)} | {(u, (u + 1) % 200) for u in range(199)})
    table = spark.createDataFrame(labels, "uid long, size long, shard int")
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "node long, other long")
    for turn in range(3):
        hashed = table.crossJoin(spark.range(shards).select(F.col("id").cast("int").alias("to"))).select(
            "uid", "to", F.xxhash64("uid", "to").alias("tie"), F.xxhash64("uid", F.lit(turn)).alias("place")
        )
        hashes = {}
        for r in hashed.collect():
            hashes[r.uid, r.to], hashes[r.uid] = r.tie, r.place
        loads = sharding._loads(table, shards)
        asking = sharding._asking(table, both, turn).cache()
        flows = {(r.shard, r.to): r.n for r in asking.filter("to IS NOT NULL").groupBy("shard", "to").agg(F.sum("size").alias("n")).collect()}
        moved = sharding._moved(asking, sharding._admitted(asking, sharding.quotas(flows, loads, room)))
        want = plain_round(labels, edges, shards, room, hashes, sharding._BINS, sharding._GAINS)
        assert {r.uid: r.shard for r in moved.collect()} == want and want != {u: s for u, _, s in labels}


def test_components_equal_a_plain_search(spark):
    rnd = random.Random(12)
    chain = [(i, i + 1) for i in range(1000, 1100)]
    edges = [tuple(rnd.sample(range(300), 2)) for _ in range(160)] + [(5, 5), (7, 8), (8, 7)] + rnd.sample(chain, len(chain))

    def plain(links):
        up = {}

        def root(i):
            while up.setdefault(i, i) != i:
                i = up[i]
            return i

        for a, b in links:
            low, high = sorted((root(a), root(b)))
            up[high] = low
        return {i: root(i) for i in up}

    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first = components(table(edges))
    assert dict(map(tuple, first.collect())) == plain(edges)
    more = [(1, 1050), (2, 9000), (9000, 9001), (1001, 1002)]
    assert dict(map(tuple, components(table(more), start=first).collect())) == plain(edges + more)
    assert components(table([])).count() == 0


def test_columns_named_as_the_operators_own_come_back(spark):
    names = (
        "uid size source id shard slot link row text key version node component taken sid start _part _key _value _bin _here "
        "_shard_size _shard_link _mix_size _site_host _site_path host path target n_words n_bytes known rest _no weight score "
        "rank quality toxic kept"
    ).split()
    rows = [(i, f"some words of text {i % 3} " * 30, "s", *[f"{n} {i}" for n in names if n not in ("source", "text")]) for i in range(6)]
    others = [n for n in names if n not in ("source", "text")]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in others]]))
    made = {
        "sharding": sharding.shard_rows(docs, sharding.row_bytes(F.col("text")), sharding.text_key(F.col("text")), 2),
        "mixing": mixing.mix(docs)[0],
        "quality": quality.classify(docs, np.zeros((len(quality.LABELS), 65)), F.col("source"), F.col("host")),
        "importance": importance.draw(importance.weigh(docs, np.zeros(100, np.int64)), 50, 1),
        "tokens": token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), runs=True),
    }
    want = sorted((r[0], *r[3:]) for r in rows)
    for name, out in made.items():
        assert sorted(map(tuple, out.select("row.doc_id", *[f"row.`{n}`" for n in others]).collect())) == want, name
