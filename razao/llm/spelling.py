"""Spelling variants: words one edit apart, found by a dictionary of pairs of trie nodes.

The distinct words are sorted, and the nodes of their forward trie are numbered as each sorted run is read: a
word opens one node for each code point behind what it shares with the word before it. Runs are ranges of the
sorted table; where a range begins inside nodes of the ranges before it, a table of one row for each range
renames them. The nodes of the reversed words are numbered likewise. A word with a place i is then a pair of
integers: (node of what stands before i, node of what stands behind it), with the code point at i skipped, or
with nothing skipped. Two words are one edit apart exactly if

* both skip a code point and the pairs are equal (a replacement), or
* one skips a code point and the other none, and the pairs are equal (an insertion or deletion).

So one group by pairs of integers gives all neighbours. A group holds at most one word that skips nothing, and
otherwise words that differ in one code point only, so it is no larger than the alphabet; each word's share
(how many, and which of the others is the most frequent) is taken inside the group, no pairs are written. A
deletion inside a run of equal code points is counted where the run begins.

A word's form is its most frequent neighbour (ties: the smallest word) if that is `ratio` times as frequent.
Forms are always more frequent than their words, so they end in a root, found by pointer doubling.

Rows: null, empty and blank texts have no words; a null id counts as an empty one; texts and words are taken
whole, of any length. Repeated rows count each time. An empty table gives an empty result. Only the id and the
text of the input are read; words are the rows of the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from razao.llm.common import stored, table
from razao.llm.spans import as_bytes, crc32_spans, distinct_spans
from razao.llm.words import slices

LEAST_LENGTH, LEAST_COUNT, RATIO, TYPO_EVERY = 5, 3, 2, 97
#: Nodes and words are numbered inside a range of the sorted words; the range's own number stands above.
_RANGE = 1 << 40
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and text, start and end of every run of ASCII letters and U+00C0 to U+00FF (bytes C3, then one)."""
    data, bounds = as_bytes(pc.fill_null(texts, "").cast(pa.large_string()).cast(pa.large_binary()))
    low = int(bounds[0])
    data, bounds = data[low : int(bounds[-1])], bounds - low
    letter = _LETTER[data] | (data == 0xC3)
    letter[1:] |= data[:-1] == 0xC3
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:-1]
    ends[:-1] &= ~letter[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    return _LOWER[data], np.searchsorted(bounds, start, "right") - 1, start, np.flatnonzero(ends) + 1


def _count(typo_every: int, least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, text, start, end = _runs(part["text"])
                word, values = distinct_spans(data, start, end)
                bytes_, bounds = as_bytes(values)
                pair, times = np.unique(text * max(1, len(values)) + word, return_counts=True)
                text, word = np.divmod(pair, max(1, len(values)))
                begun = np.array([zlib.crc32(f"{i}:".encode()) for i in part["id"].to_pylist()], np.uint32)
                hash_ = crc32_spans(bytes_, bounds[word], bounds[word + 1] - bounds[word], begun[text])
                typo = hash_ % typo_every == 0
                n = np.bincount(word[~typo], times[~typo], minlength=len(values)).astype(np.int64)
                chars = np.bincount(np.repeat(np.arange(len(values)), np.diff(bounds)), (bytes_ & 0xC0) != 0x80, len(values))
                whole = np.flatnonzero((n > 0) & (chars >= least_length))
                cut = []
                for w, h in zip(word[typo].tolist(), hash_[typo].tolist()):
                    of = bytes_[bounds[w] : bounds[w + 1]].tobytes().decode()
                    at = h % len(of)
                    cut.append(of[:at] + of[at + 1 :])
                longer = [i for i, w in enumerate(cut) if len(w) >= least_length]
                yield pa.RecordBatch.from_pydict(
                    {
                        "word": pa.concat_arrays(
                            [values.take(pa.array(whole)).cast(pa.large_string()).cast(pa.string()), pa.array([cut[i] for i in longer], pa.string())]
                        ),
                        "n": pa.array(np.concatenate([n[whole], times[typo][longer]])),
                    }
                )

    return run


def word_counts(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, typo_every: int = TYPO_EVERY,
) -> DataFrame:
    """(word, n) of the whole texts, with one code point deleted from every `typo_every`-th pair of id and word."""
    number = F.coalesce(F.col(f"`{id_}`").cast("string"), F.lit("")).alias("id")
    seen = docs.select(number, F.col(f"`{text}`").alias("text")).mapInArrow(_count(typo_every, least_length), "word string, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _shared(a: str, b: str) -> int:
    """Number of code points that two words begin with in common."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    at = 0
    while a[at] == b[at]:
        at += 1
    return at


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted words with a number each and the nodes of their code points, as numbered in this range alone."""
    base = TaskContext.get().partitionId() * _RANGE
    word, path, opened, at = "", [], base, base
    for batch in batches:
        for part in slices(batch, "word"):
            nodes = []
            for next_ in part["word"].to_pylist():
                same = _shared(word, next_)
                fresh = len(next_) - same
                path[same:] = range(opened + 1, opened + 1 + fresh)
                opened += fresh
                word = next_
                nodes.append(np.array(path, np.int64))
            numbers = np.arange(at, at + part.num_rows)
            at += part.num_rows
            columns = {"no": pa.array(numbers), "range": pa.array(numbers // _RANGE), "nodes": pa.array(nodes, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict({n: part[n] for n in part.schema.names} | columns)


def _renamed(numbered: DataFrame) -> DataFrame:
    """Nodes that a range shares with the ranges before it under the number they have there."""
    spark = numbered.sparkSession
    ends = numbered.groupBy("range").agg(F.min("no").alias("first"), F.max("no").alias("last"))
    borders = numbered.select("range", "no", "word", "nodes").join(ends, "range").filter("no IN (first, last)")
    names, word, path, of = [], "", [], {}
    for row in borders.orderBy("no").collect():  # two rows for each range
        if row.range not in of:
            of[row.range] = path[: _shared(word, row.word)]
            names.append((row.range, of[row.range]))
        same = of[row.range]
        path = [same[x - row.range * _RANGE - 1] if x - row.range * _RANGE <= len(same) else x for x in row.nodes]
        word = row.word
    table_of = spark.createDataFrame(names, "range long, same array<long>")
    own = lambda x: (x - F.col("range") * _RANGE).cast("int")
    renamed = F.transform("nodes", lambda x: F.when(own(x) <= F.size("same"), F.get("same", own(x) - 1)).otherwise(x))
    return numbered.join(table_of, "range").withColumn("nodes", renamed).drop("range", "same")


def trie(words: DataFrame, label: str) -> DataFrame:
    """Add `no` and `nodes` (one for each code point; equal numbers for equal beginnings) to distinct words."""
    kind = ", ".join(f"{n} {t}" for n, t in words.dtypes)
    numbered = words.orderBy("word").mapInArrow(_number, f"{kind}, no long, range long, nodes array<long>")
    return _renamed(stored(numbered, label))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists with a root (0) in front of each, and where each begins."""
    size = pc.list_value_length(column).to_numpy().astype(np.int64)
    begin = np.cumsum(size + 1) - size - 1
    out = np.zeros(int((size + 1).sum()), np.int64)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)) + 1, size)] = column.flatten().to_numpy()
    return out, begin


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of nodes of each word: at every place with nothing skipped, and with a code point skipped."""
    for batch in batches:
        for part in slices(batch, "word"):
            points = np.frombuffer("".join(part["word"].to_pylist()).encode("utf-32-le"), np.uint32)
            size = pc.list_value_length(part["nodes"]).to_numpy().astype(np.int64)
            before, b = _flat(part["nodes"])
            behind, _ = _flat(part["back"])
            for skip in (0, 1):
                count = size + 1 - skip
                word = np.repeat(np.arange(len(size)), count)
                i = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
                prefix, suffix = before[b[word] + i], behind[b[word] + size[word] - i - skip]
                first = np.zeros(len(word), bool)
                if skip:
                    first = np.ones(len(word), bool)
                    first[1:] = (points[1:] != points[:-1]) | (i[1:] == 0)
                columns = {"prefix": prefix, "suffix": suffix, "skips": np.full(len(word), skip == 1), "first": first}
                columns |= {name: part[name].to_numpy()[word] for name in ("no", "n")}
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def neighbours(words: DataFrame) -> DataFrame:
    """(no, word, n, n_near, near_no, near_n): every distinct word with its number of words one edit away and the
    most frequent of them; numbers are in the order of the words."""
    ahead = stored(trie(words, "words-sorted"), "words")
    back = trie(ahead.select(F.reverse("word").alias("word"), F.col("no").alias("of")), "words-reversed")
    both = ahead.join(back.select(F.col("of").alias("no"), F.col("nodes").alias("back")), "no")
    schema = "prefix long, suffix long, skips boolean, first boolean, no long, n long"
    pairs = both.select("no", "word", "n", "nodes", "back").mapInArrow(_pairs, schema)
    group = Window.partitionBy("prefix", "suffix")
    ranked = group.orderBy(F.col("n").desc(), "no")
    flag = lambda c: F.sum(F.col(c).cast("long")).over(group)
    top = F.struct("n", (-F.col("no")).alias("minus"))
    here = pairs.select(
        "no", "skips", "first",
        F.count("*").over(group).alias("members"), flag("skips").alias("skipping"), flag("first").alias("firsts"),
        F.when(F.row_number().over(ranked) == 1, F.lead(top).over(ranked)).otherwise(F.first(top).over(ranked)).alias("best"),
    ).filter("members > 1")
    inserted = F.when(F.col("first"), F.col("members") - F.col("skipping")).otherwise(0)
    near = F.when(F.col("skips"), F.col("skipping") - 1 + inserted).otherwise(F.col("firsts"))
    found = here.groupBy("no").agg(F.sum(near).alias("n_near"), F.max("best").alias("best"))
    best = found.select("no", "n_near", (-F.col("best.minus")).alias("near_no"), F.col("best.n").alias("near_n"))
    out = ahead.select("no", "word", "n").join(best, "no", "left")
    return out.withColumn("n_near", F.coalesce("n_near", F.lit(0)))


def roots(links: DataFrame) -> DataFrame:
    """(no, root) for links (no, up) without rings: where following `up` ends. Distances double each round."""
    links = stored(links.select("no", F.col("up").alias("root")), "roots")
    while True:
        further = links.select(F.col("no").alias("root"), F.col("root").alias("further"))
        new = stored(links.join(further, "root", "left").select("no", F.coalesce("further", "root").alias("root"), "further"), "roots")
        if not new.filter("further IS NOT NULL").limit(1).count():
            return links
        links = new.drop("further")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words with their counts (word, n)."""
    near = stored(neighbours(words), "near")
    formed = F.col("near_n") >= ratio * F.col("n")
    links = near.filter(formed).select("no", F.col("near_no").alias("up"))
    name = lambda c: near.select(F.col("no").alias(c), F.col("word").alias(c[:-3]))
    return (
        near.select("no", "word", "n", "n_near", F.when(formed, F.col("near_no")).alias("form_no"), F.when(formed, F.col("near_n")).alias("form_n"))
        .join(name("form_no"), "form_no", "left")
        .join(roots(links).withColumnRenamed("root", "root_no"), "no", "left")
        .join(name("root_no"), "root_no", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words, forms and roots."""
    return variants(word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


OP11_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
    CAST(i AS BIGINT)) AS step FROM range(256) x(i)),
runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) GROUP BY ALL),
crc AS (
  SELECT id, run, n, hex(id || ':' || run) AS bytes, 4294967295::BIGINT AS c, 1::BIGINT AS p FROM runs
  UNION ALL
  SELECT id, run, n, bytes, xor(c >> 8, step), p + 2 FROM crc JOIN steps ON i = xor(c & 255, ('0x' || bytes[p:p + 1])::BIGINT)
  WHERE p < length(bytes)),
hashed AS (SELECT run, n, xor(c, 4294967295) AS h FROM crc WHERE p > length(bytes)),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN f.form END AS form,
    CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b USING (word)
  LEFT JOIN (SELECT n.word, min(n.other) AS form FROM near n JOIN best USING (word) WHERE n.other_n = top GROUP BY n.word) f USING (word)),
walk AS (
  SELECT word, word AS top, form AS next FROM forms
  UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON forms.word = walk.next)
SELECT word, form, top AS root, n, n_near, form_n FROM forms JOIN (SELECT word, top FROM walk WHERE next IS NULL) USING (word)
"""
