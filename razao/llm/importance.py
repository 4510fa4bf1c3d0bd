"""Importance resampling towards a target distribution, over hashed runs of words.

Features of a text are its runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo
the number of buckets. Counts of the buckets in the whole raw corpus and in the target texts give each bucket
a gain, the log of the ratio of two smoothed multinomials in thousandths. A document's weight is the sum of
the gains of its features; with Gumbel noise made from its id, the highest scores are a sample without
replacement, drawn in proportion to the weights.

Features are hashed slice by slice: words get exact numbers, runs are distinct triples of numbers, and the
bytes of the distinct runs go, grouped by equal length, through `crc32_spans`. Two passes read the texts
(counts, then weights); nothing but counts of buckets is shuffled before the scores are ranked.

Rows: null and empty texts, and texts without words, have no features, weight 0 and are not drawn; texts are
taken whole, of any length. A null id takes part as an empty id. Ties go to the smaller id, nulls last;
repeated rows are rows of their own and each get a rank. An empty table gives an empty result, an empty target
gains that depend on the corpus alone. Other columns of the input pass through in the struct `row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from razao.llm.common import packed, stored, table
from razao.llm.spans import crc32_spans, distinct_spans
from razao.llm.words import Words, normal_form, slices

LONGEST, BUCKETS, PERCENT, LEAST_WORDS, SEED = 3, 10_000, 5, 20, 42
#: Words whose runs are numbered at once: a word's number takes 21 bits, so that three fit one long.
_STEP, _BITS = 1 << 19, 21
_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def features(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """The words of the texts, and text and bucket of every feature, in parts of bounded size."""
    words = Words(texts, lower=True, gap=_GAP)
    data, bounds = normal_form(words)
    for low in range(0, len(words), _STEP):
        high = min(low + _STEP, len(words))
        reach = min(high + longest - 1, len(words))
        number, _ = distinct_spans(data, bounds[low:reach], bounds[low + 1 : reach + 1] - 1)
        key = np.zeros(reach - low, np.int64)
        for n in range(1, longest + 1):
            m = min(high, reach - n + 1) - low
            if m <= 0:
                break
            key = (key[:m] << _BITS) | (number[n - 1 : n - 1 + m] + 1)
            at = np.flatnonzero(words.text[low : low + m] == words.text[low + n - 1 : low + n - 1 + m])
            _, first, inverse = np.unique(key[at], return_index=True, return_inverse=True)
            begin = low + at[first]
            crc = crc32_spans(data, bounds[begin], bounds[begin + n] - 1 - bounds[begin])
            yield words, words.text[low + at], (crc % np.uint32(buckets)).astype(np.int64)[inverse]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Number of features in each bucket over all rows; one row for each bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for _, _, bucket in features(part["text"], buckets):
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    counts = texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the log-likelihood ratio of target and raw corpus, in thousandths, rounded down."""
    buckets = float(len(raw))
    ratio = (target + 1.0) * (raw.sum() + buckets) / ((raw + 1.0) * (target.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The struct `row`, `n_words`, `n_features` and `weight` for every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                counts, of, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for words, texts, bucket in features(part["text"], len(gain)):
                    counts = words.count
                    of += np.bincount(texts, minlength=n)
                    weight += np.bincount(texts, gain[bucket], minlength=n).astype(np.int64)
                found = {"n_words": counts.astype(np.int64), "n_features": of, "weight": weight}
                yield pa.RecordBatch.from_pydict({"row": part["row"]} | {k: pa.array(v) for k, v in found.items()})

    row = F.col("row") if keep_text else F.col("row").dropFields(f"`{text}`")
    rows = packed(docs).select(row.alias("row"), F.col(f"row.`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the seed and an id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    point = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double") + 0.5
    return F.floor(-1000 * F.log(-F.log(point / F.lit(4294967296.0)))).cast("long")


def draw(
    weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_: str = "doc_id"
) -> DataFrame:
    """Add `score`, and `rank` (1, 2, 3, ...) of the `percent` of rows of enough words that are drawn, else null.

    The rows are sorted once and written; a row's rank is its place in its part plus the rows of the parts
    before. Rows that are equal in score and id are told apart by a number, so that no part is hot.
    """
    number = F.col(f"row.`{id_}`")
    scored = stored(
        weighed.select("*", (F.col("weight") + noise(number, seed)).alias("score"), F.monotonically_increasing_id().alias("_no")),
        "scored",
    )
    enough = F.col("n_words") >= least_words
    order = [F.col("score").desc(), number.asc_nulls_last(), F.col("_no")]
    place = F.monotonically_increasing_id()  # part, and in its lower 33 bits the place in the part
    most = F.lit(1 << 33)
    ordered = scored.filter(enough).orderBy(*order).withColumn("_place", place)
    ordered = stored(ordered.select("*", F.floor(F.col("_place") / most).alias("_part")), "in-order")
    sizes = stored(ordered.groupBy("_part").agg(F.count("*").alias("_rows")), "parts")  # a row for each part
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    drawn = percent * (sizes.agg(F.sum("_rows")).first()[0] or 0) // 100
    rank = F.col("_start") + F.pmod("_place", most) + 1
    ranked = ordered.join(starts, "_part").withColumn("rank", F.when(rank <= drawn, rank))
    columns = [*weighed.columns, "score"]
    rest = scored.filter(~enough).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, "rank").unionByName(rest)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the benchmark texts, with the rank of those that are drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gain = gains(bucket_counts(docs), bucket_counts(table(spark, sf_dir, "benchmark")))
    rows = draw(weigh(docs, gain, keep_text=False))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
    CAST(i AS BIGINT)) AS step FROM range(256) x(i)),
texts AS (
  SELECT true AS raw, row_number() OVER () AS no, doc_id, text FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT raw, no, unnest(w) AS a, generate_subscripts(w, 1) AS pos FROM (
    SELECT raw, no, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts)),
runs AS (
  SELECT raw, no, a, a || ' ' || lead(a, 1) OVER o AS b, a || ' ' || lead(a, 1) OVER o || ' ' || lead(a, 2) OVER o AS c
  FROM words WINDOW o AS (PARTITION BY raw, no ORDER BY pos)),
features AS (
  SELECT raw, no, f, count(*) AS n FROM (
    SELECT raw, no, a AS f FROM runs UNION ALL SELECT raw, no, b FROM runs WHERE b IS NOT NULL
    UNION ALL SELECT raw, no, c FROM runs WHERE c IS NOT NULL) GROUP BY ALL),
crc AS (
  SELECT f, hex(f) AS bytes, 4294967295::BIGINT AS c, 1::BIGINT AS p FROM (SELECT DISTINCT f FROM features)
  UNION ALL
  SELECT f, bytes, xor(c >> 8, step), p + 2 FROM crc JOIN steps ON i = xor(c & 255, ('0x' || bytes[p:p + 1])::BIGINT)
  WHERE p < length(bytes)),
buckets AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE p > length(bytes)),
placed AS (SELECT raw, no, bucket, sum(n) AS n FROM features JOIN buckets USING (f) GROUP BY ALL),
counted AS (
  SELECT bucket, coalesce(sum(n) FILTER (raw), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT raw), 0)::DOUBLE AS t FROM placed GROUP BY ALL),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counted) + 10000)))) AS gain
  FROM counted),
weights AS (
  SELECT no, sum(n) AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE raw GROUP BY no),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(n_words, 0) AS n_words,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE)
      / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (no)
  LEFT JOIN (SELECT no, count(*) AS n_words FROM words WHERE raw GROUP BY no) USING (no) WHERE raw),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""
