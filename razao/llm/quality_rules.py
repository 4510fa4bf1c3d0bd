"""Quality rules: hashed n-gram log-likelihood ratio between trusted target and raw corpus.

Words and pairs of words of every document are hashed into buckets. Two smoothed multinomials over the
buckets, of the trusted documents and of the whole corpus, give each bucket a weight, the log of their ratio.
A document's score is the mean weight of its n-grams; it is kept if the score reaches the threshold, the same
for every document. The raw multinomial counts all documents. The target is fitted on at most `most_trusted`
labelled documents (those with the smallest hashes of their id), so that their ids may be broadcast.

Beside the ratio, plain counts of each text are returned, and two fixed rules on them (`base_failed`).

Rows: null and empty texts have no words and fail the fixed rule; texts are taken whole, of any length. Without
trusted documents all weights are 0 and only the fixed rules decide. Repeated rows are rows of their own. An
empty table gives an empty result. Other columns of the input pass through in the struct `row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.llm.common import packed, table
from razao.llm.words import Words, hash_spans, mix, repeats, slices

BUCKETS, MOST_TRUSTED, PRIOR_GRAMS = 1 << 16, 20_000, 8
THRESHOLD = -0.1
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def _buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every word and every pair of neighbouring words."""
    at, pair = words.windows(2)
    texts = np.concatenate([words.text, words.text[at]])
    return texts, (np.concatenate([words.hash, pair]) >> np.uint64(13)) % np.uint64(buckets)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                texts, bucket = _buckets(words, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                trusted = part["trusted"].to_numpy(zero_copy_only=False).astype(bool)
                if trusted.any():
                    target += np.bincount(bucket[trusted[texts]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": at, "raw": raw[at], "target": target[at]})

    return run


def trusted_ids(labels: DataFrame, most: int = MOST_TRUSTED) -> DataFrame:
    """Ids of labelled documents of good quality that are not toxic, at most so many."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most_trusted: int = MOST_TRUSTED) -> np.ndarray:
    """The weight of each bucket. What reaches the driver has one row for each bucket."""
    ids = trusted_ids(labels, most_trusted).withColumn("trusted", F.lit(True))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left")
    flagged = texts.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = flagged.mapInArrow(_count(buckets), "bucket long, raw long, target long").groupBy("bucket")
    rows = counts.agg(F.sum("raw"), F.sum("target")).collect()
    both = np.zeros((2, buckets))
    for bucket, raw, target in rows:
        both[:, bucket] = raw, target
    raw, target = both
    if not target.any():
        return np.zeros(buckets)
    # Observed against expected counts in a target of this size, smoothed by a constant: a bucket that the
    # target could hardly have shown says nothing, however small the target is.
    expected = raw * (target.sum() / raw.sum())
    return np.log(target + PRIOR_GRAMS) - np.log(expected + PRIOR_GRAMS)


def _measure(words: Words) -> dict[str, np.ndarray]:
    n = len(words.count)
    text, start, end = words.lines()
    of_text = lambda t: mix(t.astype(np.uint64) + np.uint64(1))
    _, later = repeats(hash_spans(words.data, start, end) ^ of_text(text))
    at, three = words.windows(3)
    again, _ = repeats(three ^ of_text(words.text[at]))
    covered = np.zeros(len(words) + 2, bool)
    for shift in range(3):
        covered[at[again] + shift] = True
    repeated = np.bincount(words.text[covered[: len(words)]], minlength=n)
    count = words.count.astype(np.int64)
    return {
        "n_words": count,
        "word_chars": words.word_chars(),
        "n_symbols": words.sum_bytes(_SYMBOLS[words.data]),
        "n_dup_lines": np.bincount(text[later], minlength=n),
        "n_repeat_words": repeated,
        "base_failed": (count < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * count),
    }


def _judge(weights: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part["text"])
                found = _measure(words)
                texts, bucket = _buckets(words, len(weights))
                grams = np.bincount(texts, minlength=part.num_rows)
                total = np.bincount(texts, weights[bucket.astype(np.int64)], minlength=part.num_rows)
                found["score"] = total / np.maximum(grams, 1)
                found["kept"] = ~found["base_failed"] & (found["score"] >= threshold)
                columns = {"row": part["row"]} | {k: pa.array(v) for k, v in found.items()}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def judge(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The struct `row`, the counts, `score` and `kept` for every document; no shuffle."""
    rows = packed(docs).withColumn("text", F.col(f"row.`{text}`"))
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, {STATS}, score double, kept boolean"
    return rows.mapInArrow(_judge(weights, threshold), schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, table(spark, sf_dir, "labels"))
    rows = judge(docs.select("doc_id", "text"), weights)
    stats = [s.split()[0] for s in STATS.split(", ")]
    return rows.select(F.col("row.doc_id").alias("doc_id"), *stats, "score", "kept")
