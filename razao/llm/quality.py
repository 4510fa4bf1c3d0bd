"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Document evidence: a logistic regression over hashed words (present or not) and coarse shape features (share
of capitals, symbols, repeats, ...). Its features are the buckets whose presence differs most surely between
the sides of a label. It is fitted on at most `most` labelled documents, those with the smallest hashes of
their id, so that their ids may be broadcast and their chosen features fit the driver.

Site evidence: the document probabilities are averaged for each path of a host, each host and the corpus. A
host's posterior is its mean shrunk towards the corpus, a path's is its mean shrunk towards its host's
posterior; how strongly follows from how much hosts (paths) differ beyond chance, by the method of moments.
A document's log odds are its own evidence plus its path's log odds against the corpus.

Two labels are scored, `quality` and `toxic`; a document is kept if it is more likely good than bad and more
likely harmless than toxic. Rows: null and empty texts have only shape features; null hosts and paths are
sites of their own. Texts are taken whole. Without labels of both kinds a label's probability is 0.5 and
decides nothing. Repeated rows are rows of their own. An empty table gives an empty result. Other columns of
the input pass through in the struct `row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.llm.common import packed, stored, table
from razao.llm.words import Words, hash_spans, mix, repeats, slices

BUCKETS, MOST_LABELLED, FEATURES, MOST_ODDS = 1 << 17, 20_000, 400, 12.0
LEAST_Z, LEAST_SEEN = 5.0, 4
LABELS = ("quality", "toxic")
_LEVELS = 16
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_OTHER = np.array([32 < b < 127 and not chr(b).isalnum() and chr(b) not in ".,'\"-" for b in range(256)])


def _features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each distinct feature of each text."""
    words = Words(texts, lower=True)
    plain = Words(texts, lower=True, gap=_GAP)
    raw = Words(texts)
    n = len(texts)
    letters = np.maximum(raw.word_chars(), 1)
    count = np.maximum(words.count, 1)
    again, _ = repeats(words.hash ^ mix(words.text.astype(np.uint64) + np.uint64(1)))
    text, start, end = words.lines()
    _, line_again = repeats(hash_spans(words.data, start, end) ^ mix(text.astype(np.uint64) + np.uint64(1)))
    shape = [
        raw.sum_bytes(_UPPER[raw.data]) / letters,
        raw.sum_bytes(_DIGIT[raw.data]) / letters,
        raw.sum_bytes(_OTHER[raw.data]) / letters,
        np.bincount(words.text[again], minlength=n) / count,
        np.bincount(text[line_again], minlength=n) / np.maximum(np.bincount(text, minlength=n), 1),
        np.minimum(letters / count / 16, 1),
        np.log2(count + 1) / 24,
    ]
    kinds = [
        mix(np.full(n, 1000 + k, np.uint64) * np.uint64(_LEVELS) + np.minimum(np.sqrt(v) * _LEVELS, _LEVELS - 1).astype(np.uint64))
        for k, v in enumerate(shape)
    ]
    of = np.concatenate([plain.text] + [np.arange(n)] * len(shape))
    bucket = np.concatenate([plain.hash, *kinds]) % np.uint64(buckets)
    both = np.unique(of.astype(np.uint64) * np.uint64(buckets) + bucket)
    return (both // np.uint64(buckets)).astype(np.int64), (both % np.uint64(buckets)).astype(np.int64)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * len(LABELS), buckets + 1), np.int64)  # last column: documents
        for batch in batches:
            for part in slices(batch, "text"):
                text, bucket = _features(part["text"], buckets)
                for k, label in enumerate(LABELS):
                    values = part[label].to_numpy(zero_copy_only=False)
                    for side in (0, 1):
                        total[2 * k + side, :-1] += np.bincount(bucket[values[text] == side], minlength=buckets)
                        total[2 * k + side, -1] += (values == side).sum()
        at = np.flatnonzero(total.any(axis=0))
        columns = {"bucket": at} | {f"n{i}": total[i, at] for i in range(2 * len(LABELS))}
        yield pa.RecordBatch.from_pydict(columns)

    return run


def _choose(total: np.ndarray, most: int) -> np.ndarray:
    """Buckets whose presence differs between the sides beyond chance, the surest first."""
    (no, yes), (n_no, n_yes) = total[:, :-1], total[:, -1]
    if not n_no or not n_yes:
        return np.zeros(0, np.int64)
    share = (no + yes) / (n_no + n_yes)
    z = np.abs(yes / n_yes - no / n_no) / np.sqrt(np.maximum(share * (1 - share) * (1 / n_no + 1 / n_yes), 1e-12))
    z[no + yes < LEAST_SEEN] = 0
    order = np.argsort(-z, kind="stable")[:most]
    return np.sort(order[z[order] >= LEAST_Z])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept, which is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _present(chosen: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, bucket = _features(part["text"], buckets)
                keep = np.isin(bucket, chosen)
                at = np.searchsorted(text[keep], np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket[keep]))
                columns = {label: part[label] for label in LABELS} | {"buckets": lists}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def fit(
    docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most: int = MOST_LABELLED, features: int = FEATURES
) -> np.ndarray:
    """One row of bucket weights for each label; the last weight is the intercept.

    The driver gets one row of counts for each bucket, and the chosen features of at most `most` documents.
    """
    sides = [F.coalesce(F.max(label), F.lit(-1)).cast("int").alias(label) for label in LABELS]
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*sides)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", *LABELS), "labelled")
    names = [f"n{i}" for i in range(2 * len(LABELS))]
    counts = texts.mapInArrow(_count(buckets), "bucket long, " + ", ".join(f"{n} long" for n in names))
    total = np.zeros((2 * len(LABELS), buckets + 1))
    for row in counts.groupBy("bucket").agg(*[F.sum(n) for n in names]).collect():
        total[:, row[0]] = row[1:]
    use = [_choose(total[2 * k : 2 * k + 2], features) for k in range(len(LABELS))]
    every = np.unique(np.concatenate(use))
    schema = ", ".join(f"{label} int" for label in LABELS) + ", buckets array<long>"
    rows = texts.mapInArrow(_present(every, buckets), schema).collect()
    x = np.zeros((len(rows), len(every)), np.float32)
    for i, row in enumerate(rows):
        x[i, np.searchsorted(every, row["buckets"])] = 1
    out = np.zeros((len(LABELS), buckets + 1))
    for k, label in enumerate(LABELS):
        side = np.array([row[label] for row in rows], int)
        known_ = np.flatnonzero(side >= 0)
        if len(use[k]) or len(np.unique(side[known_])) == 2:
            w = _logistic(x[np.ix_(known_, np.searchsorted(every, use[k]))], side[known_])
            out[k, use[k]], out[k, -1] = w[:-1], w[-1]
    return out


def _evidence(weights: np.ndarray):
    buckets = weights.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, bucket = _features(part["text"], buckets)
                columns = {"row": part["row"]}
                for label, w in zip(LABELS, weights):
                    odds = np.bincount(text, w[bucket], part.num_rows) + w[-1]
                    columns[label] = pa.array(np.clip(odds, -MOST_ODDS, MOST_ODDS))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(means: DataFrame, corpus: float) -> float:
    """Pseudo-documents of the prior: from how much the means of sites differ beyond what chance explains."""
    n, mean_n, spread = means.agg(
        F.count("*"), F.avg("n"), F.sum(F.col("n") * F.pow(F.col("p") - corpus, 2)) / F.sum("n")
    ).first()
    if not n or n < 2:
        return 1e6
    chance = corpus * (1 - corpus) / max(mean_n, 1.0)
    return min(1e6, max(1.0, corpus * (1 - corpus) / max(spread - chance, 1e-9) - 1))


def site_posteriors(scored: DataFrame, label: str) -> tuple[DataFrame, float]:
    """(host, path, post): each path's posterior probability; and the corpus mean. `scored`: host, path, label's log odds."""
    p = 1 / (1 + F.exp(-F.col(label)))
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.avg(p).alias("p")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("host_p"))
    corpus = paths.agg(F.sum(F.col("n") * F.col("p")) / F.sum("n")).first()[0]
    corpus = min(1 - 1e-6, max(1e-6, 0.5 if corpus is None else corpus))
    for_host = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_p").alias("p")), corpus)
    for_path = _strength(paths, corpus)
    post_host = (F.col("host_n") * F.col("host_p") + for_host * corpus) / (F.col("host_n") + for_host)
    both = paths.join(
        hosts.select(F.col("host").alias("_host"), post_host.alias("post_host")), F.col("host").eqNullSafe(F.col("_host"))
    )
    post = (F.col("n") * F.col("p") + for_path * F.col("post_host")) / (F.col("n") + for_path)
    return both.select("host", "path", F.least(F.greatest(post, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("post")), corpus


def classify(docs: DataFrame, weights: np.ndarray, host: Column, path: Column, text: str = "text") -> DataFrame:
    """`row` (the input without the text), `quality` and `toxic` (probabilities) and `kept` of every row."""
    site = F.struct(F.col("row").dropFields(f"`{text}`").alias("row"), "host", "path")
    narrow = packed(docs, host=host, path=path, text=F.col(f"`{text}`")).select(site.alias("row"), "text")
    kind = narrow.schema["row"].dataType.simpleString()
    odds = narrow.mapInArrow(_evidence(weights), f"row {kind}, " + ", ".join(f"{x} double" for x in LABELS))
    scored = stored(
        odds.select("row.row", "row.host", "row.path", *LABELS),
        "evidence",
    )
    out = scored
    for label in LABELS:
        sites, corpus = site_posteriors(scored, label)
        sites = sites.select(F.col("host").alias("_h"), F.col("path").alias("_p"), (_logit(F.col("post")) - float(np.log(corpus / (1 - corpus)))).alias("_shift"))
        out = out.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
        out = out.withColumn(label, 1 / (1 + F.exp(-(F.col(label) + F.col("_shift"))))).drop("_h", "_p", "_shift")
    return out.select("row", *LABELS, ((F.col("quality") >= 0.5) & (F.col("toxic") <= 0.5)).alias("kept"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the source is the host, the language its path."""
    docs = table(spark, sf_dir, "documents")
    weights = fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", "source", "lang")
    out = classify(rows, weights, F.col("source"), F.col("lang"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("quality").alias("quality_probability"),
        F.col("toxic").alias("toxic_probability"),
        "kept",
    )
