"""Substring de-duplication by super-k-mer partitioning.

A window is k consecutive words of one document. Its minimiser is the least hash of the m-word runs in it, so
equal windows have equal minimisers. Consecutive windows that share a minimiser travel as one packed string
(a super-k-mer: their words, one space between) to the bucket of the minimiser. There all windows of all
strings are sorted by hash, compared byte by byte, and every window that is not the first of its kind (by
document id, then start) is marked. Marked windows return to their documents, whose covered words go.

Scale: a task sends each of its strings once; the later copies of a string within a slice of a task are marked
there and only their runs travel. Strings for one bucket are packed together and compressed. The number of
buckets follows the bytes sent, counted over the whole corpus, and minimisers that alone would fill a quarter of
a bucket are known from the same count (in slots whose number grows with the corpus, so that a slot is far below
that on average): their windows travel one by one, spread by the hash of the window. So no bucket grows with a frequent phrase or a large group of copies.

Rows: null and empty texts have no words. Texts of any length are taken whole. Ids are integers; null ids
count as one id after all others. Rows with the same id and different texts are ordered by start only, and of
two equal windows at the same start of the same id neither goes; wholly repeated rows get the same result. An
empty table gives an empty result. Columns of the input but the text pass through in the struct `row`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.llm.common import packed, stored, table
from razao.llm.words import Words, hash_spans, mix, normal_form, slices, sliding_min

WINDOW, MINIMISER = 20, 3
BUCKET_BYTES, LEAST_BUCKETS, SLICE = 4 << 20, 256, 4 << 20
_SLOT_BITS, _LONGEST = 16, 4096  # the least number of bits
_HELD = 1 << 20
_LAST_ID = np.iinfo(np.int64).max
_RUN = [("id", "long"), ("version", "long"), ("start", "int"), ("length", "int")]
_RUNS = ", ".join(f"{a} {b}" for a, b in _RUN)


class _Cut:
    """The super-k-mers of a slice: first window `at`, number of windows `n`, mixed minimiser `key`."""

    def __init__(self, words: Words, k: int, m: int, hot: np.ndarray | None = None, bits: int = 0):
        self.words = words
        self.at, self.n, self.key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        where, window = words.windows(k)
        if not len(where):
            return
        runs = words._windows_all(m)
        key = mix(sliding_min(runs, k - m + 1)[where])
        alone = np.zeros(len(key), bool)
        if hot is not None and len(hot):  # slots, ascending
            slot = _slot(key, bits)
            alone = hot[np.minimum(np.searchsorted(hot, slot), len(hot) - 1)] == slot
        key = np.where(alone, mix(window + np.uint64(1)), key)
        new = np.ones(len(where), bool)
        new[1:] = (where[1:] != where[:-1] + 1) | (key[1:] != key[:-1]) | alone[1:] | alone[:-1]
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(where)))
        if length.max() > _LONGEST:  # very long repetitions are cut; all parts go to the same bucket
            parts = -(-length // _LONGEST)
            offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.repeat(first, parts) + offset * _LONGEST
            length = np.diff(np.append(first, len(where)))
        self.at, self.n, self.key = where[first], length, key[first]


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def _size_up(k: int, m: int, bits: int):
    """Bytes by slot of the minimiser: of its strings, and of its windows if they travel one by one."""

    def summed(held: list) -> pa.RecordBatch:
        slot, packed_, alone = np.concatenate(held, axis=1)
        at, of = np.unique(slot, return_inverse=True)
        sums = [np.bincount(of, x, len(at)).astype(np.int64) for x in (packed_, alone)]
        return pa.RecordBatch.from_pydict({"slot": at, "packed": sums[0], "alone": sums[1]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                cut = _Cut(Words(part["text"]), k, m)
                if not len(cut.at):
                    continue
                start, end = cut.words.start, cut.words.end
                windows = np.append(0, np.cumsum((end[k - 1 :] - start[: len(start) - k + 1]).astype(np.int64)))
                size = (end[cut.at + cut.n + k - 2] - start[cut.at]).astype(np.int64)
                held.append(np.stack([_slot(cut.key, bits), size, windows[cut.at + cut.n] - windows[cut.at]]))
                n += len(cut.at)
                if n > _HELD:
                    yield summed(held)
                    held, n = [], 0
        if held:
            yield summed(held)

    return run


def _send(k: int, m: int, buckets: int, hot: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                cut = _Cut(Words(part["text"]), k, m, hot, bits)
                if not len(cut.at):
                    continue
                words = cut.words
                ids = part["id"].to_numpy(zero_copy_only=False)
                versions = part["version"].to_numpy(zero_copy_only=False)
                text = words.text[cut.at]
                start = cut.at - words.first[text]
                table_ = np.stack([ids[text], versions[text], start, cut.n])
                form, bounds = normal_form(words)
                form = form.tobytes()
                low, high = bounds[cut.at], bounds[cut.at + cut.n + k - 1] - 1
                # Equal strings of this slice: only the first by (id, start) travels.
                same = hash_spans(words.hash, cut.at, cut.at + cut.n + k - 1)
                order = np.lexsort((start, table_[0], same))
                later = np.zeros(len(order), bool)
                run_of = np.flatnonzero(np.append(True, same[order][1:] != same[order][:-1]))
                head = np.repeat(order[run_of], np.diff(np.append(run_of, len(order))))
                differs = (table_[0][order] != table_[0][head]) | (start[order] != start[head])
                for i in np.flatnonzero(differs):
                    a, b = order[i], head[i]
                    later[a] = form[low[a] : high[a]] == form[low[b] : high[b]]
                bucket = (cut.key % np.uint64(buckets)).astype(np.int64)
                done = np.flatnonzero(later)
                if len(done):
                    yield _parcel([int(bucket[done[0]])], [squeeze(table_[:, done].tobytes())], [None])
                left = np.flatnonzero(~later)
                left = left[np.argsort(bucket[left], kind="stable")]
                edges = np.flatnonzero(np.append(True, bucket[left][1:] != bucket[left][:-1]))
                groups = np.split(left, edges[1:])
                lows, highs = low.tolist(), high.tolist()
                yield _parcel(
                    [int(bucket[g[0]]) for g in groups],
                    [squeeze(table_[:, g].tobytes()) for g in groups],
                    [squeeze(b"\n".join([form[lows[i] : highs[i]] for i in g.tolist()])) for g in groups],
                )

    return run


def _parcel(bucket: list, places: list, strings: list) -> pa.RecordBatch:
    columns = [pa.array(bucket, pa.int32()), pa.array(places, pa.binary()), pa.array(strings, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "places", "strings"])


def _meet(k: int):
    def run(group: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        done, tables, strings = [], [], []
        for places, text in zip(group["places"].to_pylist(), group["strings"].to_pylist()):
            rows = np.frombuffer(expand(places), np.int64).reshape(4, -1)
            if text is None:
                done.append(rows)
            else:
                tables.append(rows)
                strings.append(expand(text))
        if tables:
            rows = np.concatenate(tables, axis=1)
            data = b"\n".join(strings)
            del strings
            done.append(_later_windows(rows, data, k))
        out = np.concatenate(done, axis=1)
        return pa.table({n: pa.array(c, pa.int64() if t == "long" else pa.int32()) for (n, t), c in zip(_RUN, out)})

    return run


def _later_windows(rows: np.ndarray, data: bytes, k: int) -> np.ndarray:
    """Runs of windows of these strings (one a line) that are not the first of their kind."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    bounds = np.append(0, ends + 1).astype(np.int64)
    bounds[-1] = len(raw)
    texts = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data))
    words = Words(texts)
    at, key = words.windows(k)
    string = words.text[at]
    start = rows[2][string] + at - words.first[string]
    id_ = rows[0][string]
    order = np.lexsort((start, id_, key))
    heads = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    head = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
    behind = (id_[order] != id_[head]) | (start[order] != start[head])
    a, b = order[behind], head[behind]
    equal = _same_bytes(raw, words.start[at[a]], words.end[at[a] + k - 1], words.start[at[b]], words.end[at[b] + k - 1])
    later = np.zeros(len(at), bool)
    later[a[equal]] = True
    if not equal.all():  # different windows with one hash: settle that hash by the bytes themselves
        for value in np.unique(key[a[~equal]]):
            first: dict[bytes, tuple] = {}
            of = order[key[order] == value]
            for i in of:
                window = data[words.start[at[i]] : words.end[at[i] + k - 1]]
                later[i] = first.setdefault(window, (id_[i], start[i])) != (id_[i], start[i])
    marked = np.flatnonzero(later)
    if not len(marked):
        return np.zeros((4, 0), np.int64)
    new = np.append(True, (at[marked][1:] != at[marked][:-1] + 1) | (string[marked][1:] != string[marked][:-1]))
    first_of = np.flatnonzero(new)
    length = np.diff(np.append(first_of, len(marked)))
    first_of = marked[first_of]
    return np.stack([id_[first_of], rows[1][string[first_of]], start[first_of], length])


def _same_bytes(raw, a_low, a_high, b_low, b_high, most: int = 1 << 21) -> np.ndarray:
    """Whether spans a and b hold the same bytes, pair by pair."""
    length = a_high - a_low
    out = length == b_high - b_low
    todo = np.flatnonzero(out)
    size = np.cumsum(length[todo])
    i = 0
    while i < len(todo):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
        pair, n = todo[i:j], length[todo[i:j]]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        equal = raw[np.repeat(a_low[pair], n) + offset] == raw[np.repeat(b_low[pair], n) + offset]
        out[pair] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        i = j
    return out


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text compressed, for the one shuffle that texts go through."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [squeeze(t.encode()) if t else None for t in part["text"].to_pylist()]
            columns = {name: part[name] for name in part.schema.names if name != "text"}
            yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts, pa.binary())})


def _expanded(batch: pa.RecordBatch, expand) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch with at most about SLICE bytes of text, and their texts."""
    sizes = [zstandard.frame_content_size(t) if t else 0 for t in batch["text"].to_pylist()]
    low = total = 0
    for i, size in enumerate([*sizes, 0]):
        if i > low and (i == len(sizes) or total + size > SLICE):
            part = batch.slice(low, i - low)
            yield part, pa.array([expand(t) if t else b"" for t in part["text"].to_pylist()], pa.large_binary()).cast(pa.large_string())
            low, total = i, 0
        total += size


def _remove(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part, text_of in _expanded(batch, expand):
                words = Words(text_of)
                lists = part["runs"]
                text = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                runs = lists.flatten()
                first = words.first[text] + runs.field("start").to_numpy()
                length = runs.field("length").to_numpy().astype(np.int64)
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, first, 1)
                np.add.at(steps, first + length + k - 1, -1)
                keep = np.cumsum(steps[:-1]) == 0
                form, bounds = normal_form(words)
                kept = form[np.repeat(keep, np.diff(bounds))].tobytes()
                size = np.append(0, np.cumsum(np.where(keep, np.diff(bounds), 0)))[words.first]
                texts = [kept[a : b - 1] if b > a else b"" for a, b in zip(size[:-1].tolist(), size[1:].tolist())]
                n_kept = np.diff(np.append(0, np.cumsum(keep))[words.first])
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": part["row"],
                        "n_words": pa.array(words.count.astype(np.int64)),
                        "n_removed": pa.array((words.count - n_kept).astype(np.int64)),
                        "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
                    }
                )

    return run


def repeated_runs(texts: DataFrame, k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """(id, version, start, length): runs of windows that also start earlier; `texts` has id, version and text."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(_SLOT_BITS, (256 * size // BUCKET_BYTES).bit_length())  # strings are about three times the text
    slots = texts.select("text").mapInArrow(_size_up(k, m, bits), "slot long, packed long, alone long")
    slots = slots.groupBy("slot").agg(F.sum("packed").alias("packed"), F.sum("alone").alias("alone"))
    is_hot = F.col("packed") > BUCKET_BYTES // 4
    total, hot = slots.agg(
        F.coalesce(F.sum(F.when(is_hot, F.col("alone")).otherwise(F.col("packed"))), F.lit(0)),
        F.collect_list(F.when(is_hot, F.col("slot"))),  # each holds a quarter of a bucket
    ).first()
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))
    hot = np.sort(np.array(hot, np.int64))
    sent = texts.mapInArrow(_send(k, m, buckets, hot, bits), "bucket int, places binary, strings binary")
    return sent.groupBy("bucket").applyInArrow(_meet(k), _RUNS)


def _one_of_each(texts: DataFrame) -> DataFrame:
    """`texts` (id, version, text) with one row of each (id, version).

    Only rows that have copies are shuffled, one for each map task and key; of all others only the key is.
    """
    copies = texts.groupBy("id", "version").count().filter("count > 1")
    copies = stored(copies.select("id", "version"), "copies")
    if copies.isEmpty():
        return texts
    once = texts.join(copies, ["id", "version"], "left_semi").groupBy("id", "version").agg(F.first("text").alias("text"))
    return texts.join(copies, ["id", "version"], "left_anti").unionByName(once)


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = MINIMISER, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """`row` (the input without the text), `n_words`, `n_removed` and `kept_text` (the words left, one space between)."""
    rows = packed(docs).select(
        F.coalesce(F.col(f"row.`{id_}`").cast("long"), F.lit(int(_LAST_ID))).alias("id"),
        F.xxhash64(F.col(f"row.`{text}`")).alias("version"),
        F.col(f"row.`{text}`").alias("text"),
        F.col("row").dropFields(text).alias("row"),
    )
    runs = repeated_runs(_one_of_each(rows.select("id", "version", "text")), k, m)
    of_text = runs.groupBy("id", "version").agg(F.collect_list(F.struct("start", "length")).alias("runs"))
    kind = rows.schema["row"].dataType.simpleString()
    texts = rows.mapInArrow(_squeeze, f"id long, version long, row {kind}, text binary")
    both = texts.join(of_text, ["id", "version"], "left").select(
        "row", "text", F.coalesce("runs", F.array().cast("array<struct<start:int,length:int>>")).alias("runs")
    )
    return both.mapInArrow(_remove(k), f"row {kind}, n_words long, n_removed long, kept_text string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows of 20 words that start earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )
