"""Language-model scoring by prediction by partial matching, pretrained on the corpus.

The model is a trie of byte contexts up to `order` bytes. A byte is predicted in the longest context seen in
training; if it was never seen there, an escape (method C: distinct symbols against all) leads to the next
shorter context, and symbols of the longer one are excluded from it. Below order 0 all bytes left are equally
likely. A text is preceded by `order` start marks and ends with one end mark (bytes that UTF-8 never uses), so
the probabilities of all texts sum to one. A word-count base score is returned beside it.

What the model says of a byte depends only on the `order` bytes before it and the byte: an n-gram. So each
chunk of documents sends its distinct n-grams and words, with their training counts, to the partition of the
trie that holds them (by the two bytes before the symbol; words by hash); counts of all chunks are merged
there in steps of 64; the trie part is built and every chunk gets back one number for each n-gram and word it
asked for. The chunk then sums over its texts. No part of the model is broadcast but the 256 x 256 counts of
byte pairs, and no task holds more than a chunk, a part of the trie, or 64 merged pieces.

Rows: a null text is empty and is still scored (its end mark). A null id counts as an empty one for the split
into training and held-out rows. Texts are taken whole; a chunk is never smaller than its longest text.
Repeated rows are rows of their own, in training too. Without training rows all bytes are equally likely. An
empty table gives an empty result. Other columns of the input pass through in the struct `row`. Words are
told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.llm.common import packed, table
from razao.llm.words import Words, mix, slices

ORDER, CHUNK_BYTES, LEAST_CHUNKS, PARTS, FAN_IN = 5, 6 << 20, 64, 128, 64
_BEFORE, _END, _END_WORD = 0xFE, 0xFF, np.uint64(1)
_PARCEL = "part int, chunk int, slice int, body binary"


def held_out(id_: Column) -> Column:
    """Rows that the model does not learn from."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit(""))), F.lit(7)) == 2


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; ascending 64-bit keys go as differences."""
    out = [np.array([len(a) for a in arrays], np.int64).tobytes()]
    for a in arrays:
        if a.dtype == np.uint64 and len(a):
            a = np.diff(a, prepend=np.uint64(0))
            a = a.view(np.uint8).reshape(-1, 8).T  # bytes of equal weight together
        out.append(np.ascontiguousarray(a).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(body: bytes, *kinds: type) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(body)
    sizes = np.frombuffer(body, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds):
        width = np.dtype(kind).itemsize
        a = np.frombuffer(body, np.uint8, n * width, at)
        if kind is np.uint64 and n:
            a = np.cumsum(np.ascontiguousarray(a.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
        out.append(a.view(kind))
        at += n * width
    return out


def grams_of(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and n-gram (order bytes before, then the byte, as one number) of each byte and each end of text."""
    n = len(words.bounds) - 1
    length = np.diff(words.bounds)
    skip = order + 1  # start marks before, one end mark behind
    total = len(words.data) + n * skip
    line = np.full(total, _BEFORE, np.uint64)
    where = np.arange(len(words.data)) + np.repeat(np.arange(n) * skip + order, length)
    line[where] = words.data
    ends = words.bounds[1:] + np.arange(1, n + 1) * skip - 1
    line[ends] = _END
    gram = line.copy()
    for back in range(1, order + 1):
        gram[back:] |= line[:-back] << np.uint64(8 * back)
    keep = np.ones(total, bool)
    for mark in range(order):
        keep[words.bounds[:-1] + np.arange(n) * skip + mark] = False
    return np.repeat(np.arange(n), length + 1), gram[keep]


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the place of each key among them."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    shift = int(len(keys) - 1).bit_length()
    if int(keys.max()).bit_length() + shift <= 64:  # key and place in one number: one plain sort
        both = np.sort((keys << np.uint64(shift)) | np.arange(len(keys), dtype=np.uint64))
        at = (both & np.uint64((1 << shift) - 1)).astype(np.int64)
        both >>= np.uint64(shift)
        new = np.append(True, both[1:] != both[:-1])
        return both[new], _places(at, np.cumsum(new) - 1)
    # A part of the key's hash and the place in one number; unequal keys that share the part are sorted plainly.
    both = np.sort((mix(keys) >> np.uint64(shift) << np.uint64(shift)) | np.arange(len(keys), dtype=np.uint64))
    at = (both & np.uint64((1 << shift) - 1)).astype(np.int64)
    both >>= np.uint64(shift)
    new = np.append(True, both[1:] != both[:-1])
    sorted_ = keys[at]
    if (new[1:] != (sorted_[1:] != sorted_[:-1])).any():
        at = np.argsort(keys, kind="stable")
        sorted_ = keys[at]
        new = np.append(True, sorted_[1:] != sorted_[:-1])
    distinct = sorted_[new]
    order = np.argsort(distinct)
    return distinct[order], _places(at, _places(order, np.arange(len(order)))[np.cumsum(new) - 1])


def _places(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), np.int64)
    out[at] = values
    return out


def _gram_part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the trie: by the two bytes before the symbol."""
    return (mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(parts)).astype(np.int64)


def _word_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys % np.uint64(parts)).astype(np.int64)


class _Chunk:
    """Distinct n-grams and words of a chunk, ascending inside each part, and where its texts use them."""

    def __init__(self, rows: pa.Table, order: int, parts: int):
        text = rows["text"].combine_chunks()
        raw = Words(text)
        self.gram_text, grams = grams_of(raw, order)
        lower = Words(text, lower=True)
        n = rows.num_rows
        self.word_text = np.append(lower.text, np.arange(n))
        hashes = np.append(np.maximum(lower.hash, _END_WORD + np.uint64(1)), np.full(n, _END_WORD))
        self.grams = self._by_part(*_unique(grams), parts, _gram_part)
        self.words = self._by_part(*_unique(hashes), parts, _word_part)

    @staticmethod
    def _by_part(keys, place, parts, part_of):
        part = part_of(keys, parts)
        order = np.argsort(part, kind="stable")
        new_place = np.empty(len(keys), np.int64)
        new_place[order] = np.arange(len(keys))
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        return keys[order], new_place[place], bounds


def _ask(order: int, parts: int):
    def run(rows: pa.Table) -> pa.Table:
        chunk = rows["chunk"][0].as_py()
        it = _Chunk(rows, order, parts)
        train = ~rows["held_out"].to_numpy().astype(bool)
        counts = []
        for (keys, place, _), text in ((it.grams, it.gram_text), (it.words, it.word_text)):
            counts.append(np.bincount(place[train[text]], minlength=len(keys)).astype(np.int64))
        bodies = []
        for p in range(parts):
            piece = []
            for (keys, _, bounds), count in zip((it.grams, it.words), counts):
                span = slice(bounds[p], bounds[p + 1])
                piece += [keys[span], count[span]]
            bodies.append(_pack(*piece))
        return _parcels(range(parts), [chunk] * parts, [chunk // FAN_IN] * parts, bodies)

    return run


def _parcels(part, chunk, slice_, body) -> pa.Table:
    ints = [pa.array(x, pa.int32()) for x in (part, chunk, slice_)]
    return pa.table([*ints, pa.array(body, pa.binary())], ["part", "chunk", "slice", "body"])


_REQUEST = (np.uint64, np.int64, np.uint64, np.int64)


def _sum_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    trained = counts > 0
    order = np.argsort(keys[trained], kind="stable")
    keys, counts = keys[trained][order], counts[trained][order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _merge(rows: pa.Table) -> pa.Table:
    """Trained n-grams and words of up to FAN_IN pieces of one part as one piece."""
    pieces = [_unpack(b, *_REQUEST) for b in rows["body"].to_pylist()]
    grams = _sum_up([p[0] for p in pieces], [p[1] for p in pieces])
    words = _sum_up([p[2] for p in pieces], [p[3] for p in pieces])
    slice_ = rows["slice"][0].as_py()
    return _parcels([rows["part"][0].as_py()], [-1], [slice_ // FAN_IN], [_pack(*grams, *words)])


class Trie:
    """Orders 2 and more of one part of the trie, over the dense orders 0 and 1."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int):
        self.order = order
        self.keys, self.counts = [None] * (order + 1), [None] * (order + 1)
        for j in range(order, 1, -1):
            cut, place = _unique(grams & np.uint64((1 << 8 * (j + 1)) - 1))
            self.keys[j] = cut
            self.counts[j] = np.bincount(place, counts, len(cut)) if len(cut) else np.zeros(0)
        dense = np.flatnonzero(pairs.ravel())
        self.keys[1], self.counts[1] = dense.astype(np.uint64), pairs.ravel()[dense].astype(float)
        single = pairs.sum(axis=0)
        dense = np.flatnonzero(single)
        self.keys[0], self.counts[0] = dense.astype(np.uint64), single[dense].astype(float)
        self.nodes = []
        for j in range(order + 1):
            node, place = _unique(self.keys[j] >> np.uint64(8))
            total = np.bincount(place, self.counts[j], len(node)) if len(node) else np.zeros(0)
            kinds = np.bincount(place, minlength=len(node)).astype(float) if len(node) else np.zeros(0)
            below = np.zeros(len(node))  # what the symbols of this node count in the next shorter context
            if j and len(node):
                shorter, _ = self._count(j - 1, self.keys[j] & np.uint64((1 << 8 * j) - 1))
                below = np.bincount(place, shorter, len(node))
            self.nodes.append((node, total, kinds, below))

    def _count(self, j: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _look_up(self.keys[j], self.counts[j], keys)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each n-gram's last byte after the bytes before it."""
        out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        gone_total, gone_kinds = np.zeros(len(grams)), np.zeros(len(grams))
        for j in range(self.order, -1, -1):
            key = grams & np.uint64((1 << 8 * (j + 1)) - 1)
            node, total, kinds, below = self.nodes[j]
            t, seen = _look_up(node, total, key >> np.uint64(8))
            d, _ = _look_up(node, kinds, key >> np.uint64(8))
            b, _ = _look_up(node, below, key >> np.uint64(8))
            left, new = t - gone_total, d - gone_kinds
            use = open_ & seen & (new > 0.5)
            n, known = self._count(j, key)
            hit, miss = use & known, use & ~known
            out[hit] += np.log10(n[hit] / (left[hit] + new[hit]))
            out[miss] += np.log10(new[miss] / (left[miss] + new[miss]))
            open_ &= ~hit
            gone_total, gone_kinds = np.where(seen, b, gone_total), np.where(seen, d, gone_kinds)
        out[open_] -= np.log10(256 - gone_kinds[open_])
        return out


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value of each wanted key (0 if there is none) and whether there is one."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[at] == wanted
    return np.where(there, values[at], 0.0), there


def _answer(order: int, pairs: np.ndarray):
    def run(asked: pa.Table, models: pa.Table) -> pa.Table:
        out, part = [], asked["part"].to_pylist()
        if asked.num_rows:
            grams, gram_counts, words, word_counts = _unpack(models["body"][0].as_py(), *_REQUEST)
            trie = Trie(grams, gram_counts, pairs, order)
            of_part = np.array([len(words), word_counts.sum()], np.int64)
            for body in asked["body"].to_pylist():
                want_grams, _, want_words, _ = _unpack(body, *_REQUEST)
                known, _ = _look_up(words, word_counts.astype(float), want_words)
                out.append(_pack(trie.log10(want_grams).astype(np.float32), known.astype(np.int64), of_part))
        return _parcels(part, asked["chunk"].to_pylist(), asked["slice"].to_pylist(), out)

    return run


def _score(order: int, parts: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        it = _Chunk(rows, order, parts)
        n = rows.num_rows
        said = dict(zip(answers["part"].to_pylist(), answers["body"].to_pylist()))
        logs, known = np.zeros(len(it.grams[0])), np.zeros(len(it.words[0]))
        kinds = tokens = 0
        for p in range(parts):
            of_grams, of_words, of_part = _unpack(said[p], np.float32, np.int64, np.int64)
            logs[it.grams[2][p] : it.grams[2][p + 1]] = of_grams
            known[it.words[2][p] : it.words[2][p + 1]] = of_words
            kinds, tokens = kinds + int(of_part[0]), tokens + int(of_part[1])
        count = known[it.words[1]]
        n_tokens = np.bincount(it.word_text, minlength=n)
        base = np.bincount(it.word_text, np.log10(count + 1), n) - n_tokens * np.log10(tokens + kinds + 1)
        found = {
            "held_out": rows["held_out"],
            "n_tokens": pa.array(n_tokens.astype(np.int64)),
            "n_known": pa.array(np.bincount(it.word_text[count > 0], minlength=n).astype(np.int64)),
            "train_tokens": pa.array(np.full(n, tokens, np.int64)),
            "base_score": pa.array(base),
            "score": pa.array(np.bincount(it.gram_text, logs[it.grams[1]], n)),
        }
        return pa.table({"row": rows["row"]} | found)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    size = 0
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part["text"])
            size += len(words.data)
            text, gram = grams_of(words, 1)
            train = ~part["held_out"].to_numpy(zero_copy_only=False).astype(bool)
            total += np.bincount(gram[train[text]].astype(np.int64), minlength=1 << 16)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"pair": np.append(at, -1), "n": np.append(total[at], size)})


def score_texts(docs: DataFrame, id_: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """`row`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score` of every row."""
    rows = packed(docs).select(
        F.col(f"row.`{text}`").alias("text"), held_out(F.col(f"row.`{id_}`")).alias("held_out"), "row"
    )
    counted = rows.select("text", "held_out").mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n"))
    pairs, size = np.zeros((256, 256), np.int64), 0
    for pair, n in counted.collect():  # at most 256 x 256 pairs, and the bytes of all texts under -1
        if pair < 0:
            size = n
        else:
            pairs[divmod(pair, 256)] = n
    chunks = max(LEAST_CHUNKS, -(-size // CHUNK_BYTES))
    parts = PARTS
    spread = F.xxhash64(F.col("text"), F.col(f"row.`{id_}`"))
    dealt = rows.withColumn("chunk", F.pmod(spread, F.lit(chunks)).cast("int"))
    asked = dealt.groupBy("chunk").applyInArrow(_ask(order, parts), _PARCEL)
    models, left = asked, chunks
    while True:
        models = models.groupBy("part", "slice").applyInArrow(_merge, _PARCEL)
        left = -(-left // FAN_IN)
        if left == 1:
            break
    slices_ = -(-chunks // FAN_IN)
    everywhere = models.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices_ - 1))))
    answers = (
        asked.groupBy("part", "slice").cogroup(everywhere.groupBy("part", "slice")).applyInArrow(_answer(order, pairs), _PARCEL)
    )
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(order, parts), schema)


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those that are not held out."""
    out = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), *out.columns[1:])
