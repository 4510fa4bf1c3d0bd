"""Benchmark decontamination by pigeonhole edit matching.

Documents and test items are brought to one form: lower case, runs of ASCII characters that are no letter or
digit as one space. An item of n bytes may be changed by up to n // 12 byte edits. It is split into one piece
more than that, so a changed copy still holds one piece unchanged. All places of a document are looked up
among the pieces' first bytes (up to 8, as one number); the places where the whole piece stands are extended
to the item's length and the budget on both sides, and the item's edit distance to the best substring of that
stretch is computed with Myers' bit-parallel recurrence, for all places of a slice of documents at once.

The items are a stated query set: they are read in blocks of bounded bytes, and each block is one more step of
the same map over the documents. Documents are never shuffled.

Rows: null and empty texts, and items without a letter or digit, match nothing. Texts are taken whole. Equal
items are all reported. Repeated rows are rows of their own; null item ids are reported as null. Empty tables
give no matches. Other columns of the input pass through in the struct `row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.llm.common import packed, table
from razao.llm.words import Words, normal_form, slices

BYTES_PER_EDIT, BLOCK_BYTES, SLICE = 12, 4 << 20, 4 << 20
_KEY = 8
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_MATCHES = "array<struct<item_id:bigint,distance:int>>"
_U = np.uint64


def _form(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' common form in one buffer (a space behind every word) and the bounds of the texts in it."""
    words = Words(texts, gap=_GAP)
    form, bounds = normal_form(words)
    return form, bounds[words.first]


class _Items:
    """Test items in common form, cut into pieces."""

    def __init__(self, ids: list, texts: list, bytes_per_edit: int):
        form, bounds = _form(pa.array(texts, pa.string()))
        self.ids, self.texts, self.budget = [], [], []
        pieces = []
        for id_, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist()):
            if b == a:
                continue
            text = form[a : b - 1]
            budget = len(text) // bytes_per_edit
            cuts = np.linspace(0, len(text), budget + 2).astype(int)
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                pieces.append((min(_KEY, high - low), text[low:high].tobytes(), len(self.ids), low))
            self.ids.append(id_)
            self.texts.append(text)
            self.budget.append(budget)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.array(self.budget, np.int64)
        self.by_width = {}
        for width in sorted({p[0] for p in pieces}):
            of = [p for p in pieces if p[0] == width]
            key = np.array([int.from_bytes(p[1][:width], "little") for p in of], _U)
            order = np.argsort(key, kind="stable")
            of, key = [of[i] for i in order], key[order]
            seen = np.zeros(1 << 18, bool)
            seen[_fold(key)] = True
            self.by_width[width] = (
                key, seen, [p[1] for p in of], np.array([p[2] for p in of]), np.array([p[3] for p in of]),
            )


def _fold(key: np.ndarray) -> np.ndarray:
    return ((key * _U(0x9E3779B97F4A7C15)) >> _U(46)).astype(np.int64)


def _hits(form: np.ndarray, items: _Items) -> tuple[np.ndarray, np.ndarray]:
    """Item and supposed start (in the buffer) for every place where a whole piece stands; distinct."""
    ahead = np.zeros(len(form), _U)
    for i in range(min(_KEY, len(form))):
        ahead[: len(form) - i] |= form[i:].astype(_U) << _U(8 * i)
    found_item, found_start = [], []
    for width, (key, seen, pieces, item, offset) in items.by_width.items():
        here = ahead if width == _KEY else ahead & _U((1 << 8 * width) - 1)
        at = np.flatnonzero(seen[_fold(here)])
        low, high = np.searchsorted(key, here[at], "left"), np.searchsorted(key, here[at], "right")
        n = high - low
        place = np.repeat(at, n)
        piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        data = form.tobytes() if len(piece) else b""
        whole = np.array(
            [data.startswith(pieces[p], a) for p, a in zip(piece.tolist(), place.tolist())], bool
        )
        found_item.append(item[piece[whole]])
        found_start.append(place[whole] - offset[piece[whole]])
    if not found_item:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(found_item), np.concatenate(found_start)]), axis=1)
    return both[0], both[1]


def myers(patterns: list[np.ndarray], which: np.ndarray, form: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least edit distance of pattern `which[i]` to a substring of form[low[i]:high[i]], for all i at once."""
    best = np.zeros(len(which), np.int64)
    size = np.array([len(p) for p in patterns], np.int64)
    words = (size + 63) // 64
    for w in np.unique(words[which]):
        of = np.flatnonzero(words[which] == w)
        of = of[np.argsort(low[of] - high[of], kind="stable")]  # longest stretch first
        kinds, kind = np.unique(which[of], return_inverse=True)
        peq = np.zeros((len(kinds), 256, int(w)), _U)
        for k, p in enumerate(kinds.tolist()):
            i = np.arange(size[p])
            np.bitwise_or.at(peq[k], (patterns[p], i // 64), _U(1) << (i % 64).astype(_U))
        best[of] = _myers(peq, kind, size[which[of]], form, low[of], high[of] - low[of])
    return best


def _myers(peq, kind, size, form, low, length) -> np.ndarray:
    n, w = len(kind), peq.shape[2]
    plus, minus = np.full((w, n), ~_U(0)), np.zeros((w, n), _U)
    score, best = size.copy(), size.copy()
    last = ((size - 1) % 64).astype(_U)
    one = _U(1)
    for j in range(int(length[0]) if n else 0):
        live = int(np.searchsorted(-length, -j, "left"))  # rows are sorted by falling length
        char = form[low[:live] + j]
        equal_all = peq[kind[:live], char]
        carry_plus = carry_minus = np.zeros(live, _U)
        for b in range(w):
            equal, pv, mv = equal_all[:, b], plus[b, :live], minus[b, :live]
            xv = equal | mv
            equal = equal | carry_minus
            xh = (((equal & pv) + pv) ^ pv) | equal
            ph, mh = mv | ~(xh | pv), pv & xh
            if b == w - 1:
                score[:live] += ((ph >> last[:live]) & one).astype(np.int64) - ((mh >> last[:live]) & one).astype(np.int64)
            next_plus, next_minus = ph >> _U(63), mh >> _U(63)
            ph, mh = (ph << one) | carry_plus, (mh << one) | carry_minus
            plus[b, :live], minus[b, :live] = mh | ~(xv | ph), ph & xv
            carry_plus, carry_minus = next_plus, next_minus
        best[:live] = np.minimum(best[:live], score[:live])
    return best


def _match(items: _Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                form, bounds = _form(part["text"])
                item, start = _hits(form, items)
                # The piece lies in one text; so does the stretch around it. A piece ends before the text does.
                middle = start + items.size[item] // 2
                text = np.clip(np.searchsorted(bounds, np.clip(middle, 0, len(form) - 1), "right") - 1, 0, part.num_rows - 1)
                slack = items.budget[item]
                found: list[dict] = [{} for _ in range(part.num_rows)]
                for t in (text - 1, text, text + 1):  # the piece may lie in a neighbour of the middle's text
                    fits = (t >= 0) & (t < part.num_rows)
                    i, s, at, k = item[fits], start[fits], t[fits], slack[fits]
                    low = np.maximum(s - k, bounds[at])
                    high = np.minimum(s + items.size[i] + k, bounds[at + 1] - 1)
                    long = high - low >= items.size[i] - k
                    i, at, k, low, high = i[long], at[long], k[long], low[long], high[long]
                    distance = myers(items.texts, i, form, low, high) if len(i) else np.zeros(0, np.int64)
                    near = distance <= k
                    for a, x, d in zip(at[near].tolist(), i[near].tolist(), distance[near].tolist()):
                        found[a][x] = min(d, found[a].get(x, d))
                old = part["matches"].to_pylist()
                new = [
                    o + [{"item_id": items.ids[x], "distance": d} for x, d in sorted(f.items())]
                    for o, f in zip(old, found)
                ]
                columns = [part["row"], part["text"], pa.array(new, part["matches"].type)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "text", "matches"])

    return run


def find_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", bytes_per_edit: int = BYTES_PER_EDIT, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The struct `row` and `matches`, an array of (item_id, distance), for every document. `items`: item_id, text."""
    rows = packed(docs).select("row", F.lower(F.col(f"row.`{text}`")).alias("text"))
    rows = rows.withColumn("matches", F.array().cast(_MATCHES))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, matches {_MATCHES}"
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).filter("text IS NOT NULL")
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes)
    for b in range(blocks):
        of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b
        block = sorted(plain.filter(of).collect(), key=lambda r: (r[0] is None, r[0], r[1]))  # about block_bytes
        rows = rows.mapInArrow(_match(_Items([r[0] for r in block], [r[1] for r in block], bytes_per_edit)), schema)
    return rows.select("row", "matches")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark items they hold; those with any are not kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("matches", lambda m: m["item_id"]))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("matches").cast("long").alias("n_items"),
        ids.alias("item_ids"),
        F.array_min(F.transform("matches", lambda m: m["distance"])).alias("least_distance"),
        (F.size("matches") == 0).alias("kept"),
    )
