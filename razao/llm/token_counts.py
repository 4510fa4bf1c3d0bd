"""Token counts of documents from the piece counts of distinct pre-tokens, without materialising ids.

A tokenizer's normalizer and pre-tokenizer cut every text into pre-tokens, which its model turns into pieces
one by one; so a text's token count is the sum, over its distinct pre-tokens, of frequency times pieces.

1. The distinct units of the corpus with their occurrences. A unit is a pre-token; with `runs`, for tokenizers
   whose pre-tokens hold no white space, it is a run between ASCII white space, so that the texts need no
   tokenizer: each distinct run is cut into its pre-tokens once (`units`).
2. Each distinct pre-token goes through the model once; a run's pieces are the sum of its pre-tokens'.
3. The frequencies of units in each document are joined with the pieces, and summed.

Both joins take the most frequent keys, at most `most_frequent` of them (a bound on what is sent to the
tasks), where they are, and only the others in a shuffle. A key among the others has at most 2 /
`most_frequent` of all occurrences, so none is hot.

Special strings in a text are pre-tokens of one piece, as the tokenizer's own default has it.

Rows: null and empty texts have no bytes and no tokens; texts are taken whole, of any length. Repeated rows,
equal ids and null ids are rows of their own. An empty table gives an empty result. Other columns of the
input pass through in the struct `row`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.llm.common import packed, stored, table
from razao.llm.spans import distinct_spans
from razao.llm.words import Words, slices

MOST_FREQUENT, LIMIT = 1 << 18, 2048
#: Keys longer than this are never sent to the tasks.
_LONGEST = 64
#: Bytes of text that a task cuts at once.
_SLICE_BYTES = 1 << 22


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    return tokenizer, frozenset(special), cut


def pre_tokens(path: str, text: str) -> list[str]:
    """The pre-tokens of a text, special strings among them."""
    tokenizer, _, cut = _tokenizer(path)
    out, at = [], 0
    for found in [*(cut.finditer(text) if cut else ()), None]:
        plain = text[at : found.start() if found else len(text)]
        if plain:
            normal = tokenizer.normalizer.normalize_str(plain) if tokenizer.normalizer else plain
            split = tokenizer.pre_tokenizer.pre_tokenize_str(normal) if tokenizer.pre_tokenizer else [(normal, None)]
            out += [piece for piece, _ in split if piece]
        if found:
            out.append(found.group())
            at = found.end()
    return out


def pre_tokens_of_runs(path: str, runs: list[str]) -> list[list[str]]:
    """The pre-tokens of each run without white space; all runs but unusual ones are cut by one call."""
    tokenizer, _, cut = _tokenizer(path)
    joined = " ".join(runs)
    plain = joined.split() == runs and not (cut and cut.search(joined))
    usual = runs if plain else [r for r in runs if r.split() == [r] and not (cut and cut.search(r))]
    joined = joined if plain else " ".join(usual)
    normal = tokenizer.normalizer.normalize_str(joined) if tokenizer.normalizer else joined
    ends = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 32)
    split = tokenizer.pre_tokenizer.pre_tokenize_str(normal) if usual else []
    if usual and len(ends) == len(usual) - 1:
        tokens = [piece for piece, _ in split]
        first = np.searchsorted(np.fromiter((at for _, (at, _) in split), np.int64, len(split)), ends).tolist()
        found = [tokens[a:b] for a, b in zip([0, *first], [*first, len(tokens)])]
    else:
        found = [pre_tokens(path, r) for r in usual]
    if plain:
        return found
    of = dict(zip(usual, found))
    return [of[r] if r in of else pre_tokens(path, r) for r in runs]


def pieces(path: str, token: str) -> int:
    """Number of pieces of a pre-token."""
    tokenizer, special, _ = _tokenizer(path)
    return 1 if token in special else len(tokenizer.model.tokenize(token))


def _cut(path: str, runs: bool, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text, unit and frequency of each distinct pair, and the units as strings."""
    if runs:
        words = Words(texts)
        text = words.text
        unit, values = distinct_spans(words.data, words.start, words.end)
        values = values.cast(pa.large_string())
    else:
        each = [pre_tokens(path, t or "") for t in texts.to_pylist()]
        text = np.repeat(np.arange(len(each)), [len(of) for of in each])
        found = pa.array([token for of in each for token in of], pa.large_string()).dictionary_encode()
        unit, values = found.indices.to_numpy().astype(np.int64), found.dictionary
    pair, n = np.unique(text * max(1, len(values)) + unit, return_counts=True)
    text, unit = np.divmod(pair, max(1, len(values)))
    return text, unit, n, values


def _occurrences(path: str, runs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                _, unit, n, values = _cut(path, runs, part["text"])
                often = np.bincount(unit, n, minlength=len(values)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"unit": values.cast(pa.string()), "n": pa.array(often)})

    return run


def _with_tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "unit", _SLICE_BYTES):
                tokens = pre_tokens_of_runs(path, part["unit"].to_pylist())
                yield part.append_column("tokens", pa.array(tokens, pa.list_(pa.string())))

    return run


def _with_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [pieces(path, token) for token in batch["unit"].to_pylist()]
            yield batch.append_column("pieces", pa.array(counts, pa.int64()))

    return run


def _pieces_of(tokens: DataFrame, path: str) -> DataFrame:
    """(unit, n, pieces) for distinct pre-tokens (unit, n)."""
    return stored(tokens.mapInArrow(_with_pieces(path), "unit string, n long, pieces long"), "vocabulary")


def frequent(keys: DataFrame, most: int = MOST_FREQUENT) -> DataFrame:
    """The keys (unit, n, ...) with the most occurrences: all from a power of two on, at most `most` of them."""
    level, short = F.length(F.bin("n")), F.length("unit") <= _LONGEST
    levels = keys.filter(short).groupBy(level.alias("level")).count().collect()  # 63 rows at most
    lowest, total = 64, 0
    for at, count in sorted(map(tuple, levels), reverse=True):
        total += count
        if total > most:
            break
        lowest = at
    return keys.filter(short & (level >= lowest))


def units(docs: DataFrame, path: str, text: str = "text", runs: bool = False, most: int = MOST_FREQUENT) -> DataFrame:
    """(unit, n, pieces): every distinct unit of the texts, its occurrences and its number of pieces."""
    seen = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_occurrences(path, runs), "unit string, n long")
    distinct = seen.groupBy("unit").agg(F.sum("n").alias("n"))
    if not runs:
        return _pieces_of(distinct, path)
    cut = stored(distinct.mapInArrow(_with_tokens(path), "unit string, n long, tokens array<string>"), "runs")
    rows = cut.select(F.col("unit").alias("run"), "n", F.explode("tokens").alias("unit"))
    vocabulary = _pieces_of(rows.groupBy("unit").agg(F.sum("n").alias("n")), path)
    near = F.broadcast(frequent(vocabulary, most).select("unit", "pieces"))  # at most `most` rows
    met = rows.join(near, "unit", "left")
    rest = met.filter("pieces IS NULL").drop("pieces").join(vocabulary.select("unit", "pieces"), "unit")
    priced = met.filter("pieces IS NOT NULL").select("run", "pieces").unionByName(rest.select("run", "pieces"))
    sums = priced.groupBy("run").agg(F.sum("pieces").alias("pieces"))
    # A run may hold no pre-token at all.
    out = cut.select("unit", "n").join(sums.withColumnRenamed("run", "unit"), "unit", "left").fillna(0, ["pieces"])
    return stored(out, "units")


def _sums(path: str, runs: bool, known: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE_BYTES):
                text, unit, n, values = _cut(path, runs, part["text"])
                of_unit = np.fromiter(map(lambda v: known.get(v, -1), values.to_pylist()), np.int64, len(values))
                met = of_unit[unit] >= 0
                sums = np.zeros(part.num_rows, np.int64)
                np.add.at(sums, text[met], of_unit[unit[met]] * n[met])
                at = np.searchsorted(text[~met], np.arange(part.num_rows + 1)).astype(np.int32)
                rest = values.take(pa.array(unit[~met])).cast(pa.string())
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": part["row"],
                        "n_bytes": pc.fill_null(pc.binary_length(part["text"]), 0).cast(pa.int64()),
                        "known": pa.array(sums),
                        "rest": pa.MapArray.from_arrays(pa.array(at), rest, pa.array(n[~met].astype(np.int64))),
                    }
                )

    return run


def token_counts(
    docs: DataFrame, path: str, text: str = "text", runs: bool = False, most_frequent: int = MOST_FREQUENT, keep_text: bool = True
) -> DataFrame:
    """The struct `row`, `n_bytes` (UTF-8) and `n_tokens` for every document."""
    priced = units(docs, path, text, runs, most_frequent)
    known = {r.unit: r.pieces for r in frequent(priced, most_frequent).select("unit", "pieces").collect()}
    row = F.col("row") if keep_text else F.col("row").dropFields(f"`{text}`")
    rows = packed(docs).select(row.alias("row"), F.col(f"row.`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    summed = rows.mapInArrow(_sums(path, runs, known), f"row {kind}, n_bytes long, known long, rest map<string, long>")
    summed = stored(summed.withColumn("_no", F.monotonically_increasing_id()), "known-tokens")
    others = summed.filter("size(rest) > 0").select("_no", F.explode("rest").alias("unit", "times"))
    more = others.join(priced.select("unit", "pieces"), "unit").groupBy("_no").agg(
        F.sum(F.col("times") * F.col("pieces")).alias("_more")
    )
    total = (F.col("known") + F.coalesce("_more", F.lit(0))).alias("n_tokens")
    return summed.drop("rest").join(more, "_no", "left").select("row", "n_bytes", total)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their number of tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), runs=True, keep_text=False)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit")
    )
