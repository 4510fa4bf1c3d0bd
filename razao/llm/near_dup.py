"""Near-duplicate detection with HyperMinHash.

A document's set is its distinct runs of `words` words. Each element's hash names one of the registers, and
the register keeps the least of a second hash as its count of leading zeros and ten bits behind them. Empty
registers borrow from others in an order fixed for each register. Documents with equal sets form a class; only
one of each class goes on. Bands of registers are hashed, and classes that share a band are candidates.

Links are found in three steps that never emit all pairs of a group:
1. Every member of a band group is compared with the group's first member by the collision-corrected Jaccard
   estimate (with five standard errors to spare); what may be similar is joined into tentative clusters.
2. Band groups that still span several clusters are compared inside, by registers only; clusters that may be
   linked are merged. Large groups are cut into tiles, each pair of blocks in a task of its own.
3. The full sets of each tentative cluster are compared exactly, and a spanning forest of the confirmed links is
   kept; components of these links are the result. A cluster beyond one tile is first confirmed along the links of
   steps 1 and 2; members that this does not link with its largest part are then compared, in tiles, with all others.
So every pair that shares a band and passes the estimate is compared exactly, or lies in one component already.

Rows: null texts and texts without words have an empty set and are linked with nothing. Texts are taken whole;
shorter ones than a run are one element. Rows with the same id are one document: what either is linked with,
both are. Rows with a null id take part under a key made from their text and have a null component if no id is
in it; one row of such a component is kept. An empty table gives an empty result. Other columns pass through
in the struct `row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.llm.common import WORD, packed, stored, table
from razao.llm.components import components
from razao.llm.words import Words, mix, slices

REGISTERS, ROWS, MANTISSA = 160, 5, 10
WORDS, PERCENT = 3, 85
TILE_BYTES, TILE_MEMBERS, TASK_BYTES, LEAST_TASKS, SPARE = 1 << 20, 2000, 1 << 20, 512, 5.0
FILTER_BITS = 1 << 26
NO_ID = 1 << 62
_U = np.uint64


def sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements of all sets (hashes, ascending in each text), their texts, and the bounds of the texts in them."""
    words = Words(texts, lower=True)
    at, key = words.windows(n)
    text = words.text[at]
    for short in range(1, n):  # texts with fewer words: the whole sequence is the one element
        of = np.flatnonzero(words.count == short)
        if len(of):
            whole = words._windows_all(short)[words.first[of]]
            key, text = np.append(key, mix(whole + _U(short))), np.append(text, of)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    key, text = key[new], text[new]
    return key, text, np.searchsorted(text, np.arange(len(texts) + 1))


def registers(key: np.ndarray, text: np.ndarray, n: int, k: int = REGISTERS) -> np.ndarray:
    """The registers of each text's set, one row a text, as 16-bit numbers; rows of empty sets mean nothing."""
    out = np.zeros((n, k), np.uint16)
    if not len(key):
        return out
    cell = text * k + ((key >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)  # ascending, as keys are
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    least = np.minimum.reduceat(mix(key ^ _U(0xA5A5A5A5)), first)
    zeros = (64 - np.frexp(least.astype(np.float64))[1]).clip(0, 63).astype(_U)
    behind = (least << np.minimum(zeros + _U(1), _U(63))) >> _U(64 - MANTISSA)
    filled = np.zeros((n, k), bool)
    filled.ravel()[cell[first]] = True
    out.ravel()[cell[first]] = ((zeros << _U(MANTISSA)) | behind).astype(np.uint16)
    return _fill(out, filled)


def _borrow(k: int) -> np.ndarray:
    """For each register the order in which it looks at the others."""
    return np.argsort(mix(np.arange(k * k, dtype=_U) + _U(77)).reshape(k, k), axis=1)


def _fill(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    k = values.shape[1]
    order = _borrow(k)
    row, register = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    out = values.copy()
    for i in range(0, len(row), 1 << 14):
        r, j = row[i : i + (1 << 14)], register[i : i + (1 << 14)]
        source = order[j, filled[r[:, None], order[j]].argmax(axis=1)]
        out[r, j] = values[r, source]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from equal registers, less the share that is equal by chance."""
    equal = (a == b).mean(axis=-1)
    ratio = np.minimum(n_a, n_b) / np.maximum(np.maximum(n_a, n_b), 1)
    chance = 0.169919487 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, (equal - chance) / (1 - chance))


def may_be_similar(a, b, n_a, n_b, percent: int) -> np.ndarray:
    """Whether sizes allow the similarity and the estimate is not five standard errors below it."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    s = percent / 100
    spare = SPARE * np.sqrt(s * (1 - s) / np.minimum(REGISTERS, np.maximum(small, 1)))
    return (100 * small >= percent * large) & (estimate(a, b, n_a, n_b) >= s - spare)


_SIGNATURE = "n_shingles long, n_bytes long, set_a long, set_b long, registers binary"


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                key, text, bounds = sets(part["text"], words)
                n = part.num_rows
                count = np.diff(bounds)
                sums = []
                for salt in (1, 2):
                    total = np.zeros(len(key) + 1, _U)
                    np.cumsum(mix(key + _U(salt)), out=total[1:])
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                signs = registers(key, text, n)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": part["row"],
                        "key": part["key"],
                        "version": part["version"],
                        "n_shingles": pa.array(count.astype(np.int64)),
                        "n_bytes": pc.binary_length(part["text"]).cast(pa.int64()),
                        "set_a": pa.array(sums[0]),
                        "set_b": pa.array(sums[1]),
                        "registers": pa.array([r.tobytes() if c else None for r, c in zip(signs, count)], pa.binary()),
                    }
                )

    return run


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(values.to_pylist()), np.uint16).reshape(len(values), -1)


def _bands(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _matrix(batch["registers"]).astype(_U)
            bands = signs.shape[1] // rows
            out = np.empty((len(signs), bands), _U)
            for b in range(bands):
                key = np.full(len(signs), b + 1, _U)
                for i in range(rows):
                    key = mix(key * _U(0x9E3779B97F4A7C15) + signs[:, b * rows + i] + _U(1))
                out[:, b] = key
            node = np.repeat(batch["node"].to_numpy(), bands)
            yield pa.RecordBatch.from_pydict({"node": node, "band": out.ravel().view(np.int64)})

    return run


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = [batch[c].to_numpy() for c in ("n_a", "n_b")]
            ok = may_be_similar(_matrix(batch["regs_a"]), _matrix(batch["regs_b"]), *n, percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


class _Forest:
    """Union of indices, by halved paths."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _tiles(rows: DataFrame, group: str, size: str, most: int) -> DataFrame:
    """Cut groups whose `size` (a column: of the whole group) is above `most` into blocks; a tile is a pair of blocks.

    Adds `tile` and `side` (0: block of both, 1: first, 2: second). Every two rows of a group meet in one tile.
    """
    blocks = F.ceil(F.col(size) / most)
    rows = rows.withColumn("_blocks", F.greatest(F.lit(1), blocks)).withColumn(
        "_block", F.pmod(F.xxhash64("node"), F.col("_blocks"))
    )
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    side = F.when(F.col("_block") == F.col("_other"), 0).when(F.col("_block") < F.col("_other"), 1).otherwise(2)
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    return rows.withColumn("side", side).withColumn("tile", F.struct(F.col(group), low, high)).drop(
        "_blocks", "_block", "_other"
    )


def _pairs_to_compare(side: np.ndarray, i: int) -> np.ndarray:
    """Rows behind row i that it is to be compared with: all in a tile of one block, else those of the other block."""
    behind = np.arange(i + 1, len(side))
    return behind if side[i] == 0 else behind[side[behind] != side[i]]


def _compare_groups(percent: int):
    """Edges between clusters of a band group whose registers may be similar."""

    def run(tile: pa.Table) -> pa.Table:
        order = np.argsort(tile["node"].to_numpy(), kind="stable")
        tile = tile.take(pa.array(order))
        node, n, side = (tile[c].to_numpy() for c in ("node", "n_shingles", "side"))
        _, cluster = np.unique(tile["cluster"].to_numpy(), return_inverse=True)
        signs = _matrix(tile["registers"])
        forest, edges = _Forest(int(cluster.max()) + 1), []
        for i in range(len(node) - 1):
            j = _pairs_to_compare(side, i)
            j = j[cluster[j] != cluster[i]]
            if not len(j):
                continue
            near = j[may_be_similar(signs[i], signs[j], n[i], n[j], percent)]
            for x in near.tolist():
                if forest.join(int(cluster[i]), int(cluster[x])):
                    edges.append((node[i], node[x]))
        return _edges(edges)

    return run


def _edges(edges: list) -> pa.Table:
    both = np.array(edges, np.int64).reshape(-1, 2)
    return pa.table({"a": both[:, 0], "b": both[:, 1]})


def _confirm(words: int, percent: int):
    """A spanning forest of the exact links of each tile of a group of tiles."""

    def run(rows: pa.Table) -> pa.Table:
        edges: list = []
        rows = rows.sort_by([("tile_id", "ascending"), ("node", "ascending")])
        ids = rows["tile_id"].to_numpy()
        bounds = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            tile = rows.slice(low, high - low)
            key, _, at = sets(tile["text"].combine_chunks(), words)
            node, side = tile["node"].to_numpy(), tile["side"].to_numpy()
            parts, part = np.unique(tile["part"].to_numpy(), return_inverse=True)
            forest = _Forest(len(parts))
            for i, j in _similar(key, at, side, percent):
                if forest.join(int(part[i]), int(part[j])):
                    edges.append((node[i], node[j]))
        return _edges(edges)

    return run


def _similar(key: np.ndarray, at: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of sets (slices of `key`) with 100 * intersection >= percent * union, exactly."""
    size = np.diff(at)
    if len(size) <= 6:
        for i in range(len(size)):
            for j in _pairs_to_compare(side, i).tolist():
                both = len(np.intersect1d(key[at[i] : at[i + 1]], key[at[j] : at[j + 1]], assume_unique=True))
                if 100 * both >= percent * (size[i] + size[j] - both) > 0:
                    yield i, j
        return
    member = np.repeat(np.arange(len(size)), size)
    distinct, column = np.unique(key, return_inverse=True)
    often = np.bincount(column, minlength=len(distinct)) > 1  # others are in no intersection
    new = np.cumsum(often) - 1
    member, column = member[often[column]], new[column[often[column]]]
    left, right = np.flatnonzero(side < 2), np.flatnonzero(side != 1)  # the same rows in a tile of one block
    shared = np.zeros((len(left), len(right)), np.float32)  # counts below 2 ** 24 are exact
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    step = max(256, (1 << 22) // len(size))
    for low in range(0, int(often.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        block = np.zeros((len(size), step), np.float32)
        block[member[a:b], column[a:b] - low] = 1
        shared += block[left] @ block[right].T
    union = size[left][:, None] + size[right][None, :] - shared
    linked = (100 * shared >= percent * union) & (union > 0)
    for i, of in zip(left.tolist(), linked):
        j = right[of]
        for x in (j[j > i] if side[i] == 0 else j).tolist():
            yield i, x


def _may_be_in(candidates: DataFrame) -> Column:
    """A filter on (key, version) that all candidates pass and few other rows do.

    A bitmap of hashes, built by tasks in pieces of 4 KB and no larger than FILTER_BITS: texts of
    other documents are not shuffled. Beyond what the bitmap can tell apart more of them pass.
    """
    wanted = 64 * max(1, candidates.count())
    bits = min(FILTER_BITS, max(1 << 15, 1 << (wanted - 1).bit_length()))
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(bits))
    value = place("node", "version") + 1
    pieces = candidates.groupBy(F.bitmap_bucket_number(value).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")
    )
    whole = bytearray(bits // 8)
    for piece, of in pieces.collect():  # at most FILTER_BITS in all
        whole[(piece - 1) * 4096 : piece * 4096] = of
    at = place("key", "version")
    byte = F.substring(F.lit(bytes(whole)), (at / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(at, F.lit(8)).cast("int")) == 1


def _blocks(bytes_: str, members: str) -> Column:
    """Number of blocks of a group: about TILE_BYTES and TILE_MEMBERS each at most."""
    return F.greatest(F.lit(1), F.ceil(F.col(bytes_) / TILE_BYTES), F.ceil(F.col(members) / TILE_MEMBERS))


def _stars(links: DataFrame, rows: DataFrame) -> DataFrame:
    """Place each link's `b` in a block of the star around `a`; `a` meets every block, blocks do not meet."""
    ends = links.join(rows.withColumnRenamed("node", "b"), "b").withColumnRenamed("b", "node")
    sizes = ends.groupBy("a").agg(F.sum("bytes").alias("_bytes"), F.count("*").alias("_members"))
    sizes = sizes.select("a", _blocks("_bytes", "_members").alias("_blocks"))
    ends = ends.join(sizes, "a").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")) + 1)
    heads = sizes.withColumn("node", F.col("a")).join(rows, "node").withColumn("block", F.lit(0).cast("long"))
    return _placed(ends, "a", 0, 0).unionByName(_placed(heads, "a", 1, "_blocks"))


def _open_tiles(rows: DataFrame) -> DataFrame:
    """Place the rows of clusters that still have several parts: all rows outside the largest part meet all rows."""
    parts = rows.groupBy("cluster", "part").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("members"))
    spans = parts.groupBy("cluster").agg(
        F.max(F.struct("bytes", "members", "part")).alias("main"),
        F.sum("bytes").alias("_bytes"),
        F.sum("members").alias("_members"),
        F.count("*").alias("_parts"),
    )  # two members have one link, which was compared
    spans = spans.filter("_parts > 1 and _members > 2").select(
        "cluster", F.col("main.part").alias("_main"), F.col("main.bytes").alias("_of_main"),
        F.col("main.members").alias("_in_main"), (F.col("_bytes") - F.col("main.bytes")).alias("_open"),
        (F.col("_members") - F.col("main.members")).alias("_in_open"),
    ).select(
        "cluster", "_main", _blocks("_of_main", "_in_main").alias("_m"), _blocks("_open", "_in_open").alias("_o")
    )
    here, at = rows.join(spans, "cluster"), F.xxhash64("node")
    main, m, o = F.col("part") == F.col("_main"), F.col("_m"), F.col("_o")
    here = here.withColumn("block", F.when(main, o + F.pmod(at, m)).otherwise(F.pmod(at, o)))
    return _placed(here.withColumn("_last", F.when(main, o - 1).otherwise(o + m - 1)), "cluster", 0, "_last")


def _placed(rows: DataFrame, group: str, first: int, last: int | str) -> DataFrame:
    """Rows with their `block` in a group and the first and last block of it that they are to meet."""
    last = F.col(last) if isinstance(last, str) else F.lit(last)
    return rows.select(
        "node", "version", "part", "bytes", F.col(group).alias("group"), F.col("block").cast("long").alias("block"),
        F.lit(first).cast("long").alias("first"), last.cast("long").alias("last"),
    )


def _confirmed(keyed: DataFrame, placed: DataFrame, words: int, percent: int) -> DataFrame:
    """The exact links between blocks that meet. A task holds about TASK_BYTES of what is sent, copies included."""
    placed = stored(placed, "placed-texts")
    sent = placed.agg(F.coalesce(F.sum(F.col("bytes") * (F.col("last") - F.col("first") + 1)), F.lit(0))).first()[0]
    if not sent:
        return keyed.sparkSession.createDataFrame([], "a long, b long")
    tasks = max(LEAST_TASKS, sent // TASK_BYTES)  # groups of tiles, so that small clusters do not cost a call each
    wanted = keyed.select("key", "version", "text").filter(_may_be_in(placed))
    wanted = wanted.groupBy("key", "version").agg(F.first("text").alias("text"))  # repeated rows are one
    texts = wanted.join(placed.withColumnRenamed("node", "key"), ["key", "version"])
    texts = texts.withColumn("other", F.explode(F.sequence("first", "last")))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    tile_id = F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other"))
    return (
        texts.select(F.col("key").alias("node"), "part", "text", side.alias("side"), tile_id.alias("tile_id"))
        .withColumn("_task", F.pmod("tile_id", F.lit(tasks)))
        .groupBy("_task")
        .applyInArrow(_confirm(words, percent), "a long, b long")
    )


def _with_parts(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of large clusters with the component of the links confirmed so far as their `part`."""
    nodes = rows.select(F.col("node").alias("a")).distinct()
    of = components(links.join(nodes, "a", "left_semi")).withColumnRenamed("component", "_part")
    return stored(
        rows.join(of, "node", "left").withColumn("part", F.coalesce("_part", "node")).drop("_part"), "parts"
    )


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = ROWS, id_: str = "doc_id", text: str = "text",
    apart: bool = False,
) -> DataFrame:
    """(key, version, row without the text, n_shingles, component): `component` is the least key that is reachable.

    With `apart`, rows of one id and different texts are documents of their own, and `key` is a hash of both.
    """
    keyed = _keyed(docs, id_, text, apart).select(F.col("row").dropFields(text).alias("row"), "key", "version", "text")
    kind = keyed.schema["row"].dataType.simpleString()
    signed = stored(
        keyed.mapInArrow(_sign(words), f"row {kind}, key long, version long, {_SIGNATURE}"), "signatures"
    )
    # One document for each distinct set.
    found = signed.filter("n_shingles > 0")
    first = F.min(F.struct("key", "version", "registers", "n_bytes"))
    classes = stored(
        found.groupBy("set_a", "set_b", "n_shingles").agg(first.alias("first")).select(
            "set_a", "set_b", "n_shingles", F.col("first.key").alias("node"), "first.version", "first.registers", "first.n_bytes"
        ),
        "classes",
    )
    bands = stored(classes.select("node", "registers").mapInArrow(_bands(rows), "node long, band long"), "bands")
    groups = bands.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("_last")).filter("head < _last")
    shared = stored(groups.select("band", "head"), "band-groups")
    members = stored(bands.join(shared, "band").select("band", "node", "head"), "band-members")

    # 1. Members against the first of their group, by estimate.
    signs = classes.select("node", "n_shingles", "registers")
    a = signs.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("regs_a"))
    b = signs.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("regs_b"))
    pairs = members.filter("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    likely = pairs.join(a, "a").join(b, "b").mapInArrow(_likely(percent), "a long, b long")
    likely = stored(likely, "likely")
    clusters = components(likely)  # of up to a link for each band of a node, one a node is followed

    # 2. Groups that span clusters, by registers inside the group.
    placed = members.join(clusters, "node", "left").select(
        "band", "node", F.coalesce("component", "node").alias("cluster")
    )
    placed = stored(placed, "placed")
    spans = placed.groupBy("band").agg(
        F.min("cluster").alias("_low"), F.max("cluster").alias("_high"), F.count("*").alias("members")
    )
    open_ = placed.join(spans.filter("_low < _high").select("band", "members"), "band")
    tiles = _tiles(open_.join(signs, "node"), "band", "members", TILE_MEMBERS)
    more = tiles.groupBy("tile").applyInArrow(_compare_groups(percent), "a long, b long")
    more = stored(more, "likely")
    clusters = components(more, start=clusters)
    likely = likely.unionByName(more)

    # 3. Full sets of each cluster.
    weight = F.greatest(F.col("n_shingles") * 8, "n_bytes")
    candidates = classes.join(clusters, "node").select(
        "node", "version", weight.alias("bytes"), F.col("component").alias("cluster"), F.col("node").alias("part")
    )
    candidates = stored(candidates, "candidates")
    sizes = candidates.groupBy("cluster").agg(F.sum("bytes").alias("_bytes"), F.count("*").alias("_members"))
    sizes = sizes.select("cluster", (_blocks("_bytes", "_members") > 1).alias("large"))
    candidates = stored(candidates.join(sizes, "cluster"), "candidates")
    small, large = candidates.filter("not large"), candidates.filter("large")
    small = _placed(small.withColumn("block", F.lit(0)), "cluster", 0, 0)
    one = likely.groupBy("b").agg(F.min("a").alias("a"))
    confirmed = stored(_confirmed(keyed, small.unionByName(_stars(one, large)), words, percent), "confirmed")
    if large.limit(1).count():
        large = _with_parts(large, confirmed)
        of_a, of_b = (large.select(F.col("node").alias(c), F.col("part").alias(f"of_{c}")).distinct() for c in "ab")
        rest = likely.distinct().join(of_a, "a").join(of_b, "b").filter("of_a != of_b").select("a", "b")
        more = _confirmed(keyed, _stars(rest, large), words, percent)
        confirmed = stored(confirmed.unionByName(more), "confirmed")
        large = _with_parts(large, confirmed)
        more = _confirmed(keyed, _open_tiles(large), words, percent)
        confirmed = stored(confirmed.unionByName(more), "confirmed")
    linked = components(confirmed)

    of_class = classes.join(linked, "node", "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    of_class = stored(of_class, "class-components")
    out = signed.select("key", "version", "row", "n_shingles", "set_a", "set_b").join(
        of_class, ["set_a", "set_b", "n_shingles"], "left"
    )
    return out.select("key", "version", "row", "n_shingles", F.coalesce("component", "key").alias("component"))


def _keyed(docs: DataFrame, id_: str, text: str, apart: bool = False) -> DataFrame:
    """Every row with the key of its document and a version that tells texts of one key apart."""
    value = F.col(f"row.`{text}`")
    no_id = F.lit(NO_ID) + F.pmod(F.xxhash64(value), F.lit(NO_ID))
    id_of = F.col(f"row.`{id_}`").cast("long")
    return packed(docs).select(
        "row",
        (F.xxhash64(id_of, value) if apart else F.coalesce(id_of, no_id)).alias("key"),
        F.xxhash64(value).alias("version"),
        value.alias("text"),
    )


def one_of_each(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = ROWS, id_: str = "doc_id", text: str = "text",
    apart: bool = False,
) -> DataFrame:
    """The input with one row of each component, the one with the least id; repeated rows are one.

    With `apart`, only rows that are linked by their sets or wholly repeated are reduced to one, also if ids are reused.
    """
    if apart:
        number = F.coalesce(F.col(f"row.`{id_}`").cast("long"), F.lit(NO_ID))
        found = near_duplicates(docs, words, percent, rows, id_, text, apart).filter("n_shingles > 0")
        least = found.groupBy("component").agg(F.min(F.struct(number.alias("number"), "version", "key")).alias("least"))
        kept = least.select("least.key", "least.version")
        both = _keyed(docs, id_, text, apart).select("row", "key", "version").join(kept, ["key", "version"], "left_semi")
        empty = docs.filter(~F.coalesce(F.col(f"`{text}`").rlike(WORD), F.lit(False)))
        return both.dropDuplicates(["key", "version"]).select("row.*").unionByName(empty.dropDuplicates())
    found = near_duplicates(docs, words, percent, rows, id_, text).filter("key = component")
    kept = found.groupBy("key").agg(F.min("version").alias("version"))
    both = _keyed(docs, id_, text).select("row", "key", "version").join(kept, ["key", "version"], "left_semi")
    return both.dropDuplicates(["key", "version"]).select("row.*")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their component of near-duplicates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(docs)
    known = F.when(F.col("component") < NO_ID, F.col("component"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_shingles",
        known.alias("component_id"),
        (F.col("key") == F.col("component")).alias("kept"),
    )
