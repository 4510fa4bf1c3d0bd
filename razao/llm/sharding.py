"""Sharding by balanced label propagation, in DataFrame functions only. Law: `bytes`, sizes near equal.

Rows that share a link key are linked through the first row of their key (a star, never all pairs). The
linked rows start spread over the shards. In each round half of them, chosen by a hash, count the shards of
their neighbours (a join and an aggregate) and ask to move to the shard that most neighbours are in. What may
move from one shard to another is a quota: the bytes that want to go the opposite way, and a share of the
room that the target has below the even size. Movers are taken by gain, then by hash, until the quota is
used; the cut is found on sums for each bin of a fixed number, so no task ranks all movers. Rows without
links fill the shards up to the even size, the larger ones first, so that sizes end nearly equal.

Rows: a null text has no bytes and no link; equal empty texts are linked as any other equal texts. Repeated
rows are rows of their own. An empty table gives an empty result. Columns of the input pass through in the
struct `row`, whatever their names are. Only sums for each shard, or pair of shards, reach the driver. Rows are
numbered as they are read, so another split of the same input may give other shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from razao.llm.common import packed, root_bins, running_total, stored, table

SHARDS, ROUNDS = 24, 8
_GAINS, _BINS = 8, 1024


def row_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _loads(rows: DataFrame, shards: int) -> list[int]:
    got = dict(rows.groupBy("shard").agg(F.sum("size")).collect())  # at most one row per shard
    return [int(got.get(s, 0)) for s in range(shards)]


def propagate(nodes: DataFrame, edges: DataFrame, shards: int, room: int, rounds: int = ROUNDS) -> DataFrame:
    """Labels (uid, size, shard) of `nodes` (uid, size), moved along `edges` (uid, hub), no shard above `room` bytes.

    A node never moves for an equal or smaller number of neighbours. In each round another half of the nodes
    may ask, so that two neighbours do not just swap places. Three rounds in a row without a move are the end.
    """
    labels = stored(nodes.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")), "labels")
    both = stored(
        edges.select(F.col("uid").alias("node"), F.col("hub").alias("other")).unionByName(
            edges.select(F.col("hub").alias("node"), F.col("uid").alias("other"))
        ),
        "edges",
    )
    loads, still = _loads(labels, shards), 0
    for turn in range(rounds):
        asking = stored(_asking(labels, both, turn), "asking")
        flows = {(r.shard, r.to): r.bytes for r in asking.filter("to IS NOT NULL").groupBy("shard", "to").agg(F.sum("size").alias("bytes")).collect()}
        last = _admitted(asking, quotas(flows, loads, room))
        for r in last:
            loads[r.shard] -= r.bytes
            loads[r.to] += r.bytes
        still = 0 if last else still + 1
        if still == 3:
            break
        if last:
            labels = stored(_moved(asking, last), "labels")
    return labels


def _asking(labels: DataFrame, both: DataFrame, turn: int) -> DataFrame:
    """Labels with the shard a node asks `to` move to, null if it does not, and its `place` among those who ask.

    A node asks for the shard of most of its neighbours; ties go to a hash of node and shard.
    """
    seen = both.join(labels.select(F.col("uid").alias("other"), F.col("shard").alias("to")), "other")
    votes = seen.groupBy(F.col("node").alias("uid"), "to").agg(F.count("*").alias("votes"))
    nulls = {n: F.lit(None).cast(t) for n, t in (("to", "int"), ("votes", "long"))}
    own = labels.select("uid", "size", "shard").withColumns(nulls)
    both_kinds = votes.withColumns({n: F.lit(None).cast(t) for n, t in (("size", "long"), ("shard", "int"))}).unionByName(own)
    ballot = F.struct("votes", (-F.pmod(F.xxhash64("uid", "to"), F.lit(_BINS))).alias("luck"), "to")
    ballots = both_kinds.groupBy("uid").agg(
        F.max("size").alias("size"), F.max("shard").alias("shard"),
        F.collect_list(F.when(F.col("to").isNotNull(), ballot)).alias("ballots"),  # one for each shard at most
    )
    best = F.array_max("ballots")
    stays = F.coalesce(F.get(F.filter("ballots", lambda v: v["to"] == F.col("shard")), F.lit(0))["votes"], F.lit(0))
    judged = ballots.select("uid", "size", "shard", best["to"].alias("best"), best["votes"].alias("most"), stays.alias("own"))
    active = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(2)) == 0
    asks = active & (F.col("best") != F.col("shard")) & (F.col("most") > F.col("own"))
    gain = F.least(F.col("most") - F.col("own"), F.lit(_GAINS)).cast("int")
    place = (F.lit(_GAINS) - gain) * _BINS + F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(_BINS)).cast("int")
    return judged.select("uid", "size", "shard", F.when(asks, F.col("best")).alias("to"), F.when(asks, place).alias("place"))


def quotas(flows: dict[tuple[int, int], int], loads: list[int], room: int) -> dict[tuple[int, int], float]:
    """Bytes that may move from one shard to another: what wants to go the opposite way, and a share of the free room."""
    into = dict.fromkeys(range(len(loads)), 0)
    for (_, to), n in flows.items():
        into[to] += n
    return {
        (shard, to): min(n, flows.get((to, shard), 0)) + max(0, room - loads[to]) * n / into[to]
        for (shard, to), n in flows.items()
    }


def _admitted(asking: DataFrame, quota: dict[tuple[int, int], float]) -> list:
    """For each pair of shards the last place that may move, and the bytes up to it; at most shards squared rows."""
    if not quota:
        return []
    flows = asking.filter("to IS NOT NULL").groupBy("shard", "to", "place").agg(F.sum("size").alias("bytes"))
    so_far = F.sum("bytes").over(Window.partitionBy("shard", "to").orderBy("place"))
    fits = flows.withColumn("so_far", so_far).filter(F.col("so_far") <= _of_pair(quota, -1.0))
    return fits.groupBy("shard", "to").agg(F.max("place").alias("last"), F.max("so_far").alias("bytes")).collect()


def _moved(asking: DataFrame, last: list) -> DataFrame:
    """Labels after the moves."""
    moves = F.col("place") <= _of_pair({(r.shard, r.to): r.last for r in last}, -1)
    return asking.select("uid", "size", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard"))


def _of_pair(values: dict[tuple[int, int], float], otherwise: float) -> Column:
    """The value of a row's pair (shard, to), from a constant of at most shards squared numbers."""
    n = 1 + max(max(pair) for pair in values)
    flat = [values.get((shard, to), otherwise) for shard in range(n) for to in range(n)]
    within = (F.col("shard") < n) & (F.col("to") < n)
    return F.when(within, F.get(F.lit(flat), F.col("shard") * n + F.col("to"))).otherwise(F.lit(otherwise))


def _fill(rows: DataFrame, room: list[float]) -> DataFrame:
    """Deal `rows` (uid, size) out in the order of a hash, to each shard its share of the room."""
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bins, whole = root_bins(n), max(sum(room), 1e-9)
    edges, so_far = [], 0.0
    for r in room[:-1]:
        so_far += r / whole * total
        edges.append(so_far)
    key = F.xxhash64("uid")
    part = F.floor((key / F.lit(2.0**64) + 0.5) * bins)
    placed = running_total(rows.withColumn("_part", part), [], "_part", [key, F.col("uid")], F.col("size"), "at")
    middle = F.col("at") + F.col("size") / 2
    shard = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= middle)) if edges else F.lit(0)
    return placed.select("uid", "size", shard.cast("int").alias("shard"))


def shard_rows(
    docs: DataFrame, size: Column, link: Column, shards: int = SHARDS, rounds: int = ROUNDS
) -> DataFrame:
    """Columns `row` (the input row), `size`, `shard` and `slot` (0, 1, ... in each shard)."""
    uid = F.monotonically_increasing_id()  # fixed by being written
    rows = stored(packed(docs, uid=uid, size=size, link=link), "shard-rows")
    nodes = rows.select("uid", "size", "link")
    hubs = nodes.filter("link IS NOT NULL").groupBy("link").agg(F.min("uid").alias("hub"), F.count("*").alias("n"))
    hubs = stored(hubs.filter("n > 1").select("link", "hub"), "hubs")  # so that a hot link's join can be split
    linked = stored(nodes.join(hubs, "link").select("uid", "size", "hub"), "linked")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    even = total / shards
    labels = propagate(
        linked.select("uid", "size"), linked.filter("uid != hub").select("uid", "hub"), shards, int(even), rounds
    )
    alone = stored(nodes.join(linked, "uid", "left_anti").select("uid", "size"), "alone")
    mean = alone.agg(F.avg("size")).first()[0] or 0.0
    large, small = alone.filter(F.col("size") > mean), alone.filter(F.col("size") <= mean)
    large_total, small_total = alone.agg(
        F.coalesce(F.sum(F.when(F.col("size") > mean, F.col("size"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("size") <= mean, F.col("size"))), F.lit(0)),
    ).first()
    free = [max(0.0, even - load) for load in _loads(labels, shards)]
    share = large_total / max(large_total + small_total, 1)
    first = stored(labels.unionByName(_fill(large, [f * share for f in free])), "filled")
    rest = [max(0.0, even - load) for load in _loads(first, shards)]
    every = stored(first.unionByName(_fill(small, rest)), "shards")
    n = every.count()
    key = F.xxhash64("uid")
    part = F.floor((key / F.lit(2.0**64) + 0.5) * root_bins(n // shards + 1))
    slots = running_total(every.withColumn("_part", part), ["shard"], "_part", [key, F.col("uid")], F.lit(1), "slot")
    return rows.select("uid", "row").join(slots, "uid").select("row", "size", "shard", F.col("slot").cast("long").alias("slot"))


def text_key(text: Column) -> Column:
    """A key that only equal texts share; null has none."""
    return F.unhex(F.md5(text))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes; equal texts are linked."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        row_bytes(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        text_key(text).alias("key"),
    )
    out = shard_rows(docs, F.col("size"), F.col("key"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        F.col("row.text_crc32").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
