"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Every source's rows are shuffled (by a hash of the id) into one stream of tokens, which is cut into blocks of
equal length. Golden-ratio points are mapped through the cumulative target shares: point i names the source
that slot i takes from. The slots of a source are ranked in schedule order; rank r takes block r modulo the
number of blocks, so a source is repeated in whole epochs. A source stops at its quota, its last slot takes
the remaining tokens only, and slots that the points left a source short of are added at the end.

Targets: sources in code-point order, null last, weigh 5, 2, 1 repeating. No target exceeds `most` times its
source; the excess goes to the other sources by weight until none is above.

Rows: a null text has size 0; rows of size 0 are taken 0 times; a null source is a source of its own. Repeated
rows are rows of their own and keep the order (hash, id, size). An empty table, or one without any word, gives
every row a target of 0. Columns of the input pass through in the struct `row`, whatever their names are. The
table of sources goes through one window and a few aggregates on the driver's side of a loop; rows never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from razao.llm.common import WORD, packed, root_bins, running_total, stored, table

WEIGHTS, MOST, BLOCK_TOKENS = (5, 2, 1), 3, 4096
_GOLDEN, _STEP = 0.6180339887498949, 1 << 20


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add `sid` and `target` to a table (source, source_size): all sizes shared by weight, none above its cap."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = stored(sources.withColumn("sid", place).withColumn("weight", weight.cast("long")), "sources")
    cap = F.col("source_size") * most
    full = F.lit(False)
    while True:
        rest, heavy, capped = rows.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)) - F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(full.cast("long")), F.lit(0)),
        ).first()
        share = F.lit(rest) * F.col("weight") / F.lit(max(heavy, 1))
        above = full | (share > cap)  # shares only rise, so a full source stays full
        if rows.filter(above).count() == capped:
            return rows.withColumn("target", F.when(full, cap.cast("double")).otherwise(share))
        # The rule is kept as data, not as an expression that grows with the rounds.
        rows = stored(rows.withColumn("_full", above), "targets").select(
            "source", "source_size", "sid", "weight", "_full"
        )
        full = F.col("_full")


def _points(i: Column) -> Column:
    """The golden-ratio sequence; split in two so that no digits are lost for large i."""
    step = (_GOLDEN * _STEP) % 1
    at = F.floor(i / _STEP) * step
    return (at - F.floor(at) + F.pmod(i, F.lit(_STEP)) * _GOLDEN) % 1


def mix(
    docs: DataFrame,
    source: str = "source",
    size: Column | None = None,
    id_: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    block: int = BLOCK_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """Rows with `row`, `size`, `source_size`, `target`, `taken`; and the schedule (slot, source, block, epoch, tokens)."""
    spark = docs.sparkSession
    size = n_words(F.col("text")) if size is None else size
    uid = F.monotonically_increasing_id()  # fixed by being written; only narrow rows are ordered below
    rows = stored(packed(docs, uid=uid, size=size, source=F.col(f"`{source}`"), id=F.col(f"`{id_}`")), "mix-rows")
    sized = rows.select("uid", "size", "source", "id")
    sources = targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")).drop("_rows"),
        weights,
        most,
    )
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    rest = F.floor(F.col("target")) - whole * F.col("source_size")
    blocks = F.ceil(F.col("source_size") / block)
    plan = stored(
        sources.withColumn("blocks", blocks)
        .withColumn("rest", rest)
        .withColumn("quota", (whole * blocks + F.ceil(rest / block)).cast("long")),
        "mix-plan",
    )
    schedule = stored(_schedule(spark, plan, block), "mix-schedule")

    n = sized.count()  # a count of rows; no column is read
    bins = root_bins(n)
    shuffled = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    at = F.conv(F.substring(shuffled, 1, 8), 16, 10).cast("long")
    known = sized.join(plan.select("source", "sid", "source_size", "target"), sized["source"].eqNullSafe(plan["source"]))
    keyed = known.select("uid", "size", "id", "sid", "source_size", "target", shuffled.alias("_key")).withColumn(
        "_part", F.floor(at * bins / (1 << 32))
    )
    placed = running_total(keyed, ["sid"], "_part", [F.col("_key"), F.col("id"), F.col("size")], F.col("size"), "start")

    # Tokens of each block that its slots take: whole blocks, and a beginning of one block at the quota's end.
    tokens_of = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    uses = (
        schedule.join(plan.select("sid", "source_size"), "sid")
        .groupBy("sid", "block")
        .agg(
            F.sum((F.col("tokens") >= tokens_of).cast("long")).alias("whole_uses"),
            F.max(F.when(F.col("tokens") < tokens_of, F.col("tokens")).otherwise(0)).alias("part"),
        )
    )
    pieces = placed.filter("size > 0").select(
        "sid", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"),
    )
    low = F.greatest("start", F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    begun = F.greatest(F.lit(0), F.least(high, F.col("block") * block + F.col("part")) - low)
    taken = (
        pieces.join(uses, ["sid", "block"])
        .groupBy("sid", "start")
        .agg(F.sum(F.col("whole_uses") * (high - low) + begun).alias("taken"))
    )
    # Rows of size 0 share their start with a neighbour; a key of their own keeps them out of the join.
    left = placed.withColumn("_at", F.when(F.col("size") > 0, F.col("start")))
    out = left.join(taken.withColumnRenamed("start", "_at"), ["sid", "_at"], "left").select(
        "uid", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )
    return rows.select("uid", "row").join(out, "uid").drop("uid"), schedule


def _schedule(spark: SparkSession, plan: DataFrame, block: int) -> DataFrame:
    """One row per slot: sid, rank, epoch, block, tokens."""
    slots, count = plan.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    cells = max(1024, 4 * count)
    total = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    share = F.col("quota") / F.lit(max(slots, 1))
    edges = plan.filter("quota > 0").select(
        "sid", "quota", "blocks", "rest", (F.coalesce(F.sum("quota").over(total), F.lit(0)) / F.lit(max(slots, 1))).alias("low"), share.alias("share")
    ).withColumn("high", F.col("low") + F.col("share"))
    spans = edges.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.least(F.col("high"), F.lit(1.0)) * cells)))
    )
    points = spark.range(slots).withColumn("u", _points(F.col("id"))).withColumn("cell", F.floor(F.col("u") * cells))
    named = points.join(spans, "cell").filter("u >= low AND u < high").select("sid", F.col("id").alias("slot"))
    per_bin = root_bins(slots)
    ranked = running_total(
        named.withColumn("_part", F.floor(F.col("slot") / per_bin)), ["sid"], "_part", [F.col("slot")], F.lit(1), "rank"
    ).select("sid", "slot", "rank")
    got = ranked.groupBy("sid").agg(F.count("*").alias("got"))
    short = edges.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < quota")
    extra = short.select("sid", F.explode(F.sequence("got", F.col("quota") - 1)).alias("rank")).withColumn(
        "slot", F.lit(slots) + F.col("rank")
    )
    every = ranked.unionByName(extra.select("sid", "slot", "rank")).join(
        edges.select("sid", "quota", "blocks", "rest"), "sid"
    )
    last = (F.col("rank") == F.col("quota") - 1) & (F.pmod(F.col("rest"), F.lit(block)) > 0)
    return every.filter("rank < quota").select(
        "sid", "slot", "rank",
        F.floor(F.col("rank") / F.col("blocks")).alias("epoch"),
        F.pmod("rank", "blocks").alias("block"),
        F.when(last, F.pmod(F.col("rest"), F.lit(block))).otherwise(F.lit(block)).cast("long").alias("tokens"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to the weights 5, 2, 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows, _ = mix(stored(docs, "sizes"), size=F.col("size"))
    return rows.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
r AS (
  SELECT source, source_size, weight, false AS was_full, false AS is_full, 0 AS round FROM s
  UNION ALL
  SELECT source, source_size, weight, is_full, is_full OR share > 3 * source_size, round + 1 FROM (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (is_full) OVER (), 0)) * weight
      / greatest(coalesce(sum(weight) FILTER (NOT is_full) OVER (), 0), 1) AS share FROM r) WHERE round < 40),
t AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (is_full) OVER (), 0)) * weight AS DOUBLE)
      / greatest(coalesce(sum(weight) FILTER (NOT is_full) OVER (), 0), 1) END AS target
  FROM r WHERE round = (SELECT max(round) FROM r)),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    floor(t.target / greatest(t.source_size, 1)) AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, floor(target) - whole * source_size - start)) AS BIGINT) AS taken FROM p
"""
