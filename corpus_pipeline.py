"""A corpus pipeline: stages over documents, each calling one operator of razao.llm.

Every stage takes all rows its predecessor kept and returns the columns of documents, in the same types; the
last adds `size`, `shard` and `slot`. Nulls, repeated rows and other columns are treated as the operators'
docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from razao.llm import decontaminate, mixing, near_dup, quality_rules, sharding
from razao.llm.common import table
from razao.session import materialize

#: Runs of five words, similarity 0.8; bands of four registers, so that no such pair is missed.
NEAR_WORDS, NEAR_PERCENT, NEAR_ROWS = 5, 80, 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    weights = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, weights).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return near_dup.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT, NEAR_ROWS, apart=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).filter("size(matches) = 0").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a document is repeated, or left out, by its source's target.

    The mix takes whole epochs of a source and a part of one, cut inside one document; that one stays if at
    least half of it was taken.
    """
    rows, _ = mixing.mix(docs)
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    return rows.select("row", copies.alias("copies")).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    out = sharding.shard_rows(docs, sharding.row_bytes(F.col("text")), sharding.text_key(F.col("text")))
    names = ("size", "shard", "slot")  # of columns with these names the operator's replace the input's
    return out.select(*[f"row.`{c}`" for c in docs.columns if c.lower() not in names], *names)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shard),
]
#: Weights of n-grams, edit distances and label propagation are not for SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
