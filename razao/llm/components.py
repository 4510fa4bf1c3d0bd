"""Connected components by hooking and contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from razao.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b", start: DataFrame | None = None) -> DataFrame:
    """(node, component) for every node of `edges`, and of `start`; the component is its smallest node.

    In each round every node hooks to its smallest neighbour below it, so one link a node goes on into the
    trees; trees are flattened by pointer doubling, and links are renamed to the trees' roots. Links inside a
    tree vanish, equal ones become one. All nodes but those without a smaller neighbour hook, so at most
    half of the nodes are left after a round. Minima are taken before the shuffle, so nodes of any degree
    are fine. Each round is written to shared storage.

    `start` are components that are known already; then only links between different ones are followed.
    """
    ends = edges.select(F.col(a).alias("low"), F.col(b).alias("high"))
    nodes = ends.select(F.explode(F.array("low", "high")).alias("node")).distinct()
    if start is None:
        found, links = nodes.select("node", F.col("node").alias("component")), ends
    else:
        new = nodes.join(start, "node", "left_anti").select("node", F.col("node").alias("component"))
        found, links = start.unionByName(new), _renamed(ends, start.withColumnRenamed("component", "root"))
    found, links = stored(found, "components"), stored(_between(links), "links")
    while links.limit(1).count():
        roots = _roots(stored(links.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")), "hooks"))
        to = roots.select(F.col("node").alias("component"), "root")
        found = stored(
            found.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component")),
            "components",
        )
        links = stored(_between(_renamed(links, roots)), "links")
    return found


def _between(links: DataFrame) -> DataFrame:
    """Links (low, high), each once, the smaller node first; none from a node to itself."""
    low, high = F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")
    return links.filter("low != high").select(low, high).distinct()


def _renamed(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links with their ends replaced by the ends' roots (node, root), if they have one."""
    for end in ("low", "high"):
        of_end = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        links = links.join(of_end, end, "left")
    return links.select(F.coalesce("low_root", "low").alias("low"), F.coalesce("high_root", "high").alias("high"))


def _roots(up: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, root) in which roots have no row; distances double each turn."""
    while True:
        further = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
        up = stored(up.join(further, "root", "left").select("node", F.coalesce("further", "root").alias("root"), "further"), "roots")
        if not up.filter("further IS NOT NULL").limit(1).count():
            return up.drop("further")
        up = up.drop("further")
