"""Bounded traversal of a concept graph and graph-aware fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmith.operators.retrieval import GRAPH_SEEDS, GRAPH_WEIGHT, RRF_K, top
from corpusmith.scratch import save


def traverse(roots: DataFrame, edges: DataFrame, hops: int, by: str = "query_id") -> DataFrame:
    """(by, concept, depth, path) from roots (by, concept): each concept once, at its
    least depth and by the first of its shortest paths. Frontiers advance by joins;
    what was visited drops out by an anti join, so paths do not multiply."""
    steps = edges.select(F.col("src").alias("concept"), F.col("dst")).distinct()
    if hops > 1:
        steps = save(steps, "steps")
    seen = roots.select(by, "concept").distinct().select(by, "concept", F.lit(0).alias("depth"), F.array("concept").alias("path"))
    frontier = seen
    for depth in range(1, hops + 1):
        reached = frontier.join(steps, "concept").groupBy(by, F.col("dst").alias("concept")).agg(F.min("path").alias("path"))
        frontier = reached.join(seen.select(by, "concept"), [by, "concept"], "left_anti").select(by, "concept", F.lit(depth).alias("depth"), F.concat("path", F.array("concept")).alias("path"))
        if depth < hops:
            # The next hop reads it twice; the plan does not grow with the hops.
            frontier = save(frontier, "frontier")
        seen = seen.unionByName(frontier)
    return seen


def lineage(root: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, relation, depth): the edges that leave what is reached; depth is the source's."""
    reached = traverse(root, edges, hops)
    return reached.select(F.col("concept").alias("src"), "depth").join(edges, "src").select("src", "dst", "relation", "depth").distinct()


def graph_scores(fused: DataFrame, links: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """(query_id, chunk_id, graph_score): from the concepts of each query's best
    fused chunks, over at most hops edges, the best confidence by depth."""
    seeds = top(fused, GRAPH_SEEDS).select("query_id", "chunk_id").join(links, "chunk_id").select("query_id", "concept").distinct()
    reached = traverse(seeds, edges, hops)
    return reached.join(links, "concept").groupBy("query_id", "chunk_id").agg(F.max(F.col("confidence") / (1.0 + F.col("depth"))).alias("graph_score"))


def graph_fuse(fused: DataFrame, scores: DataFrame, k: int, weight: float = GRAPH_WEIGHT) -> DataFrame:
    """Fused rows plus weighted graph scores; chunks that only the graph reaches come in too."""
    rows = fused.select("query_id", "chunk_id", F.col("score").alias("base")).join(scores, ["query_id", "chunk_id"], "full_outer")
    total = F.coalesce("base", F.lit(0.0)) + weight * F.coalesce("graph_score", F.lit(0.0)) / RRF_K
    return top(rows.select("query_id", "chunk_id", total.alias("score")), k)


def graph_sum(fused: DataFrame, links: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The benchmark's variant: undirected, a fixed gain for each linked pair one and two hops away, summed."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seeds = top(fused, GRAPH_SEEDS).select("query_id", "chunk_id").join(links, "chunk_id").select("query_id", "concept").distinct()
    reached = traverse(seeds, both, 2).where("depth > 0")
    gains = reached.join(links, "concept").groupBy("query_id", "chunk_id").agg(F.sum(F.lit(GRAPH_WEIGHT) / (RRF_K + F.col("depth"))).alias("gain"))
    rows = fused.select("query_id", "chunk_id", F.col("score").alias("base")).join(gains, ["query_id", "chunk_id"], "full_outer")
    return top(rows.select("query_id", "chunk_id", (F.coalesce("base", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("score")), k)


def neighbours(anchors: DataFrame, rows: DataFrame, window: int = 2) -> DataFrame:
    """Rows (doc, order, ...) within window places of an anchor (doc, order) of the same document."""
    a = anchors.select("doc", F.col("order").alias("anchor"))
    near = rows.join(a, "doc").where(F.col("order").between(F.col("anchor") - window, F.col("anchor") + window))
    return near


def ranked_links(pairs: DataFrame) -> DataFrame:
    """Links (chunk_id, concept, confidence, version) kept once, the latest confidence winning."""
    order = Window.partitionBy("chunk_id", "concept").orderBy(F.desc("version"))
    return pairs.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
