"""Bootstrap consensus networks: resample, compare, threshold, find communities, agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainloom.functions.portable import draw_with_replacement
from strainloom.operators import centrality as Z
from strainloom.session import cut, require_columns


@dataclass(frozen=True)
class ConsensusSettings:
    replicates: int = 100
    similarity_threshold: float = 0.35
    graph_threshold: float = 0.5
    partition_threshold: float = 0.5
    seed: int = 186
    #: Rows drawn of each node: as many as it has (None), as the smallest has ("least"), or a number.
    size: int | str | None = None


@dataclass(frozen=True)
class Consensus:
    """Tables of a run: replicate_edges, support, edges, partitions, coassignment, partition; nodes is their list."""

    nodes: list[str]
    replicate_edges: DataFrame
    support: DataFrame
    edges: DataFrame
    partitions: DataFrame
    coassignment: DataFrame
    partition: DataFrame


def replicate_similarities(rows: DataFrame, replicates: int, seed: int, size: int | str | None = None) -> DataFrame:
    """(replicate, u, v, weight): cosine of the resampled counts of each pair that shares a cluster, u < v. The rows and
    the counts are written, else each of their uses would plan (and in part run) the draws anew."""
    drawn = draw_with_replacement(cut(rows), "row_id", "node", replicates, seed, size)
    counts = cut(drawn.groupBy("replicate", "node", "cluster").agg(F.count(F.lit(1)).alias("n")))
    norms = counts.groupBy("replicate", "node").agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("s2"))
    a, b = counts.select("replicate", "cluster", F.col("node").alias("u"), F.col("n").alias("nu")), counts.select("replicate", "cluster", F.col("node").alias("v"), F.col("n").alias("nv"))
    dots = a.join(b, ["replicate", "cluster"]).where("u < v").groupBy("replicate", "u", "v").agg(F.sum(F.col("nu") * F.col("nv")).cast("double").alias("dot"))
    both = dots.join(norms.withColumnsRenamed({"node": "u", "s2": "su"}), ["replicate", "u"]).join(norms.withColumnsRenamed({"node": "v", "s2": "sv"}), ["replicate", "v"])
    return both.select("replicate", "u", "v", F.round(F.col("dot") / F.sqrt(F.col("su") * F.col("sv")), 6).alias("weight"))


def consensus_network(rows: DataFrame, settings: ConsensusSettings = ConsensusSettings()) -> Consensus:
    """The consensus of rows(row_id, node, cluster). Null keys drop out; the list of nodes is collected (node labels
    only: their number is that of the graph's vertices)."""
    require_columns(rows, ["row_id", "node", "cluster"], "consensus_network")
    rows = rows.where("node is not null and cluster is not null")
    nodes = sorted(r.node for r in rows.select("node").distinct().collect())
    sims = cut(replicate_similarities(rows, settings.replicates, settings.seed, settings.size))
    edges = sims.where(F.col("weight") > settings.similarity_threshold)
    support = edges.groupBy("u", "v").agg(F.round(F.count(F.lit(1)) / F.lit(float(settings.replicates)), 6).alias("support"))
    partitions = cut(Z.replicate_communities(edges, nodes, seed=settings.seed))
    together = Z.coassignment(partitions, replicates=settings.replicates)
    kept = support.where(F.col("support") >= settings.graph_threshold).select("u", "v", F.col("support").alias("weight"))
    return Consensus(nodes, edges, support, kept, partitions, together, Z.consensus_partition(together, nodes, settings.partition_threshold))


def threshold_grid(rows: DataFrame, similarity: list[float], support: list[float], replicates: int = 100, seed: int = 186) -> DataFrame:
    """(similarity_threshold, graph_threshold, n_edges) for every combination, from one table of similarities."""
    sims = replicate_similarities(rows, replicates, seed)
    grid = rows.sparkSession.createDataFrame([(s,) for s in similarity], "similarity_threshold double")
    cuts = rows.sparkSession.createDataFrame([(c,) for c in support], "graph_threshold double")
    shares = sims.join(F.broadcast(grid), F.col("weight") > F.col("similarity_threshold")).groupBy("similarity_threshold", "u", "v").agg((F.count(F.lit(1)) / F.lit(float(replicates))).alias("s"))
    return shares.crossJoin(F.broadcast(cuts)).groupBy("similarity_threshold", "graph_threshold").agg(F.count_if(F.col("s") >= F.col("graph_threshold")).alias("n_edges"))
