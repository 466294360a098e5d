"""The count table counts(node, cluster, n) and summaries of it. Null keys drop out; absent pairs are zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_table(rows: DataFrame, node: str, cluster: str) -> DataFrame:
    """counts(node, cluster, n); rows with a null node or cluster are left out."""
    kept = rows.select(F.col(node).alias("node"), F.col(cluster).alias("cluster")).where("node is not null and cluster is not null")
    return kept.groupBy("node", "cluster").agg(F.count(F.lit(1)).alias("n"))


def richness(counts: DataFrame) -> DataFrame:
    """(node, richness, n_rows, richness_rank): distinct clusters of each node, rank 1 the richest, ties share a rank."""
    sums = counts.groupBy("node").agg(F.count(F.lit(1)).alias("richness"), F.sum("n").alias("n_rows"))
    return sums.withColumn("richness_rank", F.rank().over(Window.orderBy(F.desc("richness"))))


def sparsity(counts: DataFrame) -> DataFrame:
    """(node, n_nonzero, pct_zero) over all clusters of the table."""
    total = F.broadcast(counts.agg(F.countDistinct("cluster").alias("k")))
    return counts.groupBy("node").agg(F.count(F.lit(1)).alias("n_nonzero")).crossJoin(total).select("node", "n_nonzero", F.round(100.0 * (F.col("k") - F.col("n_nonzero")) / F.col("k"), 6).alias("pct_zero"))


def alpha_diversity(counts: DataFrame) -> DataFrame:
    """Isolates, observed clusters, Shannon (natural log), Simpson, bias-corrected Chao1, evenness and ratios by node."""
    shares = counts.withColumn("total", F.sum("n").over(Window.partitionBy("node"))).withColumn("p", F.col("n") / F.col("total"))
    once, twice = F.sum(F.when(F.col("n") == 1, 1).otherwise(0)), F.sum(F.when(F.col("n") == 2, 1).otherwise(0))
    got = shares.groupBy("node").agg(F.sum("n").alias("isolate_n"), F.count(F.lit(1)).alias("observed"), (-F.sum(F.col("p") * F.log("p"))).alias("shannon"), (1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"), once.alias("f1"), twice.alias("f2"))
    chao = F.col("observed") + F.col("f1") * (F.col("f1") - 1) / (2.0 * (F.col("f2") + 1))
    even = F.when(F.col("observed") > 1, F.col("shannon") / F.log("observed")).otherwise(0.0)
    named = {"shannon": F.col("shannon"), "simpson": F.col("simpson"), "chao1": chao, "evenness": even, "obs_chao1": F.col("observed") / chao, "richness_per_isolate": F.col("observed") / F.col("isolate_n")}
    return got.select("node", "isolate_n", "observed", *[F.round(c + 0.0, 6).alias(k) for k, c in named.items()])


def all_pairs(counts: DataFrame) -> DataFrame:
    """One row for each pair of nodes u < v (a table of nodes, so small), with their sums."""
    nodes = counts.groupBy("node").agg(F.sum("n").alias("s1"), F.sum(F.col("n") * F.col("n")).alias("s2"), F.count(F.lit(1)).alias("rich"))
    a, b = nodes.select([F.col(c).alias(f"{c}_u") for c in nodes.columns]), nodes.select([F.col(c).alias(f"{c}_v") for c in nodes.columns])
    return a.join(F.broadcast(b), F.col("node_u") < F.col("node_v")).withColumnsRenamed({"node_u": "u", "node_v": "v"})


def filtered(counts: DataFrame, remove_singletons: bool = False, binary: bool = False) -> DataFrame:
    """Counts without clusters seen in one node only, or as 0/1."""
    if remove_singletons:
        counts = counts.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy("cluster"))).where("__k > 1").drop("__k")
    return counts.withColumn("n", F.lit(1).cast("long")) if binary else counts


def row_shares(counts: DataFrame) -> DataFrame:
    """Counts as shares of their node's total; a node without rows has none."""
    return counts.withColumn("n", F.try_divide("n", F.sum("n").over(Window.partitionBy("node"))))


def similarities(counts: DataFrame) -> DataFrame:
    """(u, v, cosine, pearson, jaccard, ruzicka, braycurtis) for every pair of nodes u < v.

    All five come from one self-join on the cluster, in closed form; a cluster has at most one row for each node,
    so no key is hot. Zero vectors give 0, a constant vector a null Pearson.
    """
    k = F.broadcast(counts.agg(F.countDistinct("cluster").alias("k")))
    a, b = counts.select("cluster", F.col("node").alias("u"), F.col("n").alias("nu")), counts.select("cluster", F.col("node").alias("v"), F.col("n").alias("nv"))
    met = a.join(b, "cluster").where("u < v").groupBy("u", "v").agg(F.sum(F.col("nu") * F.col("nv")).alias("dot"), F.sum(F.least("nu", "nv")).alias("least"), F.count(F.lit(1)).alias("both"))
    p = all_pairs(counts).join(met, ["u", "v"], "left").fillna(0, ["dot", "least", "both"]).crossJoin(k)

    def d(c: str) -> Column:
        return F.col(c).cast("double")

    varu, varv = d("k") * d("s2_u") - d("s1_u") * d("s1_u"), d("k") * d("s2_v") - d("s1_v") * d("s1_v")
    named = {
        "cosine": F.try_divide(d("dot"), F.sqrt(d("s2_u") * d("s2_v"))),
        "pearson": F.try_divide(d("k") * d("dot") - d("s1_u") * d("s1_v"), F.sqrt(varu * varv)),
        "jaccard": F.try_divide(d("both"), d("rich_u") + d("rich_v") - d("both")),
        "ruzicka": F.try_divide(d("least"), d("s1_u") + d("s1_v") - d("least")),
        "braycurtis": F.try_divide(2 * d("least"), d("s1_u") + d("s1_v")),
    }
    # a hair is added so that sums of shares that are a half in the last digit round as the exact value does
    return p.select("u", "v", *[F.round(c + (0.0 if n == "pearson" else 1e-12), 6).alias(n) for n, c in named.items()])


def pair_profiles(counts: DataFrame) -> DataFrame:
    """Cosine and Jaccard of each pair beside both nodes' isolates and richness and their ratio."""
    stats = all_pairs(counts).select("u", "v", F.col("s1_u").alias("isolates_u"), F.col("s1_v").alias("isolates_v"), F.col("rich_u").alias("richness_u"), F.col("rich_v").alias("richness_v"), F.round(F.least("rich_u", "rich_v") / F.greatest("rich_u", "rich_v"), 6).alias("richness_ratio"))
    return similarities(counts).select("u", "v", "cosine", "jaccard").join(stats, ["u", "v"])
