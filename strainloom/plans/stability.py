"""Nested bootstrap: is a node's role the same when the isolates themselves are drawn anew?"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainloom.operators.centrality import all_roles, replicate_metrics, roles
from strainloom.operators.inference import multinomial
from strainloom.session import cut


def fingerprint(**settings) -> str:
    """A name for a run's settings, for resume_replicates."""
    return hashlib.sha256(repr(sorted(settings.items())).encode()).hexdigest()[:16]


def nested_support(counts: DataFrame, outer: int, inner: int, threshold: float = 0.35, seed: int = 186) -> DataFrame:
    """(replicate, u, v, weight): for each outer replicate the counts are drawn anew, then `inner` times again; weight is
    the share of the inner draws in which the cosine of two nodes is above the threshold, u < v.

    Draws are keyed by (outer, inner, node) and meet by one self-join on the cluster, so neither a replicate nor the
    table of counts is held by one task.
    """
    base = cut(multinomial(counts, [], outer, seed).withColumnRenamed("replicate", "outer"))
    drawn = cut(multinomial(base, ["outer"], inner, seed + 1).withColumnRenamed("replicate", "inner"))
    by = ["outer", "inner"]
    norms = drawn.groupBy(*by, "node").agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("s2"))
    a, b = drawn.select(*by, "cluster", F.col("node").alias("u"), F.col("n").alias("nu")), drawn.select(*by, "cluster", F.col("node").alias("v"), F.col("n").alias("nv"))
    dots = a.join(b, [*by, "cluster"]).where("u < v").groupBy(*by, "u", "v").agg(F.sum(F.col("nu") * F.col("nv")).cast("double").alias("dot"))
    both = dots.join(norms.withColumnsRenamed({"node": "u", "s2": "su"}), [*by, "u"]).join(norms.withColumnsRenamed({"node": "v", "s2": "sv"}), [*by, "v"])
    near = both.where(F.round(F.col("dot") / F.sqrt(F.col("su") * F.col("sv")), 6) > threshold)
    return near.groupBy(F.col("outer").alias("replicate"), "u", "v").agg((F.count(F.lit(1)) / F.lit(float(inner))).alias("weight"))


def nested_roles(counts: DataFrame, outer: int, inner: int, threshold: float = 0.35, support: float = 0.5, seed: int = 186) -> DataFrame:
    """(replicate, node, role) for outer replicates 0.. and every node: its role in the consensus graph of edges with at
    least `support`, or that it is not retained there."""
    edges = nested_support(counts, outer, inner, threshold, seed).where(F.col("weight") >= support)
    return all_roles(roles(replicate_metrics(edges, None), ["replicate"]), outer, counts.select("node").distinct())
