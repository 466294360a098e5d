"""Queries of consensus networks, centralities, roles and their stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainloom.operators import centrality as Z
from strainloom.operators import counts as C
from strainloom.operators import graph as G
from strainloom.plans.consensus import Consensus, ConsensusSettings, consensus_network, threshold_grid
from strainloom.plans.stability import nested_roles
from strainloom.queries.base import WITH, counts_of, observations
from strainloom.queries.network import _BOOT, REPLICATES
from strainloom.queries.network import SQL as _NETWORK
from strainloom.session import cut


#: Outer and inner draws of the nested bootstrap.
OUTER, INNER = 20, 50


def run(s, d) -> Consensus:
    return consensus_network(observations(s, d))


def metrics(c: Consensus):
    return Z.replicate_metrics(c.replicate_edges, c.nodes)


def _base_edges(s, d):
    counts = counts_of(s, d)
    return counts, G.threshold_edges(C.similarities(counts), "cosine", 0.35).withColumn("replicate", F.lit(-1))


def base_graph(s, d, **options):
    counts, edges = _base_edges(s, d)
    nodes = sorted(r.node for r in counts.select("node").distinct().collect())
    return Z.replicate_metrics(edges, nodes, **options)


def base_roles(s, d):
    return Z.roles(base_graph(s, d), ["replicate"])


def replicate_roles(s, d):
    c = run(s, d)
    nodes = s.createDataFrame([(n,) for n in c.nodes], "node string")
    return Z.all_roles(Z.roles(metrics(c), ["replicate"]), ConsensusSettings().replicates, nodes)


def consensus_modularity(s, d):
    c = run(s, d)
    return G.modularity(c.edges, c.partition)


def nested(s, d):
    return nested_roles(counts_of(s, d), OUTER, INNER)


def nested_gaps(s, d):
    """(n_rows, n_incomplete): roles of the nested bootstrap, and outer replicates that lack a node or hold one twice."""
    counts = counts_of(s, d)
    labelled = cut(nested_roles(counts, OUTER, INNER))
    odd = Z.incomplete_replicates(labelled, OUTER, counts.select("node").distinct().count())
    return labelled.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(odd.agg(F.count(F.lit(1)).alias("n_incomplete")))


QUERIES = {
    "centrality_roles": lambda s, d: base_roles(s, d).drop("replicate"),
    "unweighted_centrality": lambda s, d: base_graph(s, d, weighted=False).drop("replicate"),
    "plain_degree": lambda s, d: base_graph(s, d, normalised=False).select("node", F.col("degree").cast("long").alias("degree"), F.round("strength", 6).alias("strength")),
    "centrality_percentiles": lambda s, d: Z.percentile_ranks(base_graph(s, d)).drop("replicate"),
    "consensus_coassignment": lambda s, d: run(s, d).coassignment,
    "consensus_partition": lambda s, d: run(s, d).partition,
    "consensus_modularity": consensus_modularity,
    "role_frequencies": lambda s, d: Z.role_frequencies(replicate_roles(s, d)),
    "role_recovery": lambda s, d: Z.role_recovery(replicate_roles(s, d), base_roles(s, d)),
    "centrality_summary": lambda s, d: Z.centrality_summary(metrics(run(s, d))),
    "nested_role_frequencies": lambda s, d: Z.role_frequencies(nested(s, d)),
    "nested_incomplete": nested_gaps,
    "threshold_grid": lambda s, d: threshold_grid(observations(s, d), [0.25, 0.35, 0.45], [0.5, 0.75], REPLICATES),
    "node_correlations": lambda s, d: Z.correlations(C.alpha_diversity(counts_of(s, d)).withColumn("size", F.col("isolate_n").cast("double")), ["size", "shannon", "chao1"]),
}
SQL = {
    "plain_degree": WITH + " SELECT node, count(a) AS degree, round(coalesce(sum(weight), 0.0), 6) AS strength FROM nodes LEFT JOIN both_ways ON a = node GROUP BY 1",
    "threshold_grid": WITH
    + _BOOT
    + f", gr AS (SELECT st AS similarity_threshold, u, v, count(*) / {REPLICATES}.0 AS s FROM bdot JOIN bnorm x ON x.replicate = bdot.replicate AND x.node = u JOIN bnorm y ON y.replicate = bdot.replicate AND y.node = v, (SELECT unnest([0.25, 0.35, 0.45]::DOUBLE[]) AS st) WHERE round(dot / sqrt(x.s2 * y.s2), 6) > st GROUP BY 1, 2, 3) SELECT similarity_threshold, gt AS graph_threshold, count(*) FILTER (WHERE s >= gt) AS n_edges FROM gr, (SELECT unnest([0.5, 0.75]::DOUBLE[]) AS gt) GROUP BY 1, 2",
    "node_correlations": f"""WITH al AS ({_NETWORK["alpha_diversity"]}), l AS (SELECT node, unnest(['size', 'shannon', 'chao1']) AS c, unnest([CAST(isolate_n AS DOUBLE), shannon, chao1]) AS v FROM al),
 r AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY v) + (count(*) OVER (PARTITION BY c, v) - 1) / 2.0 AS k FROM l), p AS (SELECT * FROM (VALUES ('size', 'shannon'), ('size', 'chao1'), ('shannon', 'chao1')) t(a, b)),
 x AS (SELECT p.a, p.b, i.node, i.v AS va, j.v AS vb, i.k AS ka, j.k AS kb FROM p JOIN r i ON i.c = p.a JOIN r j ON j.c = p.b AND j.node = i.node),
 t AS (SELECT m.a, m.b, sum(sign(m.va - n.va) * sign(m.vb - n.vb)) / sqrt(sum(abs(sign(m.va - n.va))) * sum(abs(sign(m.vb - n.vb)))) AS tau FROM x m JOIN x n ON m.a = n.a AND m.b = n.b AND m.node < n.node GROUP BY 1, 2)
 SELECT a, b, round(corr(va, vb), 6) AS pearson, round(corr(ka, kb), 6) AS spearman, round(any_value(tau), 6) AS kendall FROM x JOIN t USING (a, b) GROUP BY 1, 2""",
}
