"""Queries of node summaries, similarity networks, communities and triangles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainloom.operators import counts as C
from strainloom.operators import graph as G
from strainloom.plans.consensus import replicate_similarities
from strainloom.queries.base import META, REGION, REGIONS_SQL, WITH, counts_of, observations, regions

THRESHOLD, REPLICATES, SUPPORT = 0.35, 100, 0.5
#: Place by clusters that the source of a supported triangle may have at most in sized_triangles.
TOP_SOURCES = 20


def _graph(spark, sf_dir):
    counts = counts_of(spark, sf_dir)
    return counts, counts.select("node").distinct(), G.threshold_edges(C.similarities(counts), "cosine", THRESHOLD)


def _partition(vertices):
    return vertices.select("node", F.split_part("node", F.lit("_"), F.lit(1)).alias("community"))


def bootstrap_support(spark, sf_dir):
    """Share of replicates in which an edge appears; one self-join carries all replicates."""
    edges = replicate_similarities(observations(spark, sf_dir), REPLICATES, 186).where(F.col("weight") > THRESHOLD)
    return edges.groupBy("u", "v").agg(F.round(F.count(F.lit(1)) / F.lit(float(REPLICATES)), 6).alias("support"))


def balanced_support(s, d):
    """As bootstrap_support, with as many draws of every node as the smallest has rows."""
    edges = replicate_similarities(observations(s, d), REPLICATES, 186, "least").where(F.col("weight") > THRESHOLD)
    return edges.groupBy("u", "v").agg(F.round(F.count(F.lit(1)) / F.lit(float(REPLICATES)), 6).alias("support"))


def supported_triangles(s, d, excluded="patient", **options):
    """Triangles whose source is supported and whose name does not begin with `excluded`."""
    c, v, e = _graph(s, d)
    got = G.residual_triangles(c, G.triangles(e), **options).where("supported").where(~F.col("source").startswith(excluded))
    return got.select("a", "b", "c", "source", "delta")


def removal(s, d):
    """The graph before and after nodes without an edge are removed."""
    c, v, e = _graph(s, d)
    return G.removal_stats(v, e, _partition(v), G.without_isolated(v, e))


def region_unmatched(spark, sf_dir):
    """Regions, as written, that mean no node, with their rows."""
    return regions(spark, sf_dir).where(F.col(REGION).isNotNull() & F.col("node").isNull()).groupBy(F.col(REGION).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {
    "region_unmatched": region_unmatched,
    "node_cluster_counts": lambda s, d: counts_of(s, d),
    "node_richness": lambda s, d: C.richness(counts_of(s, d)),
    "matrix_sparsity": lambda s, d: C.sparsity(counts_of(s, d)),
    "alpha_diversity": lambda s, d: C.alpha_diversity(counts_of(s, d)),
    "similarity_pairs": lambda s, d: C.similarities(counts_of(s, d)),
    "pair_profiles": lambda s, d: C.pair_profiles(counts_of(s, d)),
    "singleton_filtered_cosine": lambda s, d: C.similarities(C.filtered(counts_of(s, d), remove_singletons=True)).select("u", "v", "cosine"),
    "binary_cosine": lambda s, d: C.similarities(C.filtered(counts_of(s, d), binary=True)).select("u", "v", "cosine"),
    "threshold_edges": lambda s, d: _graph(s, d)[2],
    "connectivity_summary": lambda s, d: G.connectivity(*_graph(s, d)[1:]),
    "disconnected_removed": lambda s, d: G.without_isolated(*_graph(s, d)[1:]),
    "degree_strength": lambda s, d: G.degree_strength(*_graph(s, d)[1:]),
    "weighted_clustering": lambda s, d: G.clustering(*_graph(s, d)[1:]),
    "modularity_given_partition": lambda s, d: (lambda c, v, e: G.modularity(e, _partition(v)))(*_graph(s, d)),
    "community_stats": lambda s, d: (lambda c, v, e: G.community_stats(e, _partition(v)))(*_graph(s, d)),
    "renumbered_communities": lambda s, d: (lambda c, v, e: G.renumber(_partition(v), ["patient_plains", "patient_uplands", "hogbarn_plains"]))(*_graph(s, d)),
    "metagraph_edges": lambda s, d: (lambda c, v, e: G.metagraph(e, _partition(v)))(*_graph(s, d)),
    "bootstrap_edge_support": bootstrap_support,
    "consensus_edges": lambda s, d: bootstrap_support(s, d).where(F.col("support") >= SUPPORT).select("u", "v", F.col("support").alias("weight")),
    "triangles": lambda s, d: G.triangles(_graph(s, d)[2]).select("a", "b", "c"),
    "triangle_candidates": lambda s, d: (lambda c, v, e: G.residual_triangles(c, G.triangles(e)))(*_graph(s, d)),
    "supported_triangles": lambda s, d: supported_triangles(s, d),
    "sized_triangles": lambda s, d: supported_triangles(s, d, require_size=True, richness_top_n=TOP_SOURCES),
    "balanced_edge_support": balanced_support,
    "singletons_removed": lambda s, d: G.without_singletons(_partition(_graph(s, d)[1])),
    "removal_stats": removal,
    "sorted_communities": lambda s, d: G.sorted_communities(_partition(_graph(s, d)[1])),
    "normalised_cosine": lambda s, d: C.similarities(C.row_shares(counts_of(s, d))).select("u", "v", "cosine", "braycurtis", "ruzicka"),
}

_BOOT = f""", placed AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY row_id) - 1 AS place, count(*) OVER (PARTITION BY node) AS size FROM obs),
 draws AS (SELECT node, r AS replicate, CAST(floor((CAST('0x' || substr(md5('186:' || r || ':' || node || ':' || place), 1, 8) AS BIGINT) / 4294967296.0) * size) AS BIGINT) AS place FROM placed, range({REPLICATES}) t(r)),
 bcounts AS (SELECT replicate, d.node, cluster, count(*) AS n FROM draws d JOIN placed p ON d.node = p.node AND d.place = p.place GROUP BY 1, 2, 3),
 bnorm AS (SELECT replicate, node, CAST(sum(n * n) AS DOUBLE) AS s2 FROM bcounts GROUP BY 1, 2),
 bdot AS (SELECT a.replicate, a.node AS u, b.node AS v, CAST(sum(a.n * b.n) AS DOUBLE) AS dot FROM bcounts a JOIN bcounts b ON a.replicate = b.replicate AND a.cluster = b.cluster AND a.node < b.node GROUP BY 1, 2, 3),
 support AS (SELECT u, v, round(count(*) / {REPLICATES}.0, 6) AS support FROM bdot JOIN bnorm x ON x.replicate = bdot.replicate AND x.node = u JOIN bnorm y ON y.replicate = bdot.replicate AND y.node = v WHERE round(dot / sqrt(x.s2 * y.s2), 6) > {THRESHOLD} GROUP BY 1, 2)"""
_TRI = ", tri AS (SELECT x.u AS a, x.v AS b, y.v AS c, x.weight AS w_ab, y.weight AS w_ac, z.weight AS w_bc FROM edges x JOIN edges y ON x.u = y.u AND x.v < y.v JOIN edges z ON z.u = x.v AND z.v = y.v)"
_RES = (
    _TRI
    + """, dots AS (SELECT a.node AS p, b.node AS q, CAST(sum(a.n * b.n) AS DOUBLE) AS dot FROM counts a JOIN counts b USING (cluster) GROUP BY 1, 2),
 cand AS (SELECT a, b, c, a AS source, b AS x, c AS y FROM tri UNION ALL SELECT a, b, c, b, a, c FROM tri UNION ALL SELECT a, b, c, c, a, b FROM tri),
 full_c AS (SELECT cand.*, xx.dot AS xx, yy.dot AS yy, ss.dot AS ss, coalesce(xy.dot, 0) AS xy, coalesce(xs.dot, 0) AS xs, coalesce(ys.dot, 0) AS ys FROM cand
   JOIN dots xx ON xx.p = x AND xx.q = x JOIN dots yy ON yy.p = y AND yy.q = y JOIN dots ss ON ss.p = source AND ss.q = source
   LEFT JOIN dots xy ON xy.p = x AND xy.q = y LEFT JOIN dots xs ON xs.p = x AND xs.q = source LEFT JOIN dots ys ON ys.p = y AND ys.q = source),
 rk AS (SELECT node, CAST(rich AS BIGINT) AS clusters, rank() OVER (ORDER BY rich DESC) AS rk FROM stats),
 cos_c AS (SELECT a, b, c, source, rs.clusters AS source_clusters, rs.rk AS source_rank, rs.clusters >= greatest(rx.clusters, ry.clusters) AS passes_size, round(xy / sqrt(xx * yy), 6) AS original, round((xy - xs * ys / ss) / sqrt((xx - xs * xs / ss) * (yy - ys * ys / ss)), 6) + 0.0 AS residual FROM full_c JOIN rk rs ON rs.node = source JOIN rk rx ON rx.node = x JOIN rk ry ON ry.node = y WHERE xx - xs * xs / ss > 1e-9 AND yy - ys * ys / ss > 1e-9),
 delta_c AS (SELECT *, round(original - residual, 6) AS delta, round(greatest(0.15, original - 0.3), 6) AS required_delta, CASE WHEN original > 0 THEN round((original - residual) / original, 9) END AS fraction FROM cos_c),
 rank_c AS (SELECT *, row_number() OVER w AS delta_rank, round(delta - lead(delta) OVER w, 6) AS g FROM delta_c WINDOW w AS (PARTITION BY a, b, c ORDER BY delta DESC, source)),
 last_c AS (SELECT a, b, c, source, original, residual, source_clusters, source_rank, passes_size, delta, fraction, required_delta, delta_rank, CASE WHEN delta_rank = 1 THEN g END AS gap,
   coalesce(delta_rank = 1 AND residual <= 0.3 AND delta >= required_delta AND fraction >= 0.5 AND g >= 0.1, FALSE) AS supported FROM rank_c)"""
)

SQL = {
    "region_unmatched": f"WITH {REGIONS_SQL} SELECT value, count(*) AS n_rows FROM {META} JOIN rmap ON value = {REGION} WHERE term IS NULL GROUP BY 1",
    "node_cluster_counts": WITH + " SELECT * FROM counts",
    "node_richness": WITH + " SELECT node, CAST(rich AS BIGINT) AS richness, CAST(s1 AS BIGINT) AS n_rows, rank() OVER (ORDER BY rich DESC) AS richness_rank FROM stats",
    "matrix_sparsity": WITH + " SELECT node, CAST(rich AS BIGINT) AS n_nonzero, round(100.0 * (k - rich) / k, 6) AS pct_zero FROM stats, kk",
    "alpha_diversity": WITH
    + """, sh AS (SELECT counts.*, n / s1 AS p FROM counts JOIN stats USING (node)), g AS (SELECT node, sum(n) AS i, count(*) AS o, -sum(p * ln(p)) AS h, 1 - sum(p * p) AS d, sum(CASE WHEN n = 1 THEN 1.0 ELSE 0 END) AS f1, sum(CASE WHEN n = 2 THEN 1.0 ELSE 0 END) AS f2 FROM sh GROUP BY 1),
 c AS (SELECT *, o + f1 * (f1 - 1) / (2.0 * (f2 + 1)) AS ch FROM g)
 SELECT node, CAST(i AS BIGINT) AS isolate_n, o AS observed, round(h + 0.0, 6) AS shannon, round(d + 0.0, 6) AS simpson, round(CAST(ch AS DOUBLE), 6) AS chao1, round(CASE WHEN o > 1 THEN h / ln(o) ELSE 0.0 END, 6) AS evenness, round(CAST(o / ch AS DOUBLE), 6) AS obs_chao1, round(CAST(o AS DOUBLE) / i, 6) AS richness_per_isolate FROM c""",
    "similarity_pairs": WITH + " SELECT u, v, round(dot / sqrt(s2_u * s2_v), 6) AS cosine, round((k * dot - s1_u * s1_v) / sqrt((k * s2_u - s1_u * s1_u) * (k * s2_v - s1_v * s1_v)), 6) AS pearson, round(bth / (rich_u + rich_v - bth), 6) AS jaccard, round(lst / (s1_u + s1_v - lst), 6) AS ruzicka, round(2 * lst / (s1_u + s1_v), 6) AS braycurtis FROM pairs, kk",
    "pair_profiles": WITH + " SELECT u, v, round(dot / sqrt(s2_u * s2_v), 6) AS cosine, round(bth / (rich_u + rich_v - bth), 6) AS jaccard, CAST(s1_u AS BIGINT) AS isolates_u, CAST(s1_v AS BIGINT) AS isolates_v, CAST(rich_u AS BIGINT) AS richness_u, CAST(rich_v AS BIGINT) AS richness_v, round(least(rich_u, rich_v) / greatest(rich_u, rich_v), 6) AS richness_ratio FROM pairs",
    "singleton_filtered_cosine": WITH.replace("counts AS (SELECT", "counts0 AS (SELECT").replace("), nodes AS", "), counts AS (SELECT * FROM counts0 WHERE cluster IN (SELECT cluster FROM counts0 GROUP BY 1 HAVING count(*) > 1)), nodes AS", 1) + " SELECT u, v, cosine FROM sims",
    "binary_cosine": WITH + " SELECT u, v, round(bth / sqrt(rich_u * rich_v), 6) AS cosine FROM pairs",
    "threshold_edges": WITH + " SELECT * FROM edges",
    "connectivity_summary": WITH + " SELECT count(*) FILTER (WHERE t IS NULL) AS n_isolated, count(t) AS n_connected, round(count(t) / CAST(count(*) AS DOUBLE), 6) AS fraction_connected FROM nodes LEFT JOIN (SELECT DISTINCT a, 1 AS t FROM both_ways) ON a = node",
    "disconnected_removed": WITH + " SELECT node FROM nodes WHERE node IN (SELECT a FROM both_ways)",
    "degree_strength": WITH + ", d AS (SELECT node, count(a) AS k, coalesce(sum(weight), 0) AS s FROM nodes LEFT JOIN both_ways ON a = node GROUP BY 1) SELECT node, round(k / (count(*) OVER () - 1.0), 6) AS degree, round(coalesce(s / nullif(max(s) OVER (), 0), 0), 6) AS strength FROM d",
    "weighted_clustering": WITH + _TRI + ", g AS (SELECT node, sum(pow(w_ab * w_ac * w_bc / pow(m, 3.0), 1.0 / 3)) AS g FROM (SELECT unnest([a, b, c]) AS node, w_ab, w_ac, w_bc FROM tri), (SELECT max(weight) AS m FROM edges) GROUP BY 1), k AS (SELECT a AS node, count(*) AS k FROM both_ways GROUP BY 1) SELECT node, round(CASE WHEN k >= 2 THEN 2 * coalesce(g, 0) / (k * (k - 1)) ELSE 0.0 END, 6) AS clustering FROM nodes LEFT JOIN k USING (node) LEFT JOIN g USING (node)",
    "modularity_given_partition": WITH + ", j AS (SELECT p.community AS cu, q.community AS cv, weight FROM edges JOIN part p ON u = p.node JOIN part q ON v = q.node), dg AS (SELECT c, sum(weight) AS d FROM (SELECT cu AS c, weight FROM j UNION ALL SELECT cv, weight FROM j) GROUP BY 1), ins AS (SELECT cu AS c, sum(weight) AS l FROM j WHERE cu = cv GROUP BY 1) SELECT round(coalesce(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)), 0.0), 6) AS modularity FROM dg LEFT JOIN ins USING (c), (SELECT sum(weight) AS m FROM edges)",
    "community_stats": WITH + ", j AS (SELECT p.community AS cu, q.community AS cv, weight FROM edges JOIN part p ON u = p.node JOIN part q ON v = q.node), sz AS (SELECT community, count(*) AS size FROM part GROUP BY 1), ins AS (SELECT cu AS community, sum(weight) AS w FROM j WHERE cu = cv GROUP BY 1), ext AS (SELECT community, sum(weight) AS x FROM (SELECT cu AS community, weight FROM j WHERE cu <> cv UNION ALL SELECT cv, weight FROM j WHERE cu <> cv) GROUP BY 1), f AS (SELECT community, size, coalesce(w, 0) AS w, coalesce(x, 0) AS x, CASE WHEN size > 1 THEN coalesce(w, 0) / (size * (size - 1) / 2.0) ELSE 0.0 END AS dn FROM sz LEFT JOIN ins USING (community) LEFT JOIN ext USING (community)) SELECT community, size, round(dn, 6) AS internal_density, round(coalesce(x / nullif(2 * w + x, 0), 0.0), 6) AS conductance, dn < 0.3 AS low_density_flag, size = 1 AS is_singleton FROM f",
    "renumbered_communities": WITH + ", g AS (SELECT community, min(CASE node WHEN 'patient_plains' THEN 0 WHEN 'patient_uplands' THEN 1 WHEN 'hogbarn_plains' THEN 2 END) AS anchor, count(*) AS size, min(node) AS least FROM part GROUP BY 1) SELECT node, community_number FROM part JOIN (SELECT community, row_number() OVER (ORDER BY anchor ASC NULLS LAST, size DESC, least) AS community_number FROM g) USING (community)",
    "metagraph_edges": WITH + " SELECT least(p.community, q.community) AS cu, greatest(p.community, q.community) AS cv, round(sum(weight), 6) AS weight, count(*) AS n_edges FROM edges JOIN part p ON u = p.node JOIN part q ON v = q.node WHERE p.community <> q.community GROUP BY 1, 2",
    "bootstrap_edge_support": WITH + _BOOT + " SELECT * FROM support",
    "consensus_edges": WITH + _BOOT + f" SELECT u, v, support AS weight FROM support WHERE support >= {SUPPORT}",
    "triangles": WITH + _TRI + " SELECT a, b, c FROM tri",
    "triangle_candidates": WITH + _RES + " SELECT * FROM last_c",
    "supported_triangles": WITH + _RES + " SELECT a, b, c, source, delta FROM last_c WHERE supported AND source NOT LIKE 'patient%'",
    "sized_triangles": WITH + _RES + f" SELECT a, b, c, source, delta FROM last_c WHERE supported AND passes_size AND source_rank <= {TOP_SOURCES} AND source NOT LIKE 'patient%'",
    "balanced_edge_support": WITH + _BOOT.replace("FROM placed, range(", "FROM (SELECT *, min(size) OVER () AS least FROM placed) QUALIFY_PLACE, range(").replace("QUALIFY_PLACE, range(" + str(REPLICATES) + ") t(r))", "q, range(" + str(REPLICATES) + ") t(r) WHERE place < least)") + " SELECT * FROM support",
    "singletons_removed": WITH + " SELECT node, number AS community FROM part JOIN (SELECT community, row_number() OVER (ORDER BY community) - 1 AS number FROM part GROUP BY 1 HAVING count(*) > 1) USING (community)",
    "removal_stats": WITH + ", st AS (SELECT 'before' AS stage, node FROM nodes UNION ALL SELECT 'after', node FROM nodes WHERE node IN (SELECT a FROM both_ways)), j AS (SELECT p.community AS cu, q.community AS cv, weight FROM edges JOIN part p ON u = p.node JOIN part q ON v = q.node), dg AS (SELECT c, sum(weight) AS d FROM (SELECT cu AS c, weight FROM j UNION ALL SELECT cv, weight FROM j) GROUP BY 1), ins AS (SELECT cu AS c, sum(weight) AS l FROM j WHERE cu = cv GROUP BY 1), mo AS (SELECT round(coalesce(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)), 0.0), 6) AS modularity FROM dg LEFT JOIN ins USING (c), (SELECT sum(weight) AS m FROM edges)) SELECT stage, count(*) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, count(DISTINCT community) AS n_communities, any_value(modularity) AS modularity FROM st JOIN part USING (node), mo GROUP BY 1",
    "sorted_communities": WITH + " SELECT community, count(*) AS size, string_agg(node, ', ' ORDER BY node) AS members FROM part GROUP BY 1",
    "normalised_cosine": WITH + ", sh AS (SELECT c.node, cluster, n / s1 AS n FROM counts c JOIN stats USING (node)), t2 AS (SELECT node, sum(n) AS s1, sum(n * n) AS s2 FROM sh GROUP BY 1), mt AS (SELECT a.node AS u, b.node AS v, sum(a.n * b.n) AS dot, sum(least(a.n, b.n)) AS lst FROM sh a JOIN sh b ON a.cluster = b.cluster AND a.node < b.node GROUP BY 1, 2) SELECT a.node AS u, b.node AS v, round(coalesce(dot, 0) / sqrt(a.s2 * b.s2) + 1e-12, 6) AS cosine, round(2 * coalesce(lst, 0) / (a.s1 + b.s1) + 1e-12, 6) AS braycurtis, round(coalesce(lst, 0) / (a.s1 + b.s1 - coalesce(lst, 0)) + 1e-12, 6) AS ruzicka FROM t2 a JOIN t2 b ON a.node < b.node LEFT JOIN mt ON mt.u = a.node AND mt.v = b.node",
}
