"""Queries of clusters by level, curve bands, strata, given partitions, folds and the details of attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainloom.functions.portable import folds
from strainloom.operators import association as A
from strainloom.operators import centrality as Z
from strainloom.operators import counts as C
from strainloom.operators import diversity as D
from strainloom.operators import graph as G
from strainloom.queries import association as QA
from strainloom.queries import attribution as Q
from strainloom.queries import diversity as QD
from strainloom.queries import network as QN
from strainloom.queries.base import META, WITH, counts_of
from strainloom.session import read_table

SEED, REPLICATES, FOLDS, SLOPES = 42, 500, 10, 500
LEVELS = ["hc5", "hc10", "hc20", "hc50", "hc100"]
TOUCHING = ["patient_plains", "hogbarn_plains"]
PET_TERMS = ["pet", "dog", "cat", "treat", "chew"]


def clusters_by_source(s, d):
    """Distinct clusters of every level by source."""
    return read_table(s, d, META).where("source is not null").groupBy(F.lower("source").alias("source")).agg(*[F.countDistinct(c).alias(f"distinct_{c}") for c in LEVELS])


def partition_coassignment(s, d):
    """Two given partitions of the nodes, by each part of their name."""
    nodes = counts_of(s, d).select("node").distinct()
    parts = nodes.select("node", F.posexplode(F.split("node", "_")).alias("replicate", "community"))
    return Z.coassignment(parts.where("replicate < 2"))


def touching_triangles(s, d):
    return G.triangles(QN._graph(s, d)[2]).where(F.arrays_overlap(F.array("a", "b", "c"), F.array(*map(F.lit, TOUCHING)))).select("a", "b", "c")


def stratified(s, d):
    """Feed presence of clusters dealt out inside strata of breadth and size: share of human clusters among the marked."""
    rows = QA.binned(s, d).select("cluster", "target_breadth", "bin", "feed_present", "human_present")
    dealt = A.permuted_within(rows, "cluster", "feed_present", ["target_breadth", "bin"], REPLICATES, SEED)
    return dealt.join(rows.select("cluster", "human_present"), "cluster").groupBy("replicate").agg(F.count_if("feed_present").alias("n_feed"), F.count_if(F.col("feed_present") & F.col("human_present")).alias("n_both"))


def feed_subclasses(s, d):
    kind = A.subclass(F.lower("source"), F.col("source_details"), "feed", PET_TERMS, "pet feed", "other feed")
    return read_table(s, d, META).groupBy(kind.alias("subclass")).agg(F.count(F.lit(1)).alias("n"))


def diversity_points(s, d):
    return C.alpha_diversity(counts_of(s, d)).select("node", "isolate_n", "shannon", "obs_chao1")


def huber(s, d):
    return s.createDataFrame([D.huber_line(diversity_points(s, d), "shannon", "obs_chao1")], "slope double, intercept double")


def fold_sizes(s, d):
    return folds(Q.labelled(s, d, Q.TRAIN), "id", "label", FOLDS, SEED).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def accuracy(s, d):
    return Q.predicted(s, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6).alias("accuracy"))


QUERIES = {
    "distinct_clusters_per_source": clusters_by_source,
    "coassignment_by_partition": partition_coassignment,
    "triangles_with_nodes": touching_triangles,
    "rarefied_band": lambda s, d: D.rarefied_band(QD.near(s, d), "key", "source", "distance", QD.N_STAR, QD.REPLICATES, QD.SEED),
    "diversity_quadrants": lambda s, d: D.quadrants(diversity_points(s, d), "node", "shannon", "obs_chao1", "isolate_n"),
    "diversity_slope": lambda s, d: D.slope_band(diversity_points(s, d), "node", "shannon", "obs_chao1", SLOPES, SEED),
    "diversity_band": lambda s, d: D.regression_band(diversity_points(s, d), "node", "shannon", "obs_chao1", SLOPES, SEED),
    "diversity_huber": huber,
    "stratified_permutation": stratified,
    "feed_subclasses": feed_subclasses,
    "fold_sizes": fold_sizes,
    "knn_accuracy": accuracy,
}

_ALPHA = QN.SQL["alpha_diversity"]
_POINTS = f"al AS ({_ALPHA})"
_DRAWN = QD._RARE[: QD._RARE.index(", cov AS" if ", cov AS" in QD._RARE else "cov AS")].rstrip().rstrip(",")
_LAB = Q._K

SQL = {
    "distinct_clusters_per_source": f"SELECT lower(source) AS source, {', '.join(f'count(DISTINCT {c}) AS distinct_{c}' for c in LEVELS)} FROM {META} WHERE source IS NOT NULL GROUP BY 1",
    "coassignment_by_partition": WITH + ", pt AS (SELECT node, 0 AS r, split_part(node, '_', 1) AS c FROM nodes UNION ALL SELECT node, 1, split_part(node, '_', 2) FROM nodes WHERE contains(node, '_')) SELECT x.node AS u, y.node AS v, round(count(*) / CAST((SELECT count(DISTINCT r) FROM pt) AS DOUBLE), 6) AS support FROM pt x JOIN pt y ON x.r = y.r AND x.c = y.c AND x.node < y.node GROUP BY 1, 2",
    "triangles_with_nodes": WITH + QN._TRI + f" SELECT a, b, c FROM tri WHERE list_has_any([a, b, c], {TOUCHING})",
    "rarefied_band": QD._W + _DRAWN + ", cu AS (SELECT source, replicate, CAST(x AS INT) AS x, round(avg(CASE WHEN d <= x THEN 1.0 ELSE 0.0 END), 6) AS y FROM drawn, range(51) g(x) WHERE d IS NOT NULL GROUP BY 1, 2, 3) SELECT source, x, round(avg(y) + 1e-9, 6) AS y_mean, round(quantile_cont(y, 0.025) + 1e-9, 6) AS y_lo, round(quantile_cont(y, 0.975) + 1e-9, 6) AS y_hi FROM cu GROUP BY 1, 2",
    "diversity_quadrants": f"WITH {_POINTS}, q AS (SELECT quantile_cont(shannon, 0.75) AS qx, quantile_cont(obs_chao1, 0.75) AS qy, min(sqrt(isolate_n)) AS lo, max(sqrt(isolate_n)) AS hi FROM al) SELECT node, shannon, obs_chao1, round(CASE WHEN hi > lo THEN 40.0 + (sqrt(isolate_n) - lo) / (hi - lo) * 360.0 ELSE 220.0 END, 6) AS marker, shannon >= qx AS high_x, obs_chao1 >= qy AS high_y FROM al, q",
    "diversity_slope": f"""WITH {_POINTS}, pl AS (SELECT *, row_number() OVER (ORDER BY node) - 1 AS place, count(*) OVER () AS size FROM al),
 dr AS (SELECT r, CAST(floor((CAST('0x' || substr(md5('{SEED}:' || r || ':all:' || place), 1, 8) AS BIGINT) / 4294967296.0) * size) AS BIGINT) AS place FROM pl, range({SLOPES}) t(r)),
 sl AS (SELECT r, regr_slope(obs_chao1, shannon) AS s FROM dr JOIN pl USING (place) GROUP BY 1)
 SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(lo, 6) AS slope_lo, round(hi, 6) AS slope_hi FROM (SELECT regr_slope(obs_chao1, shannon) AS slope, regr_intercept(obs_chao1, shannon) AS intercept FROM al), (SELECT quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM sl)""",
    "diversity_band": f"""WITH {_POINTS}, pl AS (SELECT *, row_number() OVER (ORDER BY node) - 1 AS place, count(*) OVER () AS size FROM al),
 dr AS (SELECT r, CAST(floor((CAST('0x' || substr(md5('{SEED}:' || r || ':all:' || place), 1, 8) AS BIGINT) / 4294967296.0) * size) AS BIGINT) AS place FROM pl, range({SLOPES}) t(r)),
 ln AS (SELECT r, regr_slope(obs_chao1, shannon) AS rs, regr_intercept(obs_chao1, shannon) AS ri FROM dr JOIN pl USING (place) GROUP BY 1),
 gr AS (SELECT CAST(step AS INT) AS step, f + (t - f) * step / 299 AS x, s, i FROM (SELECT min(shannon) AS f, max(shannon) AS t, regr_slope(obs_chao1, shannon) AS s, regr_intercept(obs_chao1, shannon) AS i FROM al), range(300) g(step))
 SELECT step, round(x, 6) AS x, round(i + s * x, 6) AS y, round(quantile_cont(ri + rs * x, 0.025), 6) AS lo, round(quantile_cont(ri + rs * x, 0.975), 6) AS hi FROM gr, ln WHERE NOT isnan(rs) AND rs IS NOT NULL GROUP BY step, x, s, i""",
    "stratified_permutation": QA._S
    + QA._BIN
    + f""", pl AS (SELECT target_breadth, bin, feed_present, row_number() OVER (PARTITION BY target_breadth, bin ORDER BY cluster) AS place FROM b),
 sp AS (SELECT r AS replicate, cluster, human_present, target_breadth, bin, row_number() OVER (PARTITION BY r, target_breadth, bin ORDER BY md5('{SEED}:' || r || ':' || cluster), cluster) AS place FROM b, range({REPLICATES}) t(r))
 SELECT CAST(replicate AS INT) AS replicate, count(*) FILTER (WHERE feed_present) AS n_feed, count(*) FILTER (WHERE feed_present AND human_present) AS n_both FROM sp JOIN pl USING (target_breadth, bin, place) GROUP BY 1""",
    "feed_subclasses": f"SELECT CASE WHEN lower(source) = 'feed' THEN CASE WHEN coalesce(regexp_matches(source_details, '(?i){'|'.join(PET_TERMS)}'), FALSE) THEN 'pet feed' ELSE 'other feed' END ELSE lower(source) END AS subclass, count(*) AS n FROM {META} GROUP BY 1",
    "fold_sizes": _LAB + f" SELECT label, CAST(fold AS INT) AS fold, count(*) AS n, min(id) AS first_id FROM (SELECT id, label, (row_number() OVER (PARTITION BY label ORDER BY md5('{SEED}:' || id), id) - 1) % {FOLDS} AS fold FROM tr) GROUP BY 1, 2",
    "knn_accuracy": _LAB + " SELECT count(*) AS n, round(avg(CASE WHEN te.label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred JOIN te ON te.id = query_id",
}
