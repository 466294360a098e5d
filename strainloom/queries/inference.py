"""Queries of fitted models, null models, trees, bootstrapped triangles and windowed counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainloom.operators import counts as C
from strainloom.operators import graph as G
from strainloom.operators import inference as I
from strainloom.operators import knn as K
from strainloom.queries import attribution as Q
from strainloom.queries.association import eligible, summary
from strainloom.queries.base import META, WITH, counts_of
from strainloom.queries.network import _graph, _partition
from strainloom.queries.stability import run
from strainloom.session import cut, read_table
from strainloom.streaming.counts import windowed_counts


def feed_logit(s, d):
    """Terms of the model of human presence by feed presence, breadth and size."""
    rows = summary(s, d).select(F.col("human_present").cast("int").alias("y"), F.col("feed_present").cast("int").alias("feed"), F.col("target_breadth").alias("breadth"), "log_total")
    return s.createDataFrame(I.fit_glm(rows, "y", ["feed", "log_total"], "binomial"), "term string, estimate double, se double, z double, p double")


def size_adjusted_humans(s, d):
    got = I.size_adjusted(eligible(s, d), "human_count", ["log_total", "target_breadth"])
    return got.select("cluster", "human_count", *[F.round(c, 6).alias(c) for c in ("expected", "excess", "residual")])


def significance(s, d):
    c, v, e = _graph(s, d)
    return I.modularity_significance(e, sorted(r.node for r in v.collect()), 200)  # node labels only


def distances(s, d):
    return read_table(s, d, "hc50_distance_matrix")


def supported(s, d):
    c, v, e = _graph(s, d)
    return c, G.residual_triangles(c, G.triangles(e)).where("supported")


def knn_results(s, d):
    near = cut(Q.near(s, d))
    p = cut(Q.proba(s, d, near))
    per = K.nearest_of_labels(Q.labelled(s, d, Q.TEST), Q.labelled(s, d, Q.TRAIN), K.predictions(p), 3)
    truth = Q.labelled(s, d, Q.TEST).select(F.col("id").alias("query_id"), "label")
    names = read_table(s, d, Q.TRAIN).select(F.col("profile_id").alias("id"), F.col("barcode").alias("name"))
    return K.results(near, p, K.trust(per, K.predictions(p)), truth, names)


def loads(s, d):
    m = read_table(s, d, META)
    return windowed_counts(m, "loaded_at", "source", "hc50", "30 days")


QUERIES = {
    "feed_logit": feed_logit,
    "size_adjusted_humans": size_adjusted_humans,
    "modularity_significance": significance,
    "cluster_tree": lambda s, d: I.tree_of(distances(s, d)),
    "faith_diversity": lambda s, d: I.faith_diversity(counts_of(s, d), I.tree_of(distances(s, d))),
    "triangle_stability": lambda s, d: I.triangle_stability(*supported(s, d), 100),
    "community_importance": lambda s, d: (lambda c, v, e: G.community_importance(e, _partition(v)))(*_graph(s, d)),
    "disagreement_nodes": lambda s, d: (lambda c: G.disagreements(C.similarities(counts_of(s, d)), "cosine", c.coassignment))(run(s, d)),
    "knn_results": knn_results,
    "dense_profiles": lambda s, d: K.dense_enough(Q.near(s, d), 0.1),
    "windowed_counts": loads,
}
SQL = {
    "dense_profiles": Q._K + ", r AS (SELECT query_id, max(distance) AS radius FROM near GROUP BY 1) SELECT query_id, radius FROM r WHERE radius <= (SELECT quantile_cont(radius, 0.9) FROM r)",
    "community_importance": WITH + """, j AS (SELECT p.community AS cu, q.community AS cv, weight FROM edges JOIN part p ON u = p.node JOIN part q ON v = q.node), sz AS (SELECT community, count(*) AS size FROM part GROUP BY 1), ins AS (SELECT cu AS community, sum(weight) AS w FROM j WHERE cu = cv GROUP BY 1),
 me AS (SELECT least(cu, cv) AS x, greatest(cu, cv) AS y, round(sum(weight), 6) AS w FROM j WHERE cu <> cv GROUP BY 1, 2), ext AS (SELECT community, sum(w) AS x FROM (SELECT x AS community, w FROM me UNION ALL SELECT y, w FROM me) GROUP BY 1),
 d0 AS (SELECT x AS s, y AS t, 1 / w AS d FROM me UNION ALL SELECT y, x, 1 / w FROM me),"""
    + ",".join(f" d{k + 1} AS (SELECT s, t, min(d) AS d FROM (SELECT * FROM d{k} UNION ALL SELECT p.s, q.t, p.d + q.d FROM d{k} p JOIN d{k} q ON p.t = q.s AND p.s <> q.t) GROUP BY 1, 2)" for k in range(5))
    + """, bt AS (SELECT v.t AS community, count(*) AS k FROM d5 v JOIN d5 z ON v.t = z.s JOIN d5 st ON st.s = v.s AND st.t = z.t AND v.s <> z.t WHERE abs(v.d + z.d - st.d) < 1e-9 GROUP BY 1),
 raw AS (SELECT community, size, coalesce(w, 0.0) AS w, CASE WHEN size > 1 THEN coalesce(w, 0) / (size * (size - 1) / 2.0) ELSE 0.0 END AS dens, coalesce(x, 0.0) AS x, coalesce(k, 0) AS k FROM sz LEFT JOIN ins USING (community) LEFT JOIN ext USING (community) LEFT JOIN bt USING (community)),
 f AS (SELECT community, size, w, round(dens, 6) AS density, x AS external, round(coalesce(x / nullif(2 * w + x, 0), 0.0), 6) AS conductance, coalesce(k / nullif((count(*) OVER () - 1.0) * (count(*) OVER () - 2.0), 0), 0.0) AS bw FROM raw),
 g AS (SELECT *, median(density) OVER () AS md, median(conductance) OVER () AS mc, max(size) OVER () AS ms, max(density) OVER () AS xd, max(external) OVER () AS xe, max(bw) OVER () AS xb FROM f)
 SELECT community, size, round(w, 6) AS internal_weight, density, round(external, 6) AS external, conductance, round(bw, 6) AS betweenness, round(0.4 * size / ms + 0.2 * coalesce(density / nullif(xd, 0), 0) + 0.2 * coalesce(external / nullif(xe, 0), 0) + 0.2 * coalesce(bw / nullif(xb, 0), 0), 6) AS importance,
  CASE WHEN density >= md AND NOT conductance >= mc THEN 'core' WHEN density >= md THEN 'hub' WHEN conductance >= mc THEN 'bridge' ELSE 'peripheral' END AS role FROM g""",
    "windowed_counts": f"SELECT time_bucket(INTERVAL 30 DAY, loaded_at, TIMESTAMP '1970-01-01') AS start, source AS node, hc50 AS cluster, count(*) AS n FROM {META} WHERE source IS NOT NULL AND hc50 IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1, 2, 3",
}
