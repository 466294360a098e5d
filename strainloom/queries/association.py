"""Queries of breadth, burden, permutation and stratified tests, and of generalism."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainloom.operators import association as A
from strainloom.operators import inference as I
from strainloom.queries.base import WITH, counts_of, observations
from strainloom.session import cut

#: Permutations of the feed tests (their p-values are multiples of 1 / (PERMUTATIONS + 1)) and rounds of eligibility.
PERMUTATIONS, SEED, BREADTH = 500, 9, 3


def marks():
    """Feed, human and target nodes."""
    feed, human = F.col("node").startswith("feedmill"), F.col("node").startswith("patient")
    return feed, human, ~feed & ~human


def summary(s, d):
    feed, human, targets = marks()
    return A.breadth(counts_of(s, d), feed, targets, human)


def permuted_breadth(s, d, permutations=PERMUTATIONS):
    """Breadth statistics of clusters in each permutation of the node labels."""
    feed, _, targets = marks()
    rows = observations(s, d)
    dealt = A.permuted_labels(rows, "row_id", "node", permutations, SEED).join(rows.select("row_id", "cluster"), "row_id")
    counts = dealt.groupBy("replicate", "node", "cluster").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("replicate", "cluster").agg(F.sum(F.when(feed, F.col("n")).otherwise(0)).alias("feed_count"), F.count_if(targets).alias("target_breadth")).withColumn("feed_present", F.col("feed_count") > 0)
    return A.breadth_statistics(per, ["replicate"])


BREADTH_STATISTICS = ["mean_with", "mean_without", "difference", "r_log_feed", "n_ge1", "n_ge2", "n_ge3"]


def feed_permutation(s, d):
    """Observed breadth statistics beside those of permuted node labels, with one- and two-sided p."""
    return A.permutation_p(A.breadth_statistics(summary(s, d), []), cut(permuted_breadth(s, d)), BREADTH_STATISTICS)


def binned(s, d):
    return A.quantile_bins(summary(s, d).where("total >= 2"), "total", 5)


def human_top(s, d):
    """The tenth of the clusters with the largest human share, ties by cluster."""
    return A.top_flagged(summary(s, d).where("total >= 2"), "human_fraction", "human_top")


def eligible(s, d):
    """Eligible clusters with their size bin; their stratum is breadth and bin."""
    return A.quantile_bins(A.eligible_clusters(summary(s, d), BREADTH), "log_total", 5)


def strata(s, d):
    return A.two_by_two(eligible(s, d), ["target_breadth", "bin"], "feed_present", "human_present")


def enrichment(s, d, metric="human_fraction", permutations=PERMUTATIONS):
    """(observed, a row a permutation) of the eco subset (feed clusters) among the clusters with the largest metric, the
    eco labels dealt out anew within strata of breadth and size. metric: human_fraction, or residual, the size-adjusted
    one of a negative-binomial fit."""
    rows = eligible(s, d)
    if metric == "residual":
        rows = I.size_adjusted(rows, "human_count", ["log_total", "target_breadth"])
    rows = cut(A.top_flagged(rows, metric, "human_top").withColumnRenamed(metric, "metric").select("cluster", "feed_present", "human_top", "metric", "target_breadth", "bin", "human_count"))
    if rows.isEmpty():
        raise ValueError("no eligible clusters")
    dealt = A.permuted_within(rows, "cluster", "feed_present", ["target_breadth", "bin"], permutations, SEED).join(rows.select("cluster", "human_top", "metric"), "cluster")
    return A.enrichment_stats(rows, [], "feed_present", "human_top", "metric"), cut(A.enrichment_stats(dealt, ["replicate"], "feed_present", "human_top", "metric"))


def crude(s, d):
    got = A.crude_tests(A.two_by_two(eligible(s, d), [], "feed_present", "human_present"))
    return got.select("a", "b", "c", "d", "odds_ratio", *[F.round(c, 6).alias(c) for c in ("fisher_or", "chi2")], *[f"expected_{c}" for c in "abcd"])


def crude_p(s, d):
    """p-values of the crude table and of the pooled test."""
    table = A.crude_tests(A.two_by_two(eligible(s, d), [], "feed_present", "human_present"))
    pooled = A.mantel_haenszel(strata(s, d)).select(F.round(2 * A.normal_tail(F.sqrt("chi2")), 8).alias("cmh_p"))
    return table.select(*[F.round(c, 8).alias(c) for c in ("fisher_greater", "fisher_two_sided", "chi2_p")]).crossJoin(F.broadcast(pooled))


def ranked_clusters(s, d):
    """Eligible clusters, the top ones by their human share first."""
    rows = A.top_flagged(eligible(s, d), "human_fraction", "human_top")
    return rows.select("cluster", "human_top", "human_fraction", "feed_present", "human_count").orderBy(F.desc("human_top"), F.desc_nulls_last("human_fraction"), F.desc("feed_present"), F.desc("human_count"), "cluster")


QUERIES = {
    "burden_summary": summary,
    "feed_breadth_statistics": lambda s, d: A.breadth_statistics(summary(s, d), []),
    "feed_breadth_permutation": feed_permutation,
    "quantile_bins": lambda s, d: binned(s, d).select("cluster", "total", "bin"),
    "human_top_flag": lambda s, d: human_top(s, d).select("cluster", "human_fraction", "human_top"),
    "two_by_two_odds": lambda s, d: A.two_by_two(human_top(s, d), [], "feed_present", "human_top"),
    "eligible_clusters": lambda s, d: eligible(s, d).select("cluster", "target_breadth", "target_total", "log_total", "bin", "feed_present", "human_present"),
    "ranked_clusters": ranked_clusters,
    "enrichment_observed": lambda s, d: A.enrichment_stats(A.top_flagged(eligible(s, d), "human_fraction", "human_top"), [], "feed_present", "human_top", "human_fraction"),
    "enrichment_test": lambda s, d: A.permutation_p(*enrichment(s, d), A.ENRICHMENT),
    "enrichment_size_adjusted": lambda s, d: A.permutation_p(*enrichment(s, d, "residual"), A.ENRICHMENT),
    "crude_tests": crude,
    "crude_p_values": crude_p,
    "cmh_strata": strata,
    "cmh_pooled": lambda s, d: A.mantel_haenszel(strata(s, d)),
    "cluster_entropy": lambda s, d: A.cluster_entropy(counts_of(s, d)),
    "cluster_generalism_geom": lambda s, d: A.cluster_generalism(A.cluster_entropy(counts_of(s, d))),
    "cluster_generalism_enriched": lambda s, d: A.cluster_generalism(A.cluster_entropy(counts_of(s, d)), A.enrichment_index(counts_of(s, d))),
    "node_generalism": lambda s, d: A.node_generalism(counts_of(s, d), A.cluster_generalism(A.cluster_entropy(counts_of(s, d))), 20, 5),
}

_S = WITH + """, s AS (SELECT *, feed_count > 0 AS feed_present, human_count > 0 AS human_present, round(human_count / CAST(total AS DOUBLE), 6) AS human_fraction, round(ln(1 + total), 6) AS log_total FROM
 (SELECT cluster, CAST(sum(CASE WHEN node LIKE 'feedmill%' THEN n ELSE 0 END) AS BIGINT) AS feed_count, count(*) FILTER (WHERE node NOT LIKE 'feedmill%' AND node NOT LIKE 'patient%') AS target_breadth,
  CAST(sum(CASE WHEN node NOT LIKE 'feedmill%' AND node NOT LIKE 'patient%' THEN n ELSE 0 END) AS BIGINT) AS target_total, CAST(sum(n) AS BIGINT) AS total, count(*) AS global_breadth, CAST(sum(CASE WHEN node LIKE 'patient%' THEN n ELSE 0 END) AS BIGINT) AS human_count FROM counts GROUP BY 1))"""
_STATS = """round(avg(CASE WHEN feed_present THEN target_breadth END), 6) AS mean_with, round(avg(CASE WHEN NOT feed_present THEN target_breadth END), 6) AS mean_without,
 round(avg(CASE WHEN feed_present THEN target_breadth END) - avg(CASE WHEN NOT feed_present THEN target_breadth END), 6) AS difference, round(corr(ln(1 + feed_count), CAST(target_breadth AS DOUBLE)), 6) AS r_log_feed,
 count(*) FILTER (WHERE feed_present AND target_breadth >= 1) AS n_ge1, count(*) FILTER (WHERE feed_present AND target_breadth >= 2) AS n_ge2, count(*) FILTER (WHERE feed_present AND target_breadth >= 3) AS n_ge3"""
_BIN = ", s2 AS (SELECT * FROM s WHERE total >= 2), ed AS (SELECT list_sort(list_distinct(quantile_cont(CAST(total AS DOUBLE), [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM s2), b AS (SELECT s2.*, CASE WHEN len(e) <= 1 THEN 'all' ELSE CAST(least(len(list_filter(e[2:], lambda q: q < total)) + 1, len(e) - 1) AS VARCHAR) END AS bin FROM s2, ed)"
_TOP = ", s2 AS (SELECT * FROM s WHERE total >= 2), h AS (SELECT *, row_number() OVER (ORDER BY human_fraction DESC, cluster) <= greatest(1, ceil(0.1 * count(*) OVER ())) AS human_top FROM s2)"
_ABCD = "count(*) FILTER (WHERE {e} AND {o}) AS a, count(*) FILTER (WHERE {e} AND NOT {o}) AS b, count(*) FILTER (WHERE NOT {e} AND {o}) AS c, count(*) FILTER (WHERE NOT {e} AND NOT {o}) AS d"
_OR = "round((a + 0.5) * (d + 0.5) / CAST((b + 0.5) * (c + 0.5) AS DOUBLE), 6) AS odds_ratio"
_ELI = ", s3 AS (SELECT * FROM s WHERE target_breadth >= 3), ed3 AS (SELECT list_sort(list_distinct(quantile_cont(log_total, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM s3), el AS (SELECT s3.*, CASE WHEN len(e) <= 1 THEN 'all' ELSE CAST(least(len(list_filter(e[2:], lambda q: q < log_total)) + 1, len(e) - 1) AS VARCHAR) END AS bin FROM s3, ed3)"
_STRATA = _ELI + f", strata AS (SELECT *, {_OR} FROM (SELECT target_breadth, bin, {_ABCD.format(e='feed_present', o='human_present')} FROM el GROUP BY 1, 2))"
_ENT = ", sh AS (SELECT c.*, n / CAST(sum(n) OVER (PARTITION BY cluster) AS DOUBLE) AS p FROM counts c), ent AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_categories, round(greatest(0.0, least(1.0, -sum(p * ln(p + 1e-12)) / (SELECT ln(count(*)) FROM nodes))), 6) AS norm_entropy, round(max(p), 6) AS max_share FROM sh GROUP BY 1), gen AS (SELECT *, round((1 - norm_entropy) * greatest(0.0, least(1.0, (max_share - 1.0 / km) / (1 - 1.0 / km))), 6) AS specialism FROM ent, (SELECT CAST(max(n_categories) AS DOUBLE) AS km FROM ent)), gen2 AS (SELECT cluster, n_total, n_categories, norm_entropy, max_share, specialism, round(1 - specialism, 6) AS generalism FROM gen)"



def _perm_p(statistics):
    """SQL of permutation_p over nl (a row a replicate) and ob (the observed row)."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS statistic, CAST({c} AS DOUBLE) AS x FROM {{t}}" for c in statistics)
    return f""", dl AS (SELECT * FROM ({long.format(t="nl")}) WHERE x IS NOT NULL), ol AS ({long.format(t="ob").replace(" AS x", " AS observed")}), ml AS (SELECT statistic, avg(x) AS m, stddev_samp(x) AS sd FROM dl GROUP BY 1)
 SELECT statistic, observed, round(any_value(m), 6) AS perm_mean, round(any_value(sd), 6) AS perm_sd, round((count(*) FILTER (WHERE x >= observed) + 1) / (count(*) + 1.0), 6) AS p_greater, round((count(*) FILTER (WHERE x <= observed) + 1) / (count(*) + 1.0), 6) AS p_less, round((count(*) FILTER (WHERE abs(x - m) >= abs(observed - m)) + 1) / (count(*) + 1.0), 6) AS p_two_sided
 FROM dl JOIN ol USING (statistic) JOIN ml USING (statistic) GROUP BY 1, 2"""


_FLAG = ", et AS (SELECT *, row_number() OVER (ORDER BY human_fraction DESC, cluster) <= greatest(1, ceil(0.1 * count(*) OVER ())) AS human_top FROM el)"
_ENR = """a + b + c + d AS n_eligible, a + b AS n_eco, c + d AS n_other, a + c AS n_top, a AS eco_in_top, round(a / nullif(a + c, 0), 6) AS share_of_top, round(a / nullif(a + b, 0), 6) AS share_of_eco,
 round((a + 0.5) * (d + 0.5) / CAST((b + 0.5) * (c + 0.5) AS DOUBLE), 6) AS odds_ratio, round(me, 6) AS mean_eco, round(mo, 6) AS mean_other, round(me - mo, 6) AS mean_difference"""
_CELLS = _ABCD.format(e="feed_present", o="human_top") + ", avg(CASE WHEN feed_present THEN human_fraction END) AS me, avg(CASE WHEN NOT feed_present THEN human_fraction END) AS mo"

SQL = {
    "burden_summary": _S + " SELECT * FROM s",
    "feed_breadth_statistics": _S + f" SELECT {_STATS} FROM s",
    "feed_breadth_permutation": _S
    + f""", pl AS (SELECT node, row_number() OVER (ORDER BY row_id) AS place FROM obs), sp AS (SELECT r AS replicate, row_id, cluster, row_number() OVER (PARTITION BY r ORDER BY md5('{SEED}:' || r || ':' || row_id), row_id) AS place FROM obs, range({PERMUTATIONS}) t(r)),
 pc AS (SELECT replicate, node, cluster, count(*) AS n FROM sp JOIN pl USING (place) GROUP BY 1, 2, 3),
 ps AS (SELECT replicate, cluster, sum(CASE WHEN node LIKE 'feedmill%' THEN n ELSE 0 END) AS feed_count, feed_count > 0 AS feed_present, count(*) FILTER (WHERE node NOT LIKE 'feedmill%' AND node NOT LIKE 'patient%') AS target_breadth FROM pc GROUP BY 1, 2),
 nl AS (SELECT replicate, {_STATS} FROM ps GROUP BY 1), ob AS (SELECT {_STATS} FROM s)"""
    + _perm_p(BREADTH_STATISTICS),
    "quantile_bins": _S + _BIN + " SELECT cluster, total, bin FROM b",
    "human_top_flag": _S + _TOP + " SELECT cluster, human_fraction, human_top FROM h",
    "two_by_two_odds": _S + _TOP + f" SELECT *, {_OR} FROM (SELECT {_ABCD.format(e='feed_present', o='human_top')} FROM h)",
    "cmh_strata": _S + _STRATA + " SELECT * FROM strata",
    "cmh_pooled": _S
    + _STRATA
    + """, z AS (SELECT a + q AS a, b + q AS b, c + q AS c, d + q AS d FROM (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0.0 END AS q FROM (SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(c AS DOUBLE) AS c, CAST(d AS DOUBLE) AS d FROM strata))),
 y AS (SELECT *, a + b + c + d AS n, a + b AS r1, a + c AS c1 FROM z),
 w AS (SELECT count(*) AS k, sum(a * d / n) AS r, sum(b * c / n) AS s, sum((a + d) / n * (a * d / n)) AS pr, sum((a + d) / n * (b * c / n) + (b + c) / n * (a * d / n)) AS mix, sum((b + c) / n * (b * c / n)) AS qs, sum(a - r1 * c1 / n) AS ex, sum(CASE WHEN n > 1 THEN r1 * (n - r1) * c1 * (n - c1) / (n * n * (n - 1)) ELSE 0.0 END) AS var FROM y),
 v AS (SELECT *, r / s AS p, sqrt(pr / (2 * r * r) + mix / (2 * r * s) + qs / (2 * s * s)) AS se FROM w)
 SELECT k AS n_strata, round(p, 6) AS pooled_or, round(exp(ln(p) - 1.959963984540054 * se), 6) AS ci_low, round(exp(ln(p) + 1.959963984540054 * se), 6) AS ci_high, round(ex * ex / nullif(var, 0), 6) AS chi2 FROM v""",
    "eligible_clusters": _S + _ELI + " SELECT cluster, target_breadth, target_total, log_total, bin, feed_present, human_present FROM el",
    "ranked_clusters": _S + _ELI + _FLAG + " SELECT cluster, human_top, human_fraction, feed_present, human_count FROM et",
    "enrichment_observed": _S + _ELI + _FLAG + f" SELECT {_ENR} FROM (SELECT {_CELLS} FROM et)",
    "enrichment_test": _S
    + _ELI
    + _FLAG
    + f""", pl AS (SELECT target_breadth, bin, feed_present, row_number() OVER (PARTITION BY target_breadth, bin ORDER BY cluster) AS place FROM et),
 sp AS (SELECT r AS replicate, cluster, human_top, human_fraction, target_breadth, bin, row_number() OVER (PARTITION BY r, target_breadth, bin ORDER BY md5('{SEED}:' || r || ':' || cluster), cluster) AS place FROM et, range({PERMUTATIONS}) t(r)),
 nl AS (SELECT replicate, {_ENR} FROM (SELECT replicate, {_CELLS} FROM sp JOIN pl USING (target_breadth, bin, place) GROUP BY 1)), ob AS (SELECT {_ENR} FROM (SELECT {_CELLS} FROM et))"""
    + _perm_p(A.ENRICHMENT),
    "crude_tests": _S
    + _ELI
    + f", t AS (SELECT *, {_OR}, CAST(a + b + c + d AS DOUBLE) AS n, a + b AS r1, a + c AS c1 FROM (SELECT {_ABCD.format(e='feed_present', o='human_present')} FROM el)), x AS (SELECT *, r1 * c1 / n AS ea, r1 * (n - c1) / n AS eb, (n - r1) * c1 / n AS ec, (n - r1) * (n - c1) / n AS ed FROM t) SELECT a, b, c, d, odds_ratio, round(a * d / nullif(CAST(b * c AS DOUBLE), 0), 6) AS fisher_or, round(pow(a - ea, 2) / ea + pow(b - eb, 2) / eb + pow(c - ec, 2) / ec + pow(d - ed, 2) / ed, 6) AS chi2, round(ea, 6) AS expected_a, round(eb, 6) AS expected_b, round(ec, 6) AS expected_c, round(ed, 6) AS expected_d FROM x",
    "cluster_entropy": WITH + _ENT + " SELECT * FROM ent",
    "cluster_generalism_geom": WITH + _ENT + " SELECT * FROM gen2",
    "node_generalism": WITH
    + _ENT
    + """, sz AS (SELECT *, sum(n) OVER (PARTITION BY node) AS nn, sum(n) OVER (PARTITION BY cluster) AS nc, count(*) OVER (PARTITION BY cluster) AS gb FROM counts), k1 AS (SELECT sz.*, specialism, generalism FROM sz JOIN gen2 USING (cluster) WHERE nn >= 20 AND nc >= 5),
 k2 AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY node) AS DOUBLE) AS p, count(*) OVER (PARTITION BY node) AS m, row_number() OVER (PARTITION BY node ORDER BY n DESC, cluster) AS r FROM k1)
 SELECT node, CAST(max(nn) AS BIGINT) AS n_isolates, CAST(sum(n) AS BIGINT) AS n_scored, max(m) AS n_clusters, round(sum(p * specialism), 6) AS specialism, round(sum(p * generalism), 6) AS generalism, round(exp(-sum(p * ln(p))), 6) AS effective_clusters, round(CASE WHEN max(m) > 1 THEN -sum(p * ln(p)) / ln(max(m)) ELSE 1.0 END, 6) AS evenness, round(sum(p * p), 6) AS concentration, round(sum(CASE WHEN gb = 1 THEN p ELSE 0.0 END), 6) AS private_share, round(sum(n) / max(nn), 6) AS scored_share, round(sum(p * gb), 6) AS mean_breadth, """
    + ", ".join(f"round(sum(CASE WHEN r <= greatest(1, ceil({t} * m / 100.0)) THEN p ELSE 0.0 END), 6) AS top{t}_share" for t in (1, 5, 10, 25, 50))
    + """ FROM k2 GROUP BY 1""",
}
