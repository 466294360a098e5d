"""Queries of distance curves, coverage and rarefaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainloom.operators import diversity as D
from strainloom.session import read_table

N_STAR, REPLICATES, SEED = 50, 200, 42


def near(s, d):
    """Sources in lower case; whole rows repeated in the table count once."""
    t = read_table(s, d, "ecdf_hc5").distinct()
    hc50 = F.regexp_replace("hc50", r"\.0*$", "").try_cast("long")
    return t.select("biosample_acc", F.lower("source").alias("source"), hc50.alias("hc50"), F.col("closest_distance").alias("distance"), F.md5(F.concat_ws("|", F.coalesce("biosample_acc", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("hc50", F.lit("")), F.coalesce(F.floor(D.known(F.col("closest_distance")) * 1000).cast("string"), F.lit("")))).alias("key")).where("source is not null")


QUERIES = {
    "ecdf_by_source": lambda s, d: D.ecdf(near(s, d), ["source"], "distance"),
    "ecdf_auc": lambda s, d: D.ecdf_auc(D.ecdf(near(s, d), ["source"], "distance"), ["source"]),
    "coverage_by_source": lambda s, d: D.coverage(near(s, d), ["source"], "hc50", "distance", [20, 50, 100]),
    "rarefaction_cutoff": lambda s, d: D.rarefaction_cutoff(near(s, d), "source"),
    "rarefied_summary": lambda s, d: D.rarefied(near(s, d), "key", "source", "hc50", "distance", N_STAR, REPLICATES, SEED),
}

_W = r"""WITH t AS (SELECT DISTINCT * FROM ecdf_hc5), near AS (SELECT biosample_acc, lower(source) AS source, TRY_CAST(regexp_replace(hc50, '\.0*$', '') AS BIGINT) AS hc50, CASE WHEN NOT isnan(closest_distance) THEN closest_distance END AS d,
 md5(concat_ws('|', coalesce(biosample_acc, ''), coalesce(source, ''), coalesce(hc50, ''), coalesce(CAST(CAST(floor((CASE WHEN NOT isnan(closest_distance) THEN closest_distance END) * 1000) AS BIGINT) AS VARCHAR), ''))) AS key FROM t WHERE source IS NOT NULL)"""
_ECDF = ", ecdf AS (SELECT source, CAST(x AS INT) AS x, round(avg(CASE WHEN d <= x THEN 1.0 ELSE 0.0 END), 6) AS y FROM near, range(101) r(x) GROUP BY 1, 2)"


def _coverage(rows: str, by: str, thresholds: list[int]) -> str:
    dist = ", ".join(f"round(1 - count(*) FILTER (WHERE d > {t}) / CAST(nullif(count(d), 0) AS DOUBLE), 6) AS distc{t}" for t in thresholds)
    return f"""SELECT * FROM (SELECT {by}, CAST(sum(c) AS BIGINT) AS n, round(1 - count(*) FILTER (WHERE c = 1) / sum(c), 6) AS goods, round(ch, 6) AS chao1, round(count(*) / ch, 6) AS obs_chao1 FROM
      (SELECT *, CASE WHEN f2 > 0 THEN s + f1 * f1 / (2.0 * f2) ELSE s + f1 * (f1 - 1) / 2.0 END AS ch FROM (SELECT *, count(*) OVER w AS s, count(*) FILTER (WHERE c = 1) OVER w AS f1, count(*) FILTER (WHERE c = 2) OVER w AS f2 FROM
        (SELECT {by}, hc50, count(*) AS c FROM {rows} WHERE hc50 IS NOT NULL GROUP BY {by}, hc50) WINDOW w AS (PARTITION BY {by}))) GROUP BY {by}, ch) JOIN (SELECT {by}, {dist} FROM {rows} GROUP BY {by}) USING ({by})"""


_RARE = f""", sized AS (SELECT source, count(*) AS n_available FROM near GROUP BY 1 HAVING count(*) >= {N_STAR}),
 drawn AS (SELECT * FROM (SELECT near.*, r AS replicate, row_number() OVER (PARTITION BY source, r ORDER BY md5('{SEED}:' || r || ':' || key), key) AS o FROM near JOIN sized USING (source), range({REPLICATES}) t(r)) WHERE o <= {N_STAR}),
 cov AS ({_coverage("drawn", "source, replicate", [20, 50, 100])}),
 cur AS (SELECT source, replicate, x, round(avg(CASE WHEN d <= x THEN 1.0 ELSE 0.0 END), 6) AS y FROM drawn, range(51) g(x) WHERE d IS NOT NULL GROUP BY 1, 2, 3),
 auc AS (SELECT source, replicate, round(sum(CASE WHEN x IN (0, 50) THEN y / 2 ELSE y END) / 50, 6) AS auc FROM cur GROUP BY 1, 2),
 both_s AS (SELECT * FROM cov LEFT JOIN auc USING (source, replicate))
 SELECT source, n_available, {", ".join(f"round(avg({c}) + 1e-9, 4) AS {n}_mean, round(quantile_cont({c}, 0.025) + 1e-9, 4) AS {n}_lo, round(quantile_cont({c}, 0.975) + 1e-9, 4) AS {n}_hi" for n, c in (("auc", "auc"), ("goods", "goods"), ("obs_chao1", "obs_chao1"), *((f"distc{t}", f"distc{t}") for t in (20, 50, 100))))}
 FROM both_s JOIN sized USING (source) GROUP BY 1, 2"""

SQL = {
    "ecdf_by_source": _W + _ECDF + " SELECT * FROM ecdf",
    "ecdf_auc": _W + _ECDF + " SELECT source, round(sum(CASE WHEN x IN (0, 50) THEN y / 2 ELSE y END) / 50, 6) AS auc FROM ecdf WHERE x <= 50 GROUP BY 1",
    "coverage_by_source": _W + " " + _coverage("near", "source", [20, 50, 100]),
    "rarefaction_cutoff": _W + " SELECT CAST(floor(greatest(50.0, quantile_cont(n, 0.1))) AS BIGINT) AS cutoff FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM near GROUP BY source)",
    "rarefied_summary": _W + _RARE,
}
