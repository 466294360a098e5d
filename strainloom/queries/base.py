"""Observations of the test tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainloom.operators.counts import count_table
from strainloom.operators.curation import with_terms
from strainloom.session import read_table

META = "metadata_training_testing"
REGION = "curated_source_region"
#: Words beside a region that say nothing of it.
NOISE = ["node", "region", "src", "auto", "checked"]
_PAIR = "regexp_replace(lower(term), '[^a-z]+', '', 'g') AS name FROM reference_terms WHERE field_name = 'curated_source_region'"
REGIONS_SQL = rf"""al AS (SELECT term, {_PAIR} UNION SELECT term, regexp_replace(split_part(lower(term), '_', 2) || split_part(lower(term), '_', 1), '[^a-z]+', '', 'g') FROM reference_terms WHERE field_name = 'curated_source_region'),
 vals AS (SELECT DISTINCT {REGION} AS value, regexp_replace(regexp_replace(lower({REGION}), '\b({'|'.join(NOISE)})\b|v[0-9]+', ' ', 'g'), '[^a-z]+', '', 'g') AS k FROM {META} WHERE {REGION} IS NOT NULL),
 rcand AS (SELECT k, term, CASE WHEN k = name THEN 0 WHEN levenshtein(k, name) <= 2 THEN levenshtein(k, name) WHEN starts_with(name, k) AND length(k) >= 0.65 * length(name) THEN 3 END AS cost FROM (SELECT DISTINCT k FROM vals WHERE k <> ''), al),
 rbest AS (SELECT k, term FROM rcand WHERE cost IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY cost, term) = 1),
 rmap AS (SELECT value, term FROM vals LEFT JOIN rbest USING (k))"""
OBS_SQL = f"SELECT row_id, term AS node, hc50 AS cluster FROM {META} JOIN rmap ON value = {REGION} WHERE hc50 IS NOT NULL AND term IS NOT NULL"
WITH = f"WITH {REGIONS_SQL}, obs AS ({OBS_SQL}), counts AS (SELECT node, cluster, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY 1, 2), nodes AS (SELECT DISTINCT node FROM counts), stats AS (SELECT node, CAST(sum(n) AS DOUBLE) AS s1, CAST(sum(n * n) AS DOUBLE) AS s2, CAST(count(*) AS DOUBLE) AS rich FROM counts GROUP BY 1), kk AS (SELECT CAST(count(DISTINCT cluster) AS DOUBLE) AS k FROM counts), met AS (SELECT a.node AS u, b.node AS v, CAST(sum(a.n * b.n) AS DOUBLE) AS dot, CAST(sum(least(a.n, b.n)) AS DOUBLE) AS lst, CAST(count(*) AS DOUBLE) AS bth FROM counts a JOIN counts b ON a.cluster = b.cluster AND a.node < b.node GROUP BY 1, 2), pairs AS (SELECT a.node AS u, b.node AS v, coalesce(dot, 0) AS dot, coalesce(lst, 0) AS lst, coalesce(bth, 0) AS bth, a.s1 AS s1_u, b.s1 AS s1_v, a.s2 AS s2_u, b.s2 AS s2_v, a.rich AS rich_u, b.rich AS rich_v FROM stats a JOIN stats b ON a.node < b.node LEFT JOIN met ON met.u = a.node AND met.v = b.node), sims AS (SELECT u, v, round(dot / sqrt(s2_u * s2_v), 6) AS cosine FROM pairs), edges AS (SELECT u, v, cosine AS weight FROM sims WHERE cosine > 0.35), both_ways AS (SELECT u AS a, v AS b, weight FROM edges UNION ALL SELECT v, u, weight FROM edges), part AS (SELECT node, split_part(node, '_', 1) AS community FROM nodes)"


def region_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "reference_terms").where(F.col("field_name") == REGION).select("term")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, the region as written, the node it means (null for none) and hc50 of all rows."""
    meta = read_table(spark, sf_dir, META).select("row_id", REGION, F.col("hc50").alias("cluster"))
    return with_terms(meta, REGION, region_terms(spark, sf_dir), NOISE, "node")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, node, cluster of the isolates with a cluster whose region means one of the reference list, however it is
    written; region_unmatched reports the others."""
    return regions(spark, sf_dir).where("cluster is not null and node is not null").select("row_id", "node", "cluster")


def counts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_table(observations(spark, sf_dir), "node", "cluster")
