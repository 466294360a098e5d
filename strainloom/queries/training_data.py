"""Queries of the general training-data operators: packed fields (P2) and skewed keys (P3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainloom.operators.packed import explode_packed
from strainloom.operators.skew import sketch_heavy_keys, skew_aggregate
from strainloom.session import read_table

META = "metadata_training_testing"
PACKED_FIELDS = ["amr_genotypes", "computed_types", "isolate_identifiers"]
SKEWED_FIELDS = ["hc50", "serovar", "curated_source_region"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_packed(read_table(spark, sf_dir, META), "row_id", PACKED_FIELDS)


def _long(spark: SparkSession, sf_dir: str, extra: list[str]) -> DataFrame:
    meta = read_table(spark, sf_dir, META)
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("key_val")) for f in SKEWED_FIELDS])
    return meta.select(F.explode(pairs).alias("p"), *extra).select("p.field_name", "p.key_val", *extra)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _long(spark, sf_dir, [])
    heavy = sketch_heavy_keys(rows, "key_val", 0.02, ["field_name"])
    counts = skew_aggregate(rows, ["field_name", "key_val"], [F.count(F.lit(1)).alias("n_rows")], heavy)
    totals = heavy.select("field_name", "total").distinct()  # one row a field
    return counts.join(F.broadcast(totals), "field_name").where(F.col("n_rows") >= 0.03 * F.col("total")).select("field_name", "key_val")


def p3_key_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and summaries for every value of the three skewed fields."""
    rows = _long(spark, sf_dir, ["biosample_acc", "asm_stats_n_contig", "number_amr_genes", "trust_rounded"])
    heavy = sketch_heavy_keys(rows, "key_val", 0.02, ["field_name"])
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("biosample_acc").alias("n_accessions"),
        F.min("asm_stats_n_contig").alias("min_contigs"),
        F.max("asm_stats_n_contig").alias("max_contigs"),
        F.round(F.avg("number_amr_genes"), 6).alias("mean_amr_genes"),
        F.round(F.sum(F.col("trust_rounded").cast("decimal(18,4)")).cast("double"), 4).alias("sum_trust"),
    ]
    return skew_aggregate(rows, ["field_name", "key_val"], aggs, heavy).drop("is_heavy")


_LONG_SQL = " UNION ALL ".join(f"SELECT '{f}' AS field_name, CAST({f} AS VARCHAR) AS key_val, biosample_acc, asm_stats_n_contig, number_amr_genes, trust_rounded FROM {META} WHERE {f} IS NOT NULL" for f in SKEWED_FIELDS)

QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_key_summaries": p3_key_summaries}
SQL = {
    "p3_found": f"SELECT field_name, key_val FROM (SELECT field_name, key_val, count(*) AS n, sum(count(*)) OVER (PARTITION BY field_name) AS t FROM ({_LONG_SQL}) GROUP BY 1, 2) WHERE n >= 0.03 * t",
    "p3_key_summaries": f"""SELECT field_name, key_val, count(*) AS n_rows, count(DISTINCT biosample_acc) AS n_accessions, min(asm_stats_n_contig) AS min_contigs,
        max(asm_stats_n_contig) AS max_contigs, round(avg(number_amr_genes), 6) AS mean_amr_genes, round(CAST(sum(CAST(trust_rounded AS DECIMAL(18,4))) AS DOUBLE), 4) AS sum_trust
        FROM ({_LONG_SQL}) GROUP BY 1, 2""",
}
