"""The count table kept up to date from a stream of observations (an addition to the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(rows: DataFrame, time: str, node: str, cluster: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, node, cluster, n) by tumbling windows; rows later than `late` behind the newest are left out of windows
    that are closed. Null keys drop out. Works on batch and streaming tables."""
    kept = rows.select(F.col(time).cast("timestamp").alias("ts"), F.col(node).alias("node"), F.col(cluster).alias("cluster")).where("node is not null and cluster is not null and ts is not null")
    if rows.isStreaming:
        kept = kept.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", window).alias("w"), "node", "cluster").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "node", "cluster", "n")
