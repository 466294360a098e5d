"""Sources mixed to target shares of the total size, small ones repeated a capped number of times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repetition_rates(sized: DataFrame, targets: DataFrame, size_col: str) -> DataFrame:
    """(source, target_share, max_repeats, size, rate): how often each source's documents are wanted.

    rate = share * total size / size of the source, at most max_repeats; the total is that of all documents. A
    target source without documents has size 0 and rate 0; sources without a target are not wanted (rate 0).
    """
    sizes = sized.groupBy("source").agg(F.sum(F.coalesce(F.col(size_col), F.lit(0)).cast("long")).alias("size"))
    total = F.broadcast(sizes.agg(F.sum("size").alias("total")))  # one row
    both = sizes.join(targets, sizes.source.eqNullSafe(targets.source), "full").select(F.coalesce(sizes.source, targets.source).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("size", F.lit(0)).alias("size"))
    rate = F.when(F.col("size") > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.col("total") / F.col("size"))).otherwise(0.0)
    return both.crossJoin(total).select("source", "target_share", "max_repeats", "size", rate.alias("rate"))


def mix_sources(sized: DataFrame, targets: DataFrame, id_col: str, size_col: str, seed: int = 23) -> DataFrame:
    """(id, source, copy, size): each document floor(rate) times, and once more with the probability of the rest.

    The draw is a hash of id and seed: the same under any partitioning. No document comes more than max_repeats
    times. Documents of size 0 or null cost nothing and come by the same rule with size 0; null sources match a
    null target only. `targets` is small (one row for each source); repeated rows of a document are each drawn
    alike. An empty table gives no rows.
    """
    rates = F.broadcast(repetition_rates(sized, targets, size_col).select(F.col("source").alias("__s"), "rate", "max_repeats"))
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    copies = F.least(F.col("max_repeats"), (F.floor("rate") + (drawn < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))
    wanted = sized.select(id_col, "source", F.coalesce(F.col(size_col), F.lit(0)).alias("size")).join(rates, F.col("source").eqNullSafe(F.col("__s")))
    return wanted.withColumn("n", copies).where("n > 0").select(id_col, "source", F.explode(F.sequence(F.lit(1), "n")).alias("copy"), "size")


def shares_reached(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """(source, target_share, rate, n_rows, size, share, expected_share): what each source came to, beside its target and
    the share its rate comes to on average: below the target by the cap on repeats, off the share by the draw alone."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("size").cast("long")).alias("size"))
    total = F.broadcast(got.agg(F.sum("size").alias("total")))
    wanted = rates.select(F.col("source").alias("s"), "target_share", "rate", (F.col("rate") * F.col("size")).alias("expected"))
    hoped = F.broadcast(wanted.agg(F.sum("expected").alias("all_expected")))
    joined = wanted.join(got, F.col("s").eqNullSafe(F.col("source")), "left").crossJoin(total).crossJoin(hoped)
    return joined.select(F.col("s").alias("source"), "target_share", F.round("rate", 6).alias("rate"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("size", F.lit(0)).alias("size"), F.round(F.coalesce(F.col("size") / F.col("total"), F.lit(0.0)), 6).alias("share"), F.round(F.coalesce(F.try_divide("expected", "all_expected"), F.lit(0.0)), 6).alias("expected_share"))
