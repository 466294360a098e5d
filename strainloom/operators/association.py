"""Breadth, burden and association of clusters with a marked node, and generalism of clusters and nodes."""

from __future__ import annotations

import math
import re
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from strainloom.functions.portable import numbered


def breadth(counts: DataFrame, feed: Column, targets: Column, human: Column | None = None) -> DataFrame:
    """One row for each cluster: rows and presence in the feed nodes, in how many target nodes, in all nodes."""
    aggs = [
        F.sum(F.when(feed, F.col("n")).otherwise(0)).alias("feed_count"),
        F.count_if(targets).alias("target_breadth"),
        F.sum(F.when(targets, F.col("n")).otherwise(0)).alias("target_total"),
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("global_breadth"),
    ]
    if human is not None:
        aggs.append(F.sum(F.when(human, F.col("n")).otherwise(0)).alias("human_count"))
    got = counts.groupBy("cluster").agg(*aggs).withColumn("feed_present", F.col("feed_count") > 0)
    if human is not None:
        got = got.withColumn("human_present", F.col("human_count") > 0).withColumn("human_fraction", F.round(F.col("human_count") / F.col("total"), 6))
    return got.withColumn("log_total", F.round(F.log1p("total"), 6))


def breadth_statistics(summary: DataFrame, by: list[str]) -> DataFrame:
    """Mean breadth with and without feed, their difference, r(log feed, breadth) and the counts of feed clusters."""
    b, fed = F.col("target_breadth"), F.col("feed_present")
    return summary.groupBy(*by).agg(
        F.round(F.avg(F.when(fed, b)), 6).alias("mean_with"),
        F.round(F.avg(F.when(~fed, b)), 6).alias("mean_without"),
        F.round(F.avg(F.when(fed, b)) - F.avg(F.when(~fed, b)), 6).alias("difference"),
        F.round(F.corr(F.log1p("feed_count"), b.cast("double")), 6).alias("r_log_feed"),
        *[F.count_if(fed & (b >= k)).alias(f"n_ge{k}") for k in (1, 2, 3)],
    )


def permuted_labels(rows: DataFrame, id_col: str, label: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, id, label): the labels of all rows dealt out anew in each replicate; margins stay exact."""
    return permuted_within(rows, id_col, label, [], replicates, seed)


def permuted_within(rows: DataFrame, id_col: str, label: str, stratum: list[str], replicates: int, seed: int) -> DataFrame:
    """(replicate, id, label): the labels dealt out anew inside each stratum, so every stratum keeps its labels.

    The k-th row by hash takes the label of the k-th row by id; places are counted in parts of a stratum, so neither a
    replicate nor a hot stratum is sorted in one task. Rows with a null stratum drop out.
    """
    kept = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in stratum], F.lit(True)))
    placed = numbered(kept.select(id_col, *stratum, label), id_col, stratum, "__place").select(*stratum, "__place", label)
    spread = kept.select(id_col, *stratum, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    keyed = spread.withColumn("__key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(id_col).cast("string"))))
    dealt = numbered(keyed, "__key", ["replicate", *stratum], "__place", [id_col])
    return dealt.join(placed, [*stratum, "__place"]).select("replicate", id_col, label)


def subclass(value: Column, text: Column, of: str, terms: list[str], hit: str, miss: str) -> Column:
    """`value`, with `of` parted into hit and miss by whether the text holds one of the terms, whatever its case; a null
    text holds none, other values stay."""
    pattern = "(?i)" + "|".join(re.escape(t) for t in terms)
    return F.when(value == of, F.when(F.coalesce(text.rlike(pattern), F.lit(False)), hit).otherwise(miss)).otherwise(value)


def quantile_bins(rows: DataFrame, value: str, q: int = 5) -> DataFrame:
    """rows + bin: right-closed bins at the distinct quantiles; 'all' where there are at most one."""
    edges = rows.agg(F.array_distinct(F.percentile(value, [i / q for i in range(q + 1)])).alias("edges"))
    place = F.size(F.filter(F.slice("edges", 2, F.size("edges")), lambda e: e < F.col(value))) + 1
    return rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.when(F.size("edges") <= 1, F.lit("all")).otherwise(F.least(place, F.size("edges") - 1).cast("string"))).drop("edges")


def two_by_two(rows: DataFrame, by: list[str], exposure: str, outcome: str) -> DataFrame:
    """by + (a, b, c, d, odds_ratio): counts and the odds ratio with 0.5 added to every cell."""
    e, o = F.col(exposure), F.col(outcome)
    got = rows.groupBy(*by).agg(F.count_if(e & o).alias("a"), F.count_if(e & ~o).alias("b"), F.count_if(~e & o).alias("c"), F.count_if(~e & ~o).alias("d"))
    h = [F.col(x) + 0.5 for x in "abcd"]
    return got.withColumn("odds_ratio", F.round(h[0] * h[3] / (h[1] * h[2]), 6))


def eligible_clusters(summary: DataFrame, min_breadth: int = 3, min_total: int = 0) -> DataFrame:
    """The clusters of a breadth summary in at least min_breadth target nodes with at least min_total rows there."""
    return summary.where((F.col("target_breadth") >= min_breadth) & (F.col("target_total") >= min_total))


def crude_tests(tables: DataFrame) -> DataFrame:
    """tables (a, b, c, d) + their odds ratio (null where b or c is 0), Fisher's p, chi-square without correction, its p
    and the expected counts."""
    n, r, c = F.col("a") + F.col("b") + F.col("c") + F.col("d"), F.col("a") + F.col("b"), F.col("a") + F.col("c")
    got = tables.withColumn("fisher_or", F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c")))
    got = got.withColumn("fisher_greater", fisher_greater("a", "b", "c", "d")).withColumn("fisher_two_sided", fisher_two_sided("a", "b", "c", "d"))
    wanted = {"a": r * c / n, "b": r * (n - c) / n, "c": (n - r) * c / n, "d": (n - r) * (n - c) / n}
    for name, e in wanted.items():
        got = got.withColumn(f"expected_{name}", F.round(e, 6))
    chi2 = sum((F.try_divide((F.col(x) - e) * (F.col(x) - e), e) for x, e in wanted.items()), F.lit(0.0))
    return got.withColumn("chi2", chi2).withColumn("chi2_p", 2 * normal_tail(F.sqrt("chi2")))


def mantel_haenszel(tables: DataFrame) -> DataFrame:
    """(n_strata, pooled_or, ci_low, ci_high, chi2) over strata (a, b, c, d), those with a zero cell with 0.5 added to
    every cell: pooled odds ratio, its 95 % interval by the variance of Robins, Breslow and Greenland, and the test
    statistic of no association, uncorrected."""
    add = F.when(F.least("a", "b", "c", "d") == 0, 0.5).otherwise(0.0)
    t = tables.select(*[(F.col(x) + add).alias(x) for x in "abcd"])
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    r1, c1 = F.col("a") + F.col("b"), F.col("a") + F.col("c")
    r, s = F.col("a") * F.col("d") / n, F.col("b") * F.col("c") / n
    p, q = (F.col("a") + F.col("d")) / n, (F.col("b") + F.col("c")) / n
    var = F.when(n > 1, r1 * (n - r1) * c1 * (n - c1) / (n * n * (n - 1))).otherwise(0.0)
    sums = t.agg(F.count(F.lit(1)).alias("n_strata"), F.sum(r).alias("r"), F.sum(s).alias("s"), F.sum(p * r).alias("pr"), F.sum(p * s + q * r).alias("mix"), F.sum(q * s).alias("qs"), F.sum(F.col("a") - r1 * c1 / n).alias("excess"), F.sum(var).alias("var"))
    pooled = F.try_divide("r", "s")
    se = F.sqrt(F.try_divide("pr", 2 * F.col("r") * F.col("r")) + F.try_divide("mix", 2 * F.col("r") * F.col("s")) + F.try_divide("qs", 2 * F.col("s") * F.col("s")))
    z = 1.959963984540054  # the 97.5 percentile of the standard normal
    return sums.select("n_strata", F.round(pooled, 6).alias("pooled_or"), F.round(F.exp(F.log(pooled) - z * se), 6).alias("ci_low"), F.round(F.exp(F.log(pooled) + z * se), 6).alias("ci_high"), F.round(F.try_divide(F.pow("excess", F.lit(2.0)), F.col("var")), 6).alias("chi2"))


def top_flagged(rows: DataFrame, metric: str, name: str, fraction: float = 0.1, tie: str = "cluster") -> DataFrame:
    """rows + name: is a row among the largest ceil(fraction * rows), at least one, by the metric? Ties by `tie`; rows
    without a metric drop out."""
    n = F.broadcast(rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * fraction)).alias("__n")))
    placed = numbered(rows.where(F.col(metric).isNotNull()).withColumn("__key", -F.col(metric).cast("double")), "__key", [], "__place", [tie])
    return placed.crossJoin(n).withColumn(name, F.col("__place") < F.col("__n")).drop("__key", "__place", "__n")


def enrichment_stats(rows: DataFrame, by: list[str], eco: str, top: str, metric: str) -> DataFrame:
    """by + counts, shares, odds ratio and mean metric of the eco subset against the top rows."""
    e, t = F.col(eco), F.col(top)
    cells = {"a": e & t, "b": e & ~t, "c": ~e & t, "d": ~e & ~t}
    got = rows.groupBy(*by).agg(*[F.count_if(v).alias(k) for k, v in cells.items()], F.avg(F.when(e, F.col(metric))).alias("me"), F.avg(F.when(~e, F.col(metric))).alias("mo"))
    half = {k: F.col(k) + 0.5 for k in cells}
    return got.select(
        *by, (F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("n_eligible"), (F.col("a") + F.col("b")).alias("n_eco"), (F.col("c") + F.col("d")).alias("n_other"), (F.col("a") + F.col("c")).alias("n_top"), F.col("a").alias("eco_in_top"),
        F.round(F.try_divide("a", F.col("a") + F.col("c")), 6).alias("share_of_top"), F.round(F.try_divide("a", F.col("a") + F.col("b")), 6).alias("share_of_eco"), F.round(half["a"] * half["d"] / (half["b"] * half["c"]), 6).alias("odds_ratio"),
        F.round("me", 6).alias("mean_eco"), F.round("mo", 6).alias("mean_other"), F.round(F.col("me") - F.col("mo"), 6).alias("mean_difference"),
    )


#: Statistics of the enrichment test that a permutation changes.
ENRICHMENT = ["eco_in_top", "share_of_top", "share_of_eco", "odds_ratio", "mean_eco", "mean_other", "mean_difference"]


def permutation_p(observed: DataFrame, null: DataFrame, statistics: list[str]) -> DataFrame:
    """(statistic, observed, perm_mean, perm_sd, p_greater, p_less, p_two_sided) of one row observed and a row a
    replicate of null: shares of draws at least as far out, the observed one counted in; two-sided about the mean."""
    long = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).cast("double").alias("x")) for s in statistics])))
    seen = F.broadcast(long(observed).withColumnRenamed("x", "observed"))
    draws = long(null).where("x is not null")
    mean = F.broadcast(draws.groupBy("statistic").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd")))
    joined = draws.join(seen, "statistic").join(mean, "statistic")
    x, o, m, n = F.col("x"), F.col("observed"), F.col("m"), F.count(F.lit(1)) + 1
    return joined.groupBy("statistic", "observed").agg(F.round(F.first("m"), 6).alias("perm_mean"), F.round(F.first("sd"), 6).alias("perm_sd"), F.round((F.count_if(x >= o) + 1) / n, 6).alias("p_greater"), F.round((F.count_if(x <= o) + 1) / n, 6).alias("p_less"), F.round((F.count_if(F.abs(x - m) >= F.abs(o - m)) + 1) / n, 6).alias("p_two_sided"))


def _hypergeometric(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> tuple[np.ndarray, ...]:
    """(start of each table's values, k, log probability of k, log probability of a, a repeated) for tables of these
    margins; log factorials are summed once for a batch."""
    a, b, c, d = (v.to_numpy(np.int64) for v in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    log = np.r_[0.0, np.cumsum(np.log(np.arange(1, n.max(initial=0) + 1)))]

    def choose(n, k):
        return log[n] - log[k] - log[n - k]

    lo, hi = np.maximum(0, col - (n - row)), np.minimum(row, col)
    count = hi - lo + 1
    start = np.cumsum(count) - count
    each = np.repeat(np.arange(len(a)), count)
    k = lo[each] + np.arange(count.sum()) - start[each]
    p = choose(row[each], k) + choose(n[each] - row[each], col[each] - k) - choose(n[each], col[each])
    return start, k, p, p[start + a - lo][each] if len(a) else p, a[each]


@F.pandas_udf(DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """One-sided Fisher p of a 2x2 table: the hypergeometric tail from a on; 1 for an empty margin."""
    start, k, p, _, seen = _hypergeometric(a, b, c, d)
    return pd.Series(np.minimum(1.0, np.add.reduceat(np.where(k >= seen, np.exp(p), 0.0), start)) if len(a) else [], dtype="float64")


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher p: all tables of these margins that are at most as probable."""
    start, _, p, own, _ = _hypergeometric(a, b, c, d)
    return pd.Series(np.minimum(1.0, np.add.reduceat(np.where(p <= own + 1e-7, np.exp(p), 0.0), start)) if len(a) else [], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal; chi-square with one degree of freedom: twice the tail of its root."""
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), na_action="ignore").astype("float64")


@F.pandas_udf(DoubleType())
def z_from_upper_p(p: pd.Series, n: pd.Series) -> pd.Series:
    """The z of an upper-tail p from n draws, p kept within 1 / (n + 1) of 0 and 1."""
    edge = 1 / (n + 1)
    return np.maximum(edge, np.minimum(1 - edge, p)).map(lambda v: NormalDist().inv_cdf(1 - v), na_action="ignore").astype("float64")


def cluster_entropy(counts: DataFrame) -> DataFrame:
    """(cluster, n_total, n_categories, norm_entropy, max_share): entropy over nodes as a share of its largest value."""
    k = F.broadcast(counts.agg(F.countDistinct("node").alias("k")))
    p = counts.withColumn("total", F.sum("n").over(Window.partitionBy("cluster"))).withColumn("p", F.col("n") / F.col("total"))
    got = p.groupBy("cluster").agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_categories"), (-F.sum(F.col("p") * F.log(F.col("p") + 1e-12))).alias("h"), F.max("p").alias("max_share")).crossJoin(k)
    norm = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("h") / F.log("k")))).otherwise(0.0)
    return got.select("cluster", "n_total", "n_categories", F.round(norm, 6).alias("norm_entropy"), F.round("max_share", 6).alias("max_share"))


def enrichment_index(counts: DataFrame) -> DataFrame:
    """(cluster, enrichment): rank share of each cluster's strongest one-sided enrichment in a node. Only pairs that
    occur can be enriched, so the table stays sparse."""
    t = counts.withColumn("row", F.sum("n").over(Window.partitionBy("cluster"))).join(F.broadcast(counts.groupBy("node").agg(F.sum("n").alias("col"))), "node").crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all"))))
    a, b, c = F.col("n"), F.col("row") - F.col("n"), F.col("col") - F.col("n")
    d = F.col("all") - F.col("row") - F.col("col") + F.col("n")
    ratio = F.when(b * c == 0, F.lit(float("inf"))).otherwise(a * d / (b * c))
    flat = (F.col("row") == F.col("all")) | (F.col("col") == F.col("all"))
    score = F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), F.log2(ratio)) * F.greatest(F.lit(0.0), -F.log10(fisher_greater(a, b, c, d) + 1e-12)))
    best = t.groupBy("cluster").agg(F.max(F.round(score, 9)).alias("x"))
    # the rank of a value is the number of clusters below it, plus one
    values = numbered(best.groupBy("x").agg(F.count(F.lit(1)).alias("c")), "x", [], "place")
    below = values.withColumn("part", F.floor(F.col("place") / 1000))
    parts = below.groupBy("part").agg(F.sum("c").alias("s"))
    before = F.broadcast(parts.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("h")))
    ranks = below.join(before, "part").select("x", "h", (F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("place")) - F.col("c")).alias("r"))
    return best.join(ranks, "x").select("cluster", F.round(F.when(F.col("h") > 1, F.col("r") / (F.col("h") - 1)).otherwise(0.0), 6).alias("enrichment"))


def cluster_generalism(entropy: DataFrame, enrichment: DataFrame | None = None, weight: float = 0.5) -> DataFrame:
    """entropy + (specialism, generalism): (1 - H) times the dominance of the largest share, mixed with enrichment."""
    k = entropy.agg(F.max("n_categories").cast("double").alias("kmax"))
    dominance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("max_share") - 1 / F.col("kmax"), 1 - 1 / F.col("kmax")), F.lit(0.0))))
    geom = (1 - F.col("norm_entropy")) * dominance
    base = entropy.crossJoin(F.broadcast(k))
    if enrichment is not None:
        base = base.join(enrichment, "cluster", "left")
        geom = weight * geom + (1 - weight) * F.coalesce("enrichment", F.lit(0.0))
    return base.withColumn("specialism", F.round(geom, 6)).withColumn("generalism", F.round(1 - F.col("specialism"), 6)).drop("kmax", "enrichment")


def node_generalism(counts: DataFrame, scores: DataFrame, min_node: int, min_cluster: int, tops: tuple[int, ...] = (1, 5, 10, 25, 50)) -> DataFrame:
    """One row for each node of min_node rows or more, over clusters of min_cluster or more: weighted specialism and
    generalism, share of its rows scored, effective clusters, evenness, concentration, mean breadth of its clusters,
    private share and the shares of its top clusters, `tops` in per cent of them."""
    sized = counts.withColumn("nn", F.sum("n").over(Window.partitionBy("node"))).withColumn("nc", F.sum("n").over(Window.partitionBy("cluster"))).withColumn("gb", F.count(F.lit(1)).over(Window.partitionBy("cluster")))
    kept = sized.where((F.col("nn") >= min_node) & (F.col("nc") >= min_cluster)).join(scores.select("cluster", "specialism", "generalism"), "cluster")
    w = Window.partitionBy("node")
    p = kept.withColumn("p", F.col("n") / F.sum("n").over(w)).withColumn("m", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "cluster")))
    h = -F.sum(F.col("p") * F.log("p"))
    named = {
        "specialism": F.sum(F.col("p") * F.col("specialism")),
        "generalism": F.sum(F.col("p") * F.col("generalism")),
        "effective_clusters": F.exp(h),
        "evenness": F.when(F.max("m") > 1, h / F.log(F.max("m"))).otherwise(1.0),
        "concentration": F.sum(F.col("p") * F.col("p")),
        "private_share": F.sum(F.when(F.col("gb") == 1, F.col("p")).otherwise(0.0)),
        "scored_share": F.sum("n") / F.max("nn"),
        "mean_breadth": F.sum(F.col("p") * F.col("gb")),
        **{f"top{t}_share": F.sum(F.when(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.lit(t) * F.col("m") / 100)), F.col("p")).otherwise(0.0)) for t in tops},
    }
    return p.groupBy("node").agg(F.max("nn").alias("n_isolates"), F.sum("n").alias("n_scored"), F.max("m").alias("n_clusters"), *[F.round(c, 6).alias(k) for k, c in named.items()])
