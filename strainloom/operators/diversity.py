"""Distance curves, coverage and rarefaction by source. Null and NaN distances are unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainloom.functions.portable import draw_with_replacement, draw_without_replacement
from strainloom.session import cut

#: Added before means of rounded values are rounded again, so that halves go up whatever the order of the sum.
HAIR = 1e-9


def known(distance: Column) -> Column:
    """The distance, null for NaN."""
    return F.when(~F.isnan(distance), distance)


def ecdf(rows: DataFrame, by: list[str], distance: str, max_d: int = 100, keep_unknown: bool = True) -> DataFrame:
    """by + (x, y): share of the rows with a distance of at most x = 0..max_d; unknown ones stay in the denominator
    unless keep_unknown is off. One histogram a group, then a running sum over its at most max_d + 1 steps."""
    d = known(F.col(distance))
    base = rows if keep_unknown else rows.where(d.isNotNull())
    hist = base.select(*by, F.when(d.isNotNull(), F.greatest(F.lit(0), F.ceil(d))).cast("long").alias("x")).groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"))
    packed = hist.groupBy(*by).agg(F.sum("c").alias("n"), F.collect_list(F.when(F.col("x") <= max_d, F.struct("x", "c"))).alias("h"))
    grid = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_d))).alias("x"))
    upto = F.aggregate(F.filter("h", lambda e: e["x"] <= F.col("x")), F.lit(0).cast("long"), lambda a, e: a + e["c"])
    return grid.select(*by, F.col("x").cast("int").alias("x"), F.round(upto / F.col("n"), 6).alias("y"))


def ecdf_auc(curve: DataFrame, by: list[str], d_max: int = 50) -> DataFrame:
    """by + auc: trapezoid area of the curve up to d_max, divided by d_max."""
    part = F.when((F.col("x") == 0) | (F.col("x") == d_max), F.col("y") / 2).otherwise(F.col("y"))
    return curve.where(F.col("x") <= d_max).groupBy(*by).agg(F.round(F.sum(part) / d_max, 6).alias("auc"))


def coverage(rows: DataFrame, by: list[str], lineage: str, distance: str, thresholds: list[int]) -> DataFrame:
    """by + n, Good's coverage, Chao1 and its ratio, and the share of known distances within each threshold.

    Good's C = 1 - f1 / N; Chao1 = S + f1^2 / (2 f2), or S + f1 (f1 - 1) / 2 without doubletons. Rows with a null
    lineage count for the distances only.
    """
    d = known(F.col(distance))
    lin = rows.where(F.col(lineage).isNotNull()).groupBy(*by, lineage).agg(F.count(F.lit(1)).alias("c"))
    sums = lin.groupBy(*by).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("s"), F.count_if(F.col("c") == 1).alias("f1"), F.count_if(F.col("c") == 2).alias("f2"))
    chao = F.when(F.col("f2") > 0, F.col("s") + F.col("f1") * F.col("f1") / (2.0 * F.col("f2"))).otherwise(F.col("s") + F.col("f1") * (F.col("f1") - 1) / 2.0)
    near = rows.groupBy(*by).agg(*[F.round(1 - F.try_divide(F.count_if(d > t), F.count(d)), 6).alias(f"distc{t}") for t in thresholds])
    got = sums.select(*by, F.col("n"), F.round(1 - F.col("f1") / F.col("n"), 6).alias("goods"), F.round(chao, 6).alias("chao1"), F.round(F.col("s") / chao, 6).alias("obs_chao1"))
    return got.join(near, by)


def rarefaction_cutoff(rows: DataFrame, group: str, q: float = 0.1, least: int = 50) -> DataFrame:
    """(cutoff): the q-quantile of the group sizes, at least `least`."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.floor(F.greatest(F.lit(float(least)), F.percentile("n", q))).cast("long").alias("cutoff"))


def rarefied(rows: DataFrame, id_col: str, group: str, lineage: str, distance: str, n_star: int, replicates: int, seed: int, thresholds: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """(group, n_available, auc, goods, obs_chao1 and a distc for each threshold with mean, lo and hi): statistics of n_star rows of each group,
    drawn without replacement in each replicate; groups with fewer rows are left out."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_available")).where(F.col("n_available") >= n_star)
    kept = rows.join(F.broadcast(sizes), group)  # one row a group
    drawn = draw_without_replacement(kept, id_col, group, n_star, replicates, seed)
    by = [group, "replicate"]
    stats = coverage(drawn, by, lineage, distance, list(thresholds)).join(ecdf_auc(ecdf(drawn, by, distance, 50, keep_unknown=False), by), by, "left")
    named = [("auc", "auc"), ("goods", "goods"), ("obs_chao1", "obs_chao1"), *((f"distc{t}", f"distc{t}") for t in thresholds)]
    aggs = [a for n, c in named for a in (F.round(F.avg(c) + HAIR, 4).alias(f"{n}_mean"), F.round(F.percentile(c, 0.025) + HAIR, 4).alias(f"{n}_lo"), F.round(F.percentile(c, 0.975) + HAIR, 4).alias(f"{n}_hi"))]
    return stats.groupBy(group).agg(*aggs).join(sizes, group)


def rarefied_band(rows: DataFrame, id_col: str, group: str, distance: str, n_star: int, replicates: int, seed: int, max_d: int = 50) -> DataFrame:
    """(group, x, y_mean, y_lo, y_hi): the distance curves of n_star rows of each group, over the replicates; groups
    with fewer rows are left out, unknown distances do not count."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= n_star).select(group)
    drawn = draw_without_replacement(rows.join(F.broadcast(sizes), group, "left_semi"), id_col, group, n_star, replicates, seed)  # one row a group
    curves = ecdf(drawn, [group, "replicate"], distance, max_d, keep_unknown=False)
    return curves.groupBy(group, "x").agg(F.round(F.avg("y") + HAIR, 6).alias("y_mean"), F.round(F.percentile("y", 0.025) + HAIR, 6).alias("y_lo"), F.round(F.percentile("y", 0.975) + HAIR, 6).alias("y_hi"))


def quadrants(points: DataFrame, name: str, x: str, y: str, size: str, smallest: float = 40.0, largest: float = 400.0, power: float = 0.5) -> DataFrame:
    """(name, x, y, marker, high_x, high_y): is a point at or above the 75th percentile of x and y, and its size scaled by
    a power between smallest and largest (the middle where all are equal). One row a group, so the table is small."""
    s = F.pow(F.col(size).cast("double"), F.lit(power))
    limits = points.agg(F.percentile(x, 0.75).alias("__qx"), F.percentile(y, 0.75).alias("__qy"), F.min(s).alias("__lo"), F.max(s).alias("__hi"))
    marker = F.when(F.col("__hi") > F.col("__lo"), smallest + (s - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (largest - smallest)).otherwise((smallest + largest) / 2)
    return points.crossJoin(F.broadcast(limits)).select(name, x, y, F.round(marker, 6).alias("marker"), (F.col(x) >= F.col("__qx")).alias("high_x"), (F.col(y) >= F.col("__qy")).alias("high_y"))


def slope_band(points: DataFrame, id_col: str, x: str, y: str, replicates: int, seed: int) -> DataFrame:
    """(slope, intercept, slope_lo, slope_hi): least squares of y on x, and the 2.5 and 97.5 percentiles of the slope over
    resamples of the points; resamples of a single x have no slope and do not count."""
    whole = points.select(id_col, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__g", F.lit("all"))
    drawn = draw_with_replacement(whole, id_col, "__g", replicates, seed)
    slopes = drawn.groupBy("replicate").agg(F.regr_slope(y, x).alias("s"))
    band = slopes.agg(F.round(F.percentile("s", 0.025), 6).alias("slope_lo"), F.round(F.percentile("s", 0.975), 6).alias("slope_hi"))
    return whole.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept")).crossJoin(band)


def regression_band(points: DataFrame, id_col: str, x: str, y: str, replicates: int, seed: int, steps: int = 300) -> DataFrame:
    """(step, x, y, lo, hi): the least-squares line at equal steps over the range of x, and the 2.5 and 97.5 percentiles of
    the lines of resampled points; resamples of a single x have no line and do not count."""
    whole = points.select(id_col, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().withColumn("__g", F.lit("all"))
    line = whole.agg(F.min("x").alias("from"), F.max("x").alias("to"), F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"))
    grid = line.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    grid = grid.select("step", (F.col("from") + (F.col("to") - F.col("from")) * F.col("step") / (steps - 1)).alias("x"), "s", "i")
    lines = draw_with_replacement(whole, id_col, "__g", replicates, seed).groupBy("replicate").agg(F.regr_slope("y", "x").alias("rs"), F.regr_intercept("y", "x").alias("ri")).where("rs is not null")
    at = lines.crossJoin(F.broadcast(grid)).withColumn("v", F.col("ri") + F.col("rs") * F.col("x"))  # a row a step
    return at.groupBy("step", "x", "s", "i").agg(F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi")).select("step", F.round("x", 6).alias("x"), F.round(F.col("i") + F.col("s") * F.col("x"), 6).alias("y"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def huber_line(points: DataFrame, x: str, y: str, width: float = 1.345, rounds: int = 30) -> tuple[float, float]:
    """(slope, intercept) of y on x that bounds the influence of outliers: weights of residuals beyond `width` scales fall
    as 1 / residual, the scale is the median absolute residual / 0.6745. A round is two Spark aggregates; fewer than two
    different x raise ValueError."""
    data = cut(points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna())
    slope, intercept = data.agg(F.regr_slope("y", "x"), F.regr_intercept("y", "x")).first()
    if slope is None:
        raise ValueError("a line needs two different x")
    for _ in range(rounds):
        r = F.abs(F.col("y") - intercept - slope * F.col("x"))
        scale = data.agg(F.median(r)).first()[0] / 0.6745
        w = F.when(r <= max(width * scale, 1e-12), 1.0).otherwise(width * scale / r)
        s, sx, sy, sxx, sxy = data.agg(F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("y")), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x") * F.col("y"))).first()
        before, slope = slope, (s * sxy - sx * sy) / (s * sxx - sx * sx)
        intercept = (sy - slope * sx) / s
        if abs(slope - before) < 1e-10:
            break
    return slope, intercept
