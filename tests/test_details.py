"""Strata keep their labels, subclasses take nulls, bands and quadrants of few or equal points."""

from pyspark.sql import functions as F

from strainloom.operators.association import permuted_within, subclass
from strainloom.operators.diversity import quadrants, rarefied_band, slope_band


def test_permuted_within_keeps_margins(spark):
    rows = spark.range(200).selectExpr("id", "id % 7 as stratum", "id % 3 = 0 as marked")
    got = permuted_within(rows, "id", "marked", ["stratum"], 2, 1)
    assert got.count() == 400
    per = got.join(rows.select("id", "stratum"), "id").groupBy("replicate", "stratum").agg(F.count_if("marked").alias("n"))
    want = {r.stratum: r.n for r in rows.groupBy("stratum").agg(F.count_if("marked").alias("n")).collect()}
    assert all(r.n == want[r.stratum] for r in per.collect())
    assert permuted_within(rows.where("false"), "id", "marked", ["stratum"], 2, 1).count() == 0


def test_subclass(spark):
    rows = spark.createDataFrame([("feed", "Dog (dry)"), ("feed", None), ("feed", "soy"), ("swine", "dog"), (None, "dog")], "v string, t string")
    assert [r[0] for r in rows.select(subclass(F.col("v"), F.col("t"), "feed", ["dog", "a(b"], "pet", "other")).collect()] == ["pet", "other", "other", "swine", None]


def test_bands_and_quadrants(spark):
    points = spark.createDataFrame([("a", 1.0, 3.0, 4), ("b", 2.0, 5.0, 4)], "k string, x double, y double, n int")
    assert {r.marker for r in quadrants(points, "k", "x", "y", "n").collect()} == {220.0}
    line = slope_band(points, "k", "x", "y", 8, 3).first()
    assert (line.slope, line.intercept) == (2.0, 1.0) and line.slope_lo in (None, 2.0)
    assert slope_band(points.where("false"), "k", "x", "y", 8, 3).first().slope is None
    rows = spark.range(10).selectExpr("cast(id as string) as key", "if(id < 8, 'g', 'few') as s", "cast(if(id = 0, 'nan', '4') as double) as d")
    band = rarefied_band(rows, "key", "s", "d", 8, 2, 1, 5).collect()
    assert {r.s for r in band} == {"g"} and {(r.x, r.y_lo) for r in band} == {(x, float(x >= 4)) for x in range(6)}
