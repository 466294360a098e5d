"""Heavy keys: sketch, aggregate and join against plain Spark and the defined edge cases."""

from pyspark.sql import functions as F

from strainloom.operators import skew
from strainloom.operators.skew import sketch_heavy_keys, skew_aggregate, skew_join


def skewed(spark, n=20_000):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 701).cast("string"))).alias("k"), (F.col("id") % 13).alias("v"))


def test_sketch_finds_every_heavy_key(spark):
    df = skewed(spark)
    assert [r.k for r in sketch_heavy_keys(df, "k", 0.05).collect()] == ["hot"]
    both = sketch_heavy_keys(df.withColumn("g", F.col("id") % 2), "k", 0.05, ["g"]).collect()
    assert sorted((r.g, r.k) for r in both) == [(0, "hot"), (1, "hot")]


def test_aggregate_equals_plain_group_by(spark):
    df = skewed(spark).unionByName(spark.createDataFrame([(1, None, 5)], "id long, k string, v long"))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.countDistinct("v").alias("d")]
    got = skew_aggregate(df, ["k"], aggs, sketch_heavy_keys(df, "k", 0.05))
    assert {tuple(r) for r in got.drop("is_heavy").collect()} == {tuple(r) for r in df.where("k is not null").groupBy("k").agg(*aggs).collect()}
    assert [r.k for r in got.where("is_heavy").collect()] == ["hot"]


def test_join_equals_plain_join(spark):
    left = skewed(spark, 5000).unionByName(spark.createDataFrame([(-1, None, 5)], "id long, k string, v long"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k is null or k != 'k5'")
    for how in ("inner", "left"):
        a, b = skew_join(left, right, ["k"], how, 0.05), left.join(right, ["k"], how)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_join_of_too_many_hot_rows_is_salted(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 10)
    left = skewed(spark, 3000)
    right = spark.range(40).select(F.lit("hot").alias("k"), F.col("id").alias("w")).unionByName(spark.createDataFrame([("k5", 7)], "k string, w long"))
    for how in ("inner", "left"):
        a, b = skew_join(left, right, ["k"], how, 0.05), left.join(right, ["k"], how)
        assert "__salt" in a._jdf.queryExecution().toString()
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    named = skew_join(left, right, ["k"], "inner", heavy=["hot", "k7"])
    assert sorted(map(str, named.collect())) == sorted(map(str, left.join(right, ["k"]).collect()))


def test_empty_and_all_null(spark):
    df = skewed(spark).where("false")
    assert sketch_heavy_keys(df, "k", 0.1).count() == 0
    assert skew_aggregate(df, ["k"], [F.count(F.lit(1)).alias("n")], sketch_heavy_keys(df, "k", 0.1)).count() == 0
    nulls = spark.createDataFrame([(1, None, 5)], "id long, k string, v long")
    assert sketch_heavy_keys(nulls, "k", 0.1).count() == 0
    assert skew_join(nulls, nulls.select("k"), ["k"]).count() == 0
