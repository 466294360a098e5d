"""Components against union-find, hubs, and splits by weight."""

import random

from strainloom.llm import splits
from strainloom.llm.splits import components, related_groups, split_by_weight


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    return {x: find(x) for x in list(parent)}


def same_partition(a, b):
    return a.keys() == b.keys() and len({(a[k], b[k]) for k in a}) == len(set(a.values())) == len(set(b.values()))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(400)] + [(7, 7), (9000, 9000)]
    df = spark.createDataFrame(edges + [edges[0], (None, 4)], "u long, v long")
    got = {r.vertex: r.label for r in components(df).collect()}
    assert same_partition(got, union_find(edges))


def test_hub_that_holds_half_of_the_edges(spark, monkeypatch):
    monkeypatch.setattr(splits, "HOT_ROWS", 50)
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 800)] + [(1000 + rng.randrange(600), 1000 + rng.randrange(600)) for _ in range(400)] + [(799, 1000)]
    got = {r.vertex: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert same_partition(got, union_find(edges))


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_related_groups(spark):
    records = spark.createDataFrame([(i, "x") for i in range(10)], "row_id long, key string")
    ties = spark.createDataFrame([(5, 1, "a"), (3, 1, "a"), (3, 2, "a"), (8, 2, "a"), (4, 1, None), (6, 1, "only")], "row_id long, kind int, key string")
    got = {r.row_id: r.group_id for r in related_groups(records, "row_id", ties).collect()}
    assert got == {i: 3 if i in (3, 5, 8) else i for i in range(10)}
    assert related_groups(records.where("false"), "row_id", ties.where("false")).count() == 0


def test_key_and_group_of_a_third_of_the_records(spark, monkeypatch):
    monkeypatch.setattr(splits, "HOT_ROWS", 40)
    records = spark.range(300).withColumnRenamed("id", "row_id")
    ties = records.selectExpr("row_id", "1 as kind", "if(row_id % 3 = 0, 'hot', concat('k', row_id div 6)) as key").unionByName(spark.createDataFrame([(0, 2, "x"), (7, 2, "x")], "row_id long, kind int, key string"))
    got = {r.row_id: r.group_id for r in related_groups(records, "row_id", ties).collect()}
    for i in range(300):
        block = [j for j in range(i // 6 * 6, i // 6 * 6 + 6) if j % 3]
        assert got[i] == (0 if i % 3 == 0 or 7 in block else min(block))


def test_shares(spark):
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("validation", 0.1)], "split_name string, target_share double")
    groups = spark.range(4000).selectExpr("id as group_id", "if(id = 0, 6000L, 1 + id % 5) as weight")
    got = split_by_weight(groups, targets)
    assert got.count() == 4000
    assert got.where("group_id = 0").first().split_name == "train"
    by = {r.split_name: r.w for r in got.join(groups, "group_id").groupBy("split_name").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "w").collect()}
    total = sum(by.values())
    assert abs(by["test"] / total - 0.1) < 0.01 and abs(by["train"] / total - 0.8) < 0.01
    assert split_by_weight(groups.where("false"), targets).count() == 0


def test_cuts_leave_no_gap(spark):
    """Shares that do not add up exactly in binary: every group has one split."""
    targets = spark.createDataFrame([(f"s{i}", 0.1) for i in range(10)], "split_name string, target_share double")
    got = split_by_weight(spark.range(3000).selectExpr("id as group_id", "1L as weight"), targets)
    assert got.count() == got.select("group_id").distinct().count() == 3000
