"""Values mapped to a reference list: repairs, order, codes, none, and the edge cases of the docstring."""

import random

import pytest
from pyspark.sql import functions as F

from strainloom.llm.canonical import _edits, map_to_reference, unmatched_values

TERMS = [
    (1, "place", "USA: Alabama", ["USA:AL", "Alabama"]), (2, "place", "USA: Indiana", ["USA:IN", "Indiana"]), (3, "place", "USA", ["United States", "United States of America"]), (4, "place", "USA: Virginia", ["USA:VA", "Virginia"]),
    (5, "place", "USA: West Virginia", ["USA:WV", "West Virginia"]), (6, "place", "Mexico", None), (7, "place", "USA: New Mexico", ["USA:NM", "New Mexico"]), (8, "place", "USA: Ohio", ["USA:OH", "Ohio"]),
    (20, "what", "stool specimen", None), (21, "what", "whole broiler carcass", None), (22, "what", "cantaloupe rind", None), (23, "what", "fishery_uplands", None),
]
CASES = [
    ("place", "usa:in", 2), ("place", "collected in USA", 3), ("place", "U.S.A. - Virginia", 4), ("place", "west virgnia", 5), ("place", "United States: Ohio (inferred)", 8), ("place", "united states: Virgina", 4), ("place", "United States", 3), ("place", "Virginia", 4), ("place", "Mexico", None), ("place", "mexcio?", 6), ("place", "US, state of New Mexico", 7),
    ("place", "Lunar base 4", -1), ("place", "N/A", -1), ("place", "", -1), ("place", " - ", -1), ("place", None, None),
    ("what", "specimen, stool", 20), ("what", "STOOL  SPECIMENS #4", 20), ("what", "whole br0iler ca", 21), ("what", "carcass, whole brolier", 21), ("what", "cantaloupe r", 22), ("what", "fisheryuplands_v2", 23), ("what", "wooden idol", -1),
    ("what", "x" * 200_000, -1),
]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(TERMS, "ref_id long, field_name string, term string, alt_names array<string>")


def test_cases(spark, reference):
    rows = spark.createDataFrame([(i, *(v if f == x else None for x in ("place", "what")), "extra") for i, (f, v, _) in enumerate(CASES)], "row_id long, place string, what string, norm string")
    got = {r.row_id: r.ref_id for r in map_to_reference(rows, reference, "row_id", ["place", "what"]).collect()}
    for i, (_, value, want) in enumerate(CASES):
        assert got.get(i) == want, value


def test_hot_value_and_repeats(spark, reference):
    rows = spark.range(3000).selectExpr("id as row_id", "if(id % 3 = 0, 'ohoi', concat('junk', id)) as place").unionAll(spark.sql("select 0L, 'ohoi'"))
    got = map_to_reference(rows, reference, "row_id", ["place"])
    assert got.count() == 3001 and got.where("ref_id = 8").count() == 1001 and got.where("ref_id = -1").count() == 2000


def test_long_token_that_reads_short(spark, reference):
    """Every rn may be an m, so a token may be much longer than the names it means."""
    terms = spark.createDataFrame([(50, "what", "mammmmamma", None)], reference.schema)
    rows = spark.createDataFrame([(1, "rnarnrnrnrnarnrna")], "row_id long, what string")
    assert [r.ref_id for r in map_to_reference(rows, terms, "row_id", ["what"]).collect()] == [50]


def test_edits_count_swaps(spark):
    def osa(x, y):
        d = {(i, j): max(i, j) for i in range(len(x) + 1) for j in range(len(y) + 1) if not i or not j}
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(x), len(y)]

    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    pairs = [(words[i], words[i + 1]) for i in range(0, 500, 2)] + [("abcdef", "badcef"), ("abcdef", "abdcf"), ("ab", "ba"), ("a", "b"), ("abcd", "badc")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("d", F.levenshtein("a", "b"))
    for r in df.withColumn("e", _edits(F.col("a"), F.col("b"), F.col("d"))).collect():
        want = osa(r.a, r.b)
        # a letter put between two swapped ones counts as two edits, as in the unrestricted distance
        assert r.e == want or (want > 2 and 2 <= r.e <= r.d), (r, want)


def test_empty_tables(spark, reference):
    rows = spark.createDataFrame([(1, "Ohi")], "row_id long, place string")
    assert map_to_reference(rows.where("false"), reference, "row_id", ["place"]).count() == 0
    assert [r.ref_id for r in map_to_reference(rows, reference.where("false"), "row_id", ["place"]).collect()] == [-1]
    assert [tuple(r) for r in unmatched_values(rows.unionAll(spark.sql("select 2L, 'zz zz'")), reference, "row_id", ["place"]).where("value = 'zz zz'").collect()] == [("place", "zz zz", 1)]
