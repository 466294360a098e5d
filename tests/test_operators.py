"""Operators without SQL, and the edge cases of those with it, against values worked out by hand or by brute force."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainloom.functions.cells import Cells, least_distance
from strainloom.functions import portable
from strainloom.functions.portable import draw_with_replacement, numbered
from strainloom.functions.profiles import distances, pack
from strainloom.operators import association as A
from strainloom.operators import centrality as Z
from strainloom.operators import curation as U
from strainloom.operators import diversity as D
from strainloom.operators import graph as G
from strainloom.operators import inference as I
from strainloom.operators import knn as K
from strainloom.plans.stability import nested_roles, nested_support
from strainloom.queries import attribution as Q

TABLE = "a long, b long, c long, d long"


def test_places_are_counted_in_parts(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000 - 300, "g" if i % 3 else "hot", "extra") for i in range(1000)], "id long, g string, place string").drop("place")
    for order in ("id", "key"):
        df = rows.withColumn("key", F.md5(F.col("id").cast("string")))
        got = numbered(df, order, ["g"], "place").collect()
        for g in ("g", "hot"):
            mine = sorted((r for r in got if r.g == g), key=lambda r: r[order])
            assert [r.place for r in mine] == list(range(len(mine)))
    assert sorted(r.p for r in numbered(rows, "id", [], "p").collect()) == list(range(1000))
    assert numbered(rows.where("false"), "id", ["g"], "p").count() == 0


def test_draw_sizes(spark):
    rows = spark.createDataFrame([(i, "a" if i < 30 else "b") for i in range(40)] + [(99, None)], "row_id long, node string")
    size = lambda s: {(r.node, r.replicate): r["count"] for r in draw_with_replacement(rows, "row_id", "node", 2, 5, s).groupBy("node", "replicate").count().collect()}
    assert set(size(None).values()) == {30, 10} and set(size("least").values()) == {10} and set(size(7).values()) == {7}
    assert portable.draw_with_replacement(rows.where("false"), "row_id", "node", 2, 5).count() == 0


@pytest.mark.parametrize("size", ["least", 5000])
def test_draws_are_not_broadcast(spark, size):
    """Draws of an asked number come from an exploded table, whose size Spark takes for that of its few groups."""
    rows = spark.range(40).selectExpr("id as row_id", "if(id < 30, 'a', 'b') as node")
    plan = draw_with_replacement(rows, "row_id", "node", 1000, 1, size)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("SortMergeJoin [node") < plan.index("Generate explode") and "BroadcastHashJoin" not in plan[: plan.index("Generate explode")]


def test_permutation_keeps_strata(spark):
    rows = spark.createDataFrame([(i, i % 2 == 0, "s" if i % 5 else "t") for i in range(60)], "id long, label boolean, s string")
    got = A.permuted_within(rows, "id", "label", ["s"], 4, 1).join(rows.select("id", "s"), "id")
    want = {(s, label): n for s, label, n in (tuple(r) for r in rows.groupBy("s", "label").count().collect())}
    for r in got.groupBy("replicate", "s", "label").count().collect():
        assert r["count"] == want[r.s, r.label]
    assert got.count() == 240 and got.exceptAll(got.where("label = (id % 2 = 0)")).count() > 0


def test_crude_tests(spark):
    got = A.crude_tests(spark.createDataFrame([(3, 1, 2, 4), (0, 5, 0, 5)], TABLE)).collect()
    # all tables with rows 4, 6 and columns 5, 5: hypergeometric 5/210, 50/210, 100/210, 50/210, 5/210
    assert got[0].fisher_two_sided == pytest.approx(110 / 210) and got[0].fisher_greater == pytest.approx(55 / 210)
    assert got[0].chi2 == pytest.approx(10 * (3 * 4 - 1 * 2) ** 2 / (4 * 6 * 5 * 5)) and got[0].expected_a == 2.0
    assert got[0].chi2_p == pytest.approx(math.erfc(math.sqrt(got[0].chi2 / 2)))
    assert got[1].fisher_two_sided == 1.0 and got[1].fisher_or is None
    assert A.crude_tests(spark.createDataFrame([], TABLE)).count() == 0


def test_pooled_interval(spark):
    one = A.mantel_haenszel(spark.createDataFrame([(10, 20, 30, 40)], TABLE)).first()
    se = math.sqrt(1 / 10 + 1 / 20 + 1 / 30 + 1 / 40)  # of one stratum the variance is that of its log odds ratio
    assert one.pooled_or == pytest.approx(2 / 3, abs=1e-6) and one.ci_low == pytest.approx(2 / 3 * math.exp(-1.959964 * se), abs=1e-5)
    zero = A.mantel_haenszel(spark.createDataFrame([(0, 2, 3, 4)], TABLE)).first()
    assert zero.pooled_or == pytest.approx(0.5 * 4.5 / (2.5 * 3.5), abs=1e-6)


def test_top_flag_and_enrichment(spark):
    rows = spark.createDataFrame([(i, float(i % 10), i % 2 == 0, "x") for i in range(40)], "cluster long, m double, eco boolean, human_top string").drop("human_top")
    got = A.top_flagged(rows, "m", "human_top").where("human_top").select("cluster").collect()
    assert sorted(r.cluster for r in got) == [9, 19, 29, 39]
    stats = A.enrichment_stats(A.top_flagged(rows, "m", "human_top"), [], "eco", "human_top", "m").first()
    assert (stats.n_eco, stats.n_top, stats.eco_in_top, stats.share_of_top) == (20, 4, 0, 0.0) and stats.mean_difference == -1.0
    assert stats.odds_ratio == pytest.approx(0.5 * 16.5 / (20.5 * 4.5), abs=1e-6)
    null = spark.createDataFrame([(0.0,), (2.0,), (4.0,)], "s double")
    p = A.permutation_p(spark.createDataFrame([(4.0,)], "s double"), null, ["s"]).first()
    assert (p.p_greater, p.p_less, p.p_two_sided, p.perm_mean) == (0.5, 1.0, 0.75, 2.0)


def test_z_from_p(spark):
    got = [r.z for r in spark.createDataFrame([(0.5, 99), (0.025, 10_000), (0.0, 99), (None, 9)], "p double, n long").select(A.z_from_upper_p("p", "n").alias("z")).collect()]
    assert got[0] == pytest.approx(0) and got[1] == pytest.approx(1.959964, abs=1e-5) and got[2] == pytest.approx(2.326348, abs=1e-5) and got[3] is None


def test_negative_binomial_fit(spark):
    """The fit is the maximum of the likelihood, and near the values the rows were drawn with."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=800)
    mu = np.exp(1.0 + 0.5 * x)
    y = rng.negative_binomial(1 / 0.7, 1 / (1 + 0.7 * mu))
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x)], "y long, x double")
    fit, alpha = I.fit_negative_binomial(rows, "y", ["x"])
    assert fit["intercept"] == pytest.approx(1.0, abs=0.12) and fit["x"] == pytest.approx(0.5, abs=0.12) and alpha == pytest.approx(0.7, abs=0.15)

    def likelihood(b0, b1, a):
        m, r = np.exp(b0 + b1 * x), 1 / a
        return sum(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) for k in y.tolist()) + (r * np.log(r / (r + m)) + y * np.log(m / (r + m))).sum()

    best = likelihood(fit["intercept"], fit["x"], alpha)
    for d in ((0.01, 0, 0), (-0.01, 0, 0), (0, 0.01, 0), (0, -0.01, 0), (0, 0, 0.02), (0, 0, -0.02)):
        assert likelihood(fit["intercept"] + d[0], fit["x"] + d[1], alpha + d[2]) < best
    flat = spark.createDataFrame([(5, float(i % 3)) for i in range(60)], "y long, x double")
    assert I.fit_negative_binomial(flat, "y", ["x"])[1] == 0.0
    with pytest.raises(ValueError):
        I.fit_negative_binomial(rows.where("false"), "y", ["x"])


def test_roles_and_retention(spark):
    edges = spark.createDataFrame([(0, "a", "b", 1.0), (0, "b", "c", 1.0), (1, "a", "b", 1.0)], "replicate int, u string, v string, weight double")
    labelled = Z.roles(Z.replicate_metrics(edges, ["a", "b", "c", "d"]), ["replicate"])
    roles = {(r.replicate, r.node): r.role for r in labelled.collect()}
    assert roles[0, "b"] == "global connector" and roles[0, "d"] == roles[1, "c"] == "not retained" and roles[0, "a"] == "peripheral"
    whole = Z.all_roles(labelled, 4, spark.createDataFrame([(n,) for n in "abcd"], "node string"))
    assert whole.count() == 16 and Z.incomplete_replicates(whole, 4, 4).count() == 0 and Z.incomplete_replicates(labelled, 4, 4).count() == 2
    sums = Z.role_frequencies(whole).groupBy("node").agg(F.sum("percent").alias("s")).collect()
    assert all(r.s == pytest.approx(100) for r in sums)
    base = spark.createDataFrame([("b", "global connector"), ("d", "peripheral")], "node string, role string")
    got = {r.node: (r.recovery_percent, r.retention_percent) for r in Z.role_recovery(whole, base).collect()}
    assert got["d"] == (0.0, 0.0) and got["b"][1] == 50.0
    odd = labelled.drop("role").withColumn("eigenvector", F.lit(float("nan")))
    with pytest.raises(Exception, match="not finite"):
        Z.roles(odd, ["replicate"]).collect()
    ranks = {r.node: r.percentile for r in Z.percentile_ranks(Z.replicate_metrics(edges, None)).where("replicate = 0 and metric = 'degree'").collect()}
    assert ranks == {"a": 50.0, "b": 100.0, "c": 50.0}


def test_plain_and_unweighted_metrics(spark):
    edges = spark.createDataFrame([(0, "a", "b", 0.5), (0, "b", "c", 0.25)], "replicate int, u string, v string, weight double")
    plain = {r.node: (r.degree, r.strength) for r in Z.replicate_metrics(edges, None, normalised=False).collect()}
    assert plain["b"] == (2.0, 0.75)
    assert {r.node: r.strength for r in Z.replicate_metrics(edges, None, weighted=False).collect()} == {"a": 0.5, "b": 1.0, "c": 0.5}


def test_community_importance(spark):
    """Three communities in a row: the middle one lies between the others."""
    edges = spark.createDataFrame([("a1", "a2", 1.0), ("a2", "b1", 0.5), ("b1", "b2", 0.5), ("b2", "c1", 0.5)], "u string, v string, weight double")
    part = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("b2", "B"), ("c1", "C")], "node string, community string")
    got = {r.community: r for r in G.community_importance(edges, part).collect()}
    assert [got[c].betweenness for c in "ABC"] == [0.0, 1.0, 0.0] and got["A"].density == 1.0 and got["B"].external == 1.0
    # size 2/2, density .5/1, external 1/1, betweenness 1/1
    assert got["B"].importance == pytest.approx(0.4 + 0.2 * 0.5 + 0.2 + 0.2) and got["C"].importance == pytest.approx(0.4 * 0.5 + 0.2 * 0.5)
    assert {c: r.role for c, r in got.items()} == {"A": "core", "B": "hub", "C": "bridge"}


def test_triangle_rules(spark):
    rows = [(n, c, k) for n, cs in (("a", range(12)), ("b", range(4)), ("c", range(3, 7))) for c in cs for k in (3,)]
    counts = spark.createDataFrame(rows, "node string, cluster int, n long")
    tri = spark.createDataFrame([("a", "b", "c")], "a string, b string, c string")
    got = {r.source: r for r in G.residual_triangles(counts, tri).collect()}
    assert got["a"].passes_size and got["a"].source_rank == 1 and not got["b"].passes_size and got["b"].source_rank == got["c"].source_rank == 2
    assert got["b"].required_delta == pytest.approx(max(0.15, got["b"].original - 0.3))
    few = {r.source: r.supported for r in G.residual_triangles(counts, tri, require_size=True, richness_top_n=0).collect()}
    assert not any(few.values())


def test_removal_and_communities(spark):
    part = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", "z"), ("f", "z")], "node string, community string")
    assert {tuple(r) for r in G.without_singletons(part).collect()} == {("a", 0), ("b", 0), ("d", 1), ("e", 1), ("f", 1)}
    assert [r.community for r in G.sorted_communities(part).collect()] == ["z", "x", "y"]
    edges = spark.createDataFrame([("a", "b", 1.0), ("d", "e", 1.0)], "u string, v string, weight double")
    got = {r.stage: r for r in G.removal_stats(part.select("node"), edges, part, G.without_isolated(part.select("node"), edges)).collect()}
    assert (got["before"].n_nodes, got["after"].n_nodes, got["after"].n_edges, got["after"].n_communities) == (6, 4, 2, 2) and got["after"].modularity == 0.5


def test_nested_draws(spark):
    rows = [(n, c, 50) for n in ("a", "b") for c in range(4)] + [("c", 9, 40), ("c", 3, 1)]
    counts = spark.createDataFrame(rows, "node string, cluster int, n long")
    support = {(r.replicate, r.u, r.v): r.weight for r in nested_support(counts, 3, 5).collect()}
    assert {k for k in support} == {(i, "a", "b") for i in range(3)} and set(support.values()) == {1.0}
    roles = nested_roles(counts, 3, 5)
    assert roles.count() == 9 and roles.where("node = 'c' and role = 'not retained'").count() == 3
    with pytest.raises(ValueError):
        I.multinomial(counts, [], 0)


def test_terms_and_classes(spark):
    terms = spark.createDataFrame([("broiler_plains",), ("patient_plains",), ("patient_lakeshore",)], "term string")
    cases = {"Plains, broiler": "broiler_plains", "node patientplains - checked": "patient_plains", "patient_lakesho": "patient_lakeshore", "pateint_plains v2": "patient_plains", "N/A": None, "": None, "zeppelin_hangar": None}
    rows = spark.createDataFrame([(k,) for k in [*cases, "N/A", None]], "region string")
    got = {r.value: r.term for r in U.map_terms(rows, "region", terms, ["node", "checked"]).collect()}
    assert got == cases
    joined = U.with_terms(rows, "region", terms, ["node", "checked"], "node")
    assert joined.count() == len(cases) + 2 and joined.where("node is not null").count() == 4
    assert U.map_terms(rows.where("false"), "region", terms, ["x"]).count() == 0
    assert [r.term for r in U.map_terms(rows.limit(1), "region", terms.where("false"), ["x"]).collect()] == [None]
    texts = spark.createDataFrame([("SWINE / PIKE HOLLOW 10599",), ("Elm Ford-10739; Poultry",), ("Mill 104 (Poultry)",), ("swinery",), (None,)], "s string")
    assert [r.c for r in texts.select(U.class_in(F.col("s"), ["swine", "poultry"]).alias("c")).collect()] == ["swine", "poultry", "poultry", None, None]


def test_renamed_and_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [r.y for r in df.select(U.renamed(F.col("x"), {"a": "A"}).alias("y")).collect()] == ["A", "b", None]
    assert [r.x for r in U.missing_from(df, spark.createDataFrame([("b",)], "x string"), "x").collect()] == ["a"]


def test_votes(spark):
    near = spark.createDataFrame([(1, 10, "x", 0.1, 1), (1, 11, "y", 0.2, 2), (1, 12, "x", 0.3, 3)], "query_id long, train_id long, label string, distance double, rank int")
    weights = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 1.0)], "label string, weight double")
    soft = lambda v: {k: math.exp(e) / sum(map(math.exp, v.values())) for k, e in v.items()}
    got = lambda **kw: {r.label: r.proba for r in K.probabilities(near, weights, **kw).collect()}
    for kw, want in (({"voting": "uniform"}, {"x": 2, "y": 2, "z": 0}), ({"voting": "inverse"}, {"x": 20 + 2 / 0.3, "y": 20, "z": 0}), ({"voting": "uniform", "method": "softmin"}, {"x": -2 / 3, "y": -1 / 6, "z": 0})):
        assert got(**kw) == pytest.approx(soft(want), abs=1e-5)
    with pytest.raises(ValueError):
        got(voting="loud")
    wide = K.named_probabilities(K.probabilities(near, weights), ["x", "y", "z", "none"]).first()
    assert wide.p_none is None and wide.p_x + wide.p_y + wide.p_z == pytest.approx(1, abs=1e-5)


def test_normal_trust(spark):
    per = spark.createDataFrame([(q, i, c, d, i) for q, (dx, dy) in {1: (0.1, 0.3), 2: (0.2, 0.2), 3: (0.1, 0.2)}.items() for c, d in (("x", dx), ("y", dy)) for i in (1, 2)], "query_id long, train_id long, label string, distance double, rank int")
    own = spark.createDataFrame([(q, "x") for q in (1, 2, 3)], "query_id long, label string")
    stats = K.ratio_statistics(per, own).first()
    assert (stats.n, stats.mean_ratio) == (3, pytest.approx(2, abs=1e-4)) and stats.sd_ratio == pytest.approx(math.sqrt(2 / 3), abs=1e-4) and stats.skewness == pytest.approx(0, abs=1e-3)
    trust = {r.query_id: r.trust for r in K.trust(per, own.withColumnRenamed("label", "prediction"), mean=True, statistics=K.ratio_statistics(per, own)).collect()}
    z = 2 * (1 / math.sqrt(2 / 3))
    assert trust[1] == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=1e-3) and trust[3] == pytest.approx(0.5, abs=1e-3) and trust[2] == pytest.approx(1 - trust[1], abs=1e-3)


def test_cross_validation_is_that_of_brute_force(spark):
    rng = np.random.default_rng(7)
    centre = {"x": rng.integers(1, 9, 30), "y": rng.integers(1, 9, 30)}
    data = []
    for i in range(60):
        label = "xy"[i % 2]
        row = np.where(rng.random(30) < 0.5, centre[label], rng.integers(1, 9, 30))
        data.append((i, row.tolist(), label))
    df = spark.createDataFrame(data, "id long, alleles array<short>, label string")
    got = {r.id: (r.fold, r.prediction) for r in K.cross_validated(df, 3, 4, 5).collect()}
    n = {"x": 30, "y": 30}
    for i, row, _ in data:
        others = sorted((sum(a != b for a, b in zip(row, r)) / 30, j, lab) for j, r, lab in data if got[j][0] != got[i][0])[:3]
        votes = dict.fromkeys("xy", 0.0)
        for k, (d, _, lab) in enumerate(others):
            d, d1, dk = (max(v, 5e-5) for v in (d, others[0][0], others[-1][0]))
            votes[lab] += 1.0 if k == 0 else (dk - d) / (dk - d1 + 5e-5)
        best = max("xy", key=lambda c: (round(votes[c] * (n[c] / 31) ** (-1 / 2.5), 6), c == "x"))
        assert got[i][1] == best


def test_lines(spark):
    points = spark.createDataFrame([(i, float(i), 2.0 * i + 1 + (60 if i == 9 else 0)) for i in range(12)], "id long, x double, y double")
    slope, intercept = D.huber_line(points, "x", "y")
    assert slope == pytest.approx(2, abs=0.05) and intercept == pytest.approx(1, abs=0.3)
    band = D.regression_band(points.where("id <> 9"), "id", "x", "y", 20, 1, steps=5).orderBy("step").collect()
    assert [r.x for r in band] == [0, 2.75, 5.5, 8.25, 11] and all(r.lo == r.hi == r.y == pytest.approx(2 * r.x + 1) for r in band)
    with pytest.raises(ValueError):
        D.huber_line(points.where("id = 1"), "x", "y")


def test_back_map(spark):
    rows = spark.createDataFrame([(1, "k1", "Not Known", "USA: Ohio"), (2, "k1", "Milk", "USA"), (3, "k2", None, "USA")], "row_id long, key string, text string, place string")
    assert [r.t for r in rows.select(U.normal_text(F.col("text"), ["not known"]).alias("t")).collect()] == [None, "milk", None]
    got = U.back_mapped(rows, "key", spark.createDataFrame([("k1", "a|b", "others/missing")], "key string, labels string, curated string"))
    assert {r.row_id: r.curated for r in got.collect()} == {1: "others/missing", 2: "others/missing", 3: None}
    assert tuple(U.curated_counts(got).first()) == (3, 2, 2)
    assert U.validate_keys(rows, "key", F.col("place").contains("USA")).count() == 3
    for bad in ((4, None, "x", "USA"), (4, "k", "x", None)):
        with pytest.raises(ValueError):
            U.validate_keys(rows.unionByName(spark.createDataFrame([bad], rows.schema)), "key", F.col("place").contains("USA"))


def lineages(rows: int, loci: int, seed: int) -> np.ndarray:
    """Profiles of uneven lineages and of none, near copies, rows that are mostly or wholly missing."""
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 1400, (30, loci))[np.minimum(rng.zipf(1.5, rows) - 1, 29)]
    x = np.where(rng.random(x.shape) < rng.choice([0.02, 0.2, 0.35], (rows, 1)), rng.integers(1, 1400, x.shape), x)
    x[::17] = rng.integers(1, 40, (len(x[::17]), loci))
    x[1::19] = x[0]
    x[rng.random(x.shape) < rng.choice([0.01, 0.1, 0.95], (rows, 1), p=[0.6, 0.37, 0.03])] = 0
    x[5::97] = -1
    return x.astype(np.int16)


@pytest.mark.parametrize("block", [(10_000, 40_000), (50, 200)])
def test_search_by_cells_is_exact(spark, monkeypatch, block):
    """Cell by cell the same neighbours come as from all pairs, ties by the smaller id, also with rows held apart, and the
    same trust."""
    x = lineages(2000, 40, 3)
    df = spark.createDataFrame([(i, r.tolist(), "abc"[i * 7 % 11 % 3], i % 4) for i, r in enumerate(x)], "id long, alleles array<short>, label string, fold int")
    q, t = df.where("id % 5 = 0"), df.where("id % 5 <> 0 or id % 50 = 0")
    named = q.select(F.col("id").alias("query_id"), F.lit("b").alias("prediction"))

    def got():
        trust = K.trust(K.nearest_of_labels(q, t, named, 3), named)
        return [sorted(map(tuple, d.collect())) for d in (K.nearest(q, t, 5), K.nearest(df, df, 3, apart="fold"), trust)]

    want = got()
    for name, v in (("DIRECT", 0), ("SAMPLE", 900), ("CELL_BLOCK", block)):
        monkeypatch.setattr(K, name, v)
    assert got() == want
    known = np.maximum(x, 0)
    for i in range(0, 2000, 250):
        d = distances(np.broadcast_to(known[i], known.shape), known)
        ids = [j for j in np.argsort(d, kind="stable") if j % 5 or j % 50 == 0][:5]
        assert [r[1] for r in want[0] if r[0] == i] == sorted(ids) or [r[1] for r in sorted(want[0], key=lambda r: (r[0], r[4])) if r[0] == i] == ids


def test_cells_leave_few_pairs():
    """No row of a cell is nearer than the bound says, and most queries need less than a tenth of all rows."""
    rng = np.random.default_rng(5)
    x = rng.integers(1, 1400, (200, 240))[rng.integers(0, 200, 12_000)]
    x = np.where(rng.random(x.shape) < 0.2, rng.integers(1, 1400, x.shape), x)
    x[rng.random(x.shape) < 0.03] = 0
    y, x = x[:300].astype(np.int16), x[300:].astype(np.int16)
    cells = Cells(240)
    cells.fit(x[:4000])
    cell, differ, apart = cells.place(x)
    most = np.zeros((2, len(cells.centres)), np.int64)
    inside = cell >= 0
    np.maximum.at(most[0], cell[inside], differ[inside]), np.maximum.at(most[1], cell[inside], apart[inside])
    same = np.stack([((cells.centres == r) & (r > 0)).sum(1) for r in y])
    least, d = least_distance((y > 0).sum(1), same, *most), K.block_distances(y, x)
    assert (d[:, inside] >= least[:, cell[inside]] - 1e-6).all()
    fifth = np.sort(d, axis=1)[:, 4]
    needed = (~inside[None, :] | (least[:, cell] <= fifth[:, None])).mean(1)
    assert np.median(needed) < 0.1 and inside.mean() > 0.9


def test_cells_hold_small_families_and_sparse_rows(spark, monkeypatch):
    """Families with a few rows in a sample get cells, and rows of which half the loci differ or are unknown lie in them."""
    rng = np.random.default_rng(7)
    x = rng.integers(1, 1400, (150, 60))[np.arange(3000) % 150]
    x = np.where(rng.random(x.shape) < 0.15, rng.integers(1, 1400, x.shape), x)
    x[np.arange(0, 3000, 10)[:, None], rng.integers(0, 60, (300, 30))] = 0
    t = spark.createDataFrame([(i, bytes(b)) for i, b in enumerate(pack(x.astype(np.int16)).to_pylist())], "i long, x binary")
    monkeypatch.setattr(K, "SAMPLE", 300)
    cells = K._fitted(t, 3000, 60)
    assert (cells.place(x.astype(np.int16))[0] >= 0).mean() > 0.9


def test_rows_without_known_loci_meet_few():
    """They are at distance 1 from all rows, so take the first ones, held apart or not, and none under a limit below 1."""
    x = np.random.default_rng(1).integers(0, 9, (20_000, 30)).astype(np.int16)
    y = np.concatenate([np.zeros((400, 30), np.int16), x[:3]])
    began = time.process_time()
    rows, cols, d = K.k_nearest(y, x, 2)
    assert time.process_time() - began < 1 and (cols[:800].reshape(-1, 2) == [0, 1]).all() and (d[:800] == 1).all() and cols[800::2].tolist() == [0, 1, 2]
    sides = np.zeros(403, int), np.minimum(np.arange(20_000), 9) // 3
    assert (K.k_nearest(y, x, 2, sides)[1][:800].reshape(-1, 2) == [3, 4]).all()
    assert set(K.k_nearest(y, x, 2, limit=np.full(403, 0.5))[0].tolist()) == {400, 401, 402}


def test_rare_labels_count_whole(spark, monkeypatch):
    """A label of two rows, one near and one far, has the mean of both as its distance, cell by cell as among all pairs."""
    x = lineages(1500, 40, 11)
    x[:2] = x[20], np.arange(40) + 2000
    df = spark.createDataFrame([(i, r.tolist(), "z" if i < 2 else "ab"[i % 2]) for i, r in enumerate(x)], "id long, alleles array<short>, label string")
    q = df.where("id % 3 = 2")
    named = q.select(F.col("id").alias("query_id"), F.lit("a").alias("prediction"))

    def got():
        return sorted(map(tuple, K.trust(K.nearest_of_labels(q, df, named, 3), named).collect()))

    want = got()
    for name, v in (("DIRECT", 0), ("SAMPLE", 900)):
        monkeypatch.setattr(K, name, v)
    assert got() == want
    with pytest.raises(ValueError):
        K.nearest_of_labels(q, df, named, 2)


@pytest.mark.parametrize("block", [(10_000, 40_000), (50, 200)])
def test_trust_meets_few_pairs(spark, monkeypatch, block):
    """knn_trust of large tables goes cell by cell (only rare classes meet all queries) and equals that of all pairs, also
    where the rows inside a query's cells name another class than all rows do."""
    x = lineages(2400, 40, 13)
    df = spark.createDataFrame([(i, r.tolist(), "z" if i in (7, 52) else "abcde"[i * 13 % 29 % 5]) for i, r in enumerate(x)], "id long, alleles array<short>, label string")
    tables = {Q.TRAIN: df.where("id % 4 <> 1"), Q.TEST: df.where("id % 4 = 1 or id % 100 = 0")}
    monkeypatch.setattr(Q, "labelled", lambda s, d, table: tables[table])

    def got():
        return {r.query_id: r.trust for r in Q.knn_trust(spark, "").collect()}

    def others(found):
        return found.groupBy("query_id").agg(F.sum("train_id").alias("n")).select("query_id", F.element_at(F.array(*map(F.lit, "abcdez")), (F.col("n") % 6 + 1).cast("int")).alias("prediction"))

    def by_rows(found):
        per, near = K.nearest_and_labels(tables[Q.TEST], tables[Q.TRAIN], 5, 3, others)
        return sorted(map(tuple, near.collect())), sorted(map(tuple, K.trust(per, others(near)).collect()))

    want, want_rows = got(), by_rows(None)
    sizes, grid = [], K._grid

    def counted(queries, train, *args, **kw):
        sizes.append(train.count())
        return grid(queries, train, *args, **kw)

    for name, v in (("DIRECT", 0), ("SAMPLE", 900), ("CELL_BLOCK", block), ("_grid", counted)):
        monkeypatch.setattr(K, name, v)
    assert got() == want and len(want) == tables[Q.TEST].count()
    assert by_rows(None) == want_rows and sizes == [2, 2]
    with pytest.raises(ValueError):
        K.nearest_and_labels(tables[Q.TEST], tables[Q.TRAIN], 5, 2, others)


def test_first_of_each_label():
    """The nearest rows of all and the first ones of every label, as by all pairs, for queries with and without known loci."""
    x, label = lineages(3000, 40, 17), np.arange(3000) * 7 % 11 % 4
    y = np.concatenate([x[::40], np.zeros((2, 40), np.int16)])
    d = K.block_distances(np.maximum(y, 0), np.maximum(x, 0))
    want = set()
    for i in range(len(y)):
        order = np.argsort(d[i], kind="stable")
        want |= {(i, int(j)) for j in order[:5]} | {(i, int(j)) for v in range(4) for j in order[label[order] == v][:2]}
    for limit in (None, np.full(len(y), 1.0), np.full(len(y), 0.5)):
        r, c, got = K.k_nearest(y, x, 5, limit=limit, labels=label, each=2)
        assert set(zip(r.tolist(), c.tolist())) == {(i, j) for i, j in want if limit is None or d[i, j] <= limit[i]} and np.allclose(got, d[r, c])
    assert len(K.k_nearest(y, x[:0], 5, labels=label[:0], each=2)[0]) == 0
