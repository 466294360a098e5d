"""Kernels, models and trees against values worked out by hand."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strainloom.functions.profiles import distances, matrix, pack, unpack
from strainloom.functions.text import accession_key, outbreak_key, site_key
from strainloom.operators import association as A
from strainloom.operators import centrality as Z
from strainloom.operators import curation as U
from strainloom.operators import diversity as D
from strainloom.operators import inference as I
from strainloom.operators import knn as K


def path_graph():
    """a - b - c with weight 1, and d alone."""
    return pd.DataFrame({"u": ["a", "b"], "v": ["b", "c"], "weight": [1.0, 1.0]}), ["a", "b", "c", "d"]


def test_metrics_of_a_path():
    m = Z.metrics_of(*path_graph()).set_index("node")
    assert m.degree["b"] == pytest.approx(2 / 3) and m.strength["a"] == 0.5 and m.clustering.sum() == 0
    assert m.betweenness["b"] == pytest.approx(2 / 6) and m.betweenness["a"] == 0
    assert m.closeness["b"] == pytest.approx(2 / 2 * 2 / 3) and m.closeness["a"] == pytest.approx(2 / 3 * 2 / 3) and m.closeness["d"] == 0
    assert m.eigenvector["b"] / m.eigenvector["a"] == pytest.approx(2**0.5, abs=1e-4)


def test_communities_and_linkage():
    w = np.kron(np.eye(2), np.ones((4, 4)))
    np.fill_diagonal(w, 0)
    w[0, 4] = w[4, 0] = 0.1
    label = Z.communities(w)
    assert len(set(label[:4])) == len(set(label[4:])) == 1 and label[0] != label[4]
    assert (Z.communities(w) == label).all() and len(set(Z.communities(np.zeros((3, 3))))) == 3
    d = 1 - np.kron(np.eye(2), np.ones((2, 2)))
    assert list(Z.average_linkage(d, 0.5)) == [0, 0, 1, 1]


def test_rewired_keeps_degrees_and_weights():
    rng = np.random.default_rng(1)
    w = np.triu(rng.random((12, 12)) * (rng.random((12, 12)) < 0.4), 1)
    w = w + w.T
    r = I.rewired(w, 5)
    assert ((r > 0).sum(1) == (w > 0).sum(1)).all() and np.allclose(np.sort(r[r > 0]), np.sort(w[w > 0])) and (r == r.T).all()


def test_neighbour_joining_restores_distances():
    edges = {("a", "x"): 2, ("b", "x"): 3, ("x", "y"): 4, ("c", "y"): 5, ("d", "y"): 1}
    d = np.array([[0, 5, 11, 7], [5, 0, 12, 8], [11, 12, 0, 6], [7, 8, 6, 0]], float)
    tree = I.neighbour_joining(d, list("abcd"))
    assert sum(length for *_, length in tree) == pytest.approx(sum(edges.values()))


def test_poisson_fit_of_skewed_counts(spark):
    """Counts in proportion to a skewed size: a whole first step overshoots to exp(50)."""
    rows = spark.range(1, 2001).selectExpr("floor(4e6 / (id * id)) + 1 as y", "log1p(4e6 / (id * id)) as x")
    fit = {t: e for t, e, *_ in I.fit_glm(rows, "y", ["x"], "poisson")}
    assert fit["x"] == pytest.approx(1, abs=0.05) and fit["intercept"] == pytest.approx(0, abs=0.5)


def test_fisher_and_haenszel(spark):
    df = spark.createDataFrame([(3, 1, 2, 4), (0, 0, 5, 5)], "a long, b long, c long, d long")
    p = [r.p for r in df.select(A.fisher_greater("a", "b", "c", "d").alias("p")).collect()]
    assert p[0] == pytest.approx((60 + 6) / 252) and p[1] == 1.0
    got = A.mantel_haenszel(spark.createDataFrame([(3, 1, 2, 4)], "a long, b long, c long, d long")).first()
    assert got.pooled_or == pytest.approx(6.0)


def test_glm_of_a_two_by_two(spark):
    rows = spark.createDataFrame([(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4, "y int, x int")
    fit = {t: e for t, e, *_ in I.fit_glm(rows, "y", ["x"], "binomial")}
    assert fit["x"] == pytest.approx(np.log(6), abs=1e-6) and fit["intercept"] == pytest.approx(np.log(0.5), abs=1e-6)
    with pytest.raises(ValueError):
        I.fit_glm(rows.where("false"), "y", ["x"], "binomial")


def test_curves_and_coverage(spark):
    rows = spark.createDataFrame([("s", 1, 25.0), ("s", 1, 25.0), ("s", 1, float("nan")), ("s", 2, None), ("s", 3, 25.0), ("s", 4, 25.0), ("s", 4, 25.0)], "source string, lin long, d double")
    curve = D.ecdf(rows, ["source"], "d", keep_unknown=False)
    assert D.ecdf_auc(curve, ["source"]).first().auc == pytest.approx(0.51)
    assert D.ecdf(rows, ["source"], "d").where("x = 100").first().y == pytest.approx(5 / 7, abs=1e-6)
    got = D.coverage(rows, ["source"], "lin", "d", [20]).first()
    assert got.goods == pytest.approx(1 - 2 / 7, abs=1e-6) and got.chao1 == 6.0 and got.distc20 == 0.0


def test_rules_and_human_classes(spark):
    rules = [U.Rule("x", (U.Predicate("f", "in", ("a",)),)), U.Rule("y", (U.Predicate("f", "contains", ("b",)), U.Predicate("g", "not_in", ("no",))))]
    rows = spark.createDataFrame([("k1", "A", None), ("k1", "bb", None), ("k2", "bb", "no"), ("k3", None, None), (None, "a", "x"), ("k4", "b", "yes")], "key string, f string, g string")
    got = {r.key: (r.labels, r.curated) for r in U.curate(rows, "key", rules, {"x|y": "both"}, F.lit(True)).collect()}
    assert got == {"k1": ("x|y", "both"), "k2": ("", "others/missing"), "k3": ("", "others/missing"), "k4": ("y", "y")}
    cases = spark.createDataFrame([("Food_Animal", 1, 0.1, "[99]"), (None, None, 0.9, "[1]"), (None, 1, 0.9, "[1, 2]"), (None, 1, 0.1, "[1, 2]"), ("?", 1, 0.1, "[50]"), (None, 1, None, "oops")], "t string, p int, tr double, d string")
    assert [r.c for r in cases.select(U.human_class(F.col("t"), F.col("p"), F.col("tr"), U.parse_vector(F.col("d"))).alias("c")).collect()] == ["F", "G", "F", "G", "W", "G"]
    with pytest.raises(ValueError):
        U.keep_subset(cases, F.lit(True), "t", "Z")


def test_keys(spark):
    df = spark.createDataFrame([(" synb 00000001.2", "1805/MLAA.00", "BOVINE / TARN BRIDGE 10165"), ("SYNB-00000001", " 1805 mlaa 00 ", "Tarn Bridge-10165; Poultry"), ("-", "not applicable", "Poultry"), (None, None, None), ("SYNB00000001", "1805MLAA00", "Bovine  Tarn Bridge, no. 10165")], "a string, o string, s string")
    got = [tuple(r) for r in df.select(accession_key(F.col("a")), outbreak_key(F.col("o")), site_key(F.col("s"))).collect()]
    one = ("SYNB00000001", "1805MLAA00", "tarnbridge10165")
    assert got == [one, one, (None, None, None), (None, None, None), one]


def test_profiles():
    x = np.array([[1, 2, 0, 4000], [1, 3, 5, 9000]], np.int16)
    assert distances(x[:1], x[1:])[0] == pytest.approx(2 / 3)
    for y in (x, x[:1], x[:, :3], x[:0], x[:, :1]):
        assert (unpack(pack(y), y.shape[1]) == y).all()
    mixed = pa.chunked_array([pack(x), pack(x[:1])])
    assert (unpack(mixed, 4) == x[[0, 1, 0]]).all()
    column = pa.array([[1, 2, None], None, [], [-4, 7, 9]], pa.list_(pa.int16()))
    assert matrix(column, 3).tolist() == [[1, 2, 0], [0] * 3, [0] * 3, [0, 7, 9]] and matrix(column, 4)[:, 3].sum() == 0
    with pytest.raises(ValueError):
        matrix(column, 2)


def test_wide_profiles_count_whole(spark):
    """3,002 loci: the distances are those of all of them."""
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 60, (40, 3002)).astype(np.int16)
    df = spark.createDataFrame([(i, r.tolist(), "a") for i, r in enumerate(x)], "id long, alleles array<short>, label string")
    got = {(r.query_id, r.rank): (r.train_id, r.distance) for r in K.nearest(df.where("id < 5"), df.where("id >= 5"), 3).collect()}
    x = np.maximum(x, 0)
    for i in range(5):
        d = distances(np.broadcast_to(x[i], (35, 3002)), x[5:])
        for rank, j in enumerate(np.argsort(d, kind="stable")[:3], 1):
            assert got[i, rank] == (j + 5, pytest.approx(d[j], abs=1e-9))


@pytest.mark.parametrize("loci", [9, 240, 600])
def test_k_nearest_is_exact(loci):
    """Near, far, sparse, missing and equal rows: the k nearest of brute force, ties by the earlier row."""
    rng = np.random.default_rng(loci)
    base = rng.zipf(1.3, (40, loci)) % 1400 + 1
    x = np.concatenate([base[rng.integers(0, 20, 5000)], rng.integers(1, 1400, (300, loci)), base])
    x[rng.random(x.shape) < 0.25] = rng.integers(1, 1400)
    x[rng.random(x.shape) < 0.05] = 0
    x[::50, : loci - 2] = 0
    x[7] = 0
    x = x.astype(np.int16)
    y = x[rng.choice(len(x), 150, replace=False)]
    y[0] = 0
    d = K.block_distances(y, x)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    rows, cols, got = K.k_nearest(y, x, 5)
    assert (rows == np.repeat(np.arange(len(y)), 5)).all() and (cols.reshape(-1, 5) == want).all() and (got.reshape(-1, 5) == np.take_along_axis(d, want, 1)).all()
    assert K.k_nearest(y, x[:3], 5)[1].size == 3 * len(y) and K.k_nearest(y[:0], x, 5)[0].size == 0


@pytest.mark.parametrize("loci", [9, 240, 300])
def test_index_counts_the_same_alleles(loci, monkeypatch):
    """Counts from the index are those of all loci, whatever the centre; in a family few matches are looked up for a pair."""
    monkeypatch.setattr(K, "PART", 700)
    rng = np.random.default_rng(loci)
    centre = rng.integers(1, 1400, loci).astype(np.int16)
    x = np.where(rng.random((2000, loci)) < 0.25, rng.integers(1, 1400, (2000, loci)), centre).astype(np.int16)
    x[rng.random(x.shape) < 0.1] = 0
    x[::40], x[5::97] = 0, -1
    y = np.concatenate([x[:70], rng.integers(-1, 1500, (10, loci)).astype(np.int16)])
    want = ((y[:, None, :] == x[None, :, :]) & (y > 0)[:, None, :]).sum(2)
    for c in (centre, np.zeros(loci, np.int16), rng.integers(1, 1400, loci).astype(np.int16), None):
        assert (K._Index(x, c).same(y) == want).all()
    assert K._Index(x).matches(x) < 0.1 < K._Index(x, np.zeros(loci, np.int16)).matches(x)
    assert K._Index(x[:0]).same(y).shape == (80, 0) and (K._Index(np.zeros((3, loci), np.int16)).same(y) == 0).all()
    a, b = K._Coded(y, 0), K._Coded(x, 255)
    rows, cols = np.divmod(np.arange(want.size), len(x))
    at_least = K._same_pairs(*(np.ascontiguousarray(v.planes().transpose(2, 0, 1)) for v in (a, b)), a.known, rows, cols)
    assert (at_least >= want.ravel()).all() and at_least.mean() < want.mean() + 0.5 * loci


def test_k_nearest_compares_few_pairs_in_full():
    """In families of near profiles it takes less than half the time of all distances."""
    rng = np.random.default_rng(3)
    x = rng.integers(1, 1400, (100, 240))[rng.integers(0, 100, 20_000)]
    x = np.where(rng.random(x.shape) < 0.2, rng.integers(1, 1400, x.shape), x).astype(np.int16)
    took = []
    for run in (lambda: np.argsort(K.block_distances(x[:256], x), axis=1, kind="stable")[:, :5], lambda: K.k_nearest(x[:256], x, 5)):
        began = time.process_time()
        run()
        took.append(time.process_time() - began)
    assert took[1] < took[0] / 2
