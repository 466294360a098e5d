"""Overlaps and nearest profiles against brute force, with missing loci, copies, nulls and short arrays."""

import tracemalloc

import numpy as np
import pytest

from strainloom.functions.profiles import distances
from strainloom.llm import neighbours, overlap
from strainloom.llm.neighbours import nearest_profiles, scan_cell
from strainloom.llm.overlap import SuffixIndex, cross_split_pairs, near_pairs_in_block


def family(seed, n=420):
    """Profiles of 240 loci in clusters of near copies, some loci missing, some profiles repeated."""
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 900, (n // 6 + 1, 240))
    x = base[np.arange(n) // 6].copy()
    for row in x:
        row[rng.choice(240, rng.integers(0, 9), replace=False)] = rng.integers(1, 900)
        row[rng.choice(240, rng.integers(0, 30), replace=False)] = rng.choice([0, -1])
    x[10] = x[11]
    x[12] = 0
    return x.astype(np.int16)


@pytest.fixture(scope="module")
def rows(spark):
    x = family(1)
    data = [(i, [int(v) for v in r], "extra") for i, r in enumerate(x)] + [(1000, None, "n"), (1001, [], "e"), (1002, [5, None, 3], "short")]
    full = np.zeros((len(data), 240), np.int16)
    full[: len(x)] = np.maximum(x, 0)
    full[-1, [0, 2]] = [5, 3]
    return spark.createDataFrame(data, "profile_id long, alleles array<short>, id string"), [d[0] for d in data], full


def all_distances(x):
    d = np.array([distances(np.broadcast_to(r, x.shape), x) for r in x])
    np.fill_diagonal(d, 9)
    return d


def test_overlap_is_exact(spark, rows):
    df, ids, x = rows
    train, test = df.where("profile_id % 3 <> 0"), df.where("profile_id % 3 = 0")
    got = {(r.train_id, r.eval_id) for r in cross_split_pairs(train, test, "profile_id", "alleles", 0.02).collect()}
    d = all_distances(x)
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(d <= 0.02)) if ids[i] % 3 and not ids[j] % 3}
    assert len(want) > 50 and got == want
    assert cross_split_pairs(train.where("false"), test, "profile_id", "alleles", 0.02).count() == 0
    assert cross_split_pairs(train, test.where("false"), "profile_id", "alleles", 0.02).count() == 0


def test_neighbours_recall(spark, rows):
    df, ids, x = rows
    got = {(r.profile_id, r.neighbour) for r in nearest_profiles(df, "profile_id", "alleles", 5, 0.05).collect()}
    d = all_distances(x)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in sorted(np.flatnonzero(d[i] <= 0.05), key=lambda j: (d[i, j], ids[j]))[:5]}
    assert len(got & want) >= 0.9 * len(want)
    assert {(10, 11), (11, 10)} <= got
    assert nearest_profiles(df.where("false"), "profile_id", "alleles", 5, 0.05).count() == 0


def test_many_copies(spark):
    one = [int(v) for v in family(3)[0]]
    df = spark.range(300).selectExpr("id as profile_id").crossJoin(spark.createDataFrame([(one,)], "alleles array<short>"))
    got = {}
    for r in nearest_profiles(df, "profile_id", "alleles", 5, 0.05).collect():
        got.setdefault(r.profile_id, []).append(r.neighbour)
    assert all(sorted(v) == [x for x in range(7) if x != k][:5] for k, v in got.items()) and len(got) == 300


def test_family_of_near_copies_is_not_cut(spark):
    """A third of 9,000 profiles are near (not exact) copies of one."""
    rng = np.random.default_rng(4)
    x = np.concatenate([family(5, 6000), np.repeat(rng.integers(1, 900, (1, 240)), 3000, 0)]).astype(np.int16)
    for row in x[6000:]:
        at = rng.choice(240, rng.poisson(4), replace=False)
        row[at] = rng.integers(1, 900, len(at))
    order = rng.permutation(len(x))
    x = np.maximum(x, 0)[order]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "profile_id long, alleles array<short>")
    got = {(r.profile_id, r.neighbour) for r in nearest_profiles(df, "profile_id", "alleles", 5, 0.05).collect()}
    want, asked = set(), rng.choice(np.flatnonzero(order >= 6000), 400, replace=False)
    for i in asked:
        d = distances(np.broadcast_to(x[i], x.shape), x)
        d[i] = 9
        want |= {(int(i), int(j)) for j in np.lexsort((np.arange(len(x)), d))[:5] if d[j] <= 0.05}
    assert len(want) > 1500 and len(got & want) >= 0.98 * len(want)


def test_overlap_of_many_copies(spark):
    one = [int(v) for v in family(3)[0]]
    df = spark.range(500).selectExpr("id as profile_id").crossJoin(spark.createDataFrame([(one,)], "alleles array<short>"))
    pairs = cross_split_pairs(df.where("profile_id < 300"), df.where("profile_id >= 300"), "profile_id", "alleles", 0.02)
    got = {(r.train_id, r.eval_id) for r in pairs.where("distance = 0").collect()}
    assert got == {(a, b) for a in range(300) for b in range(300, 500)} and pairs.count() == 300 * 200


@pytest.mark.parametrize("known", [(1, 240), (4, 240), (20, 240), (60, 240), (122, 240), (8, 8), (240, 2), (240, 12), (100, 130)])
def test_sparse_profiles_are_found(spark, known):
    """A training row is a copy of an evaluation row; both miss all but some loci. Every pair of brute force is found."""
    rng = np.random.default_rng(sum(known))
    x = rng.integers(1, 900, (60, 240)).astype(np.int16)
    y = x[:20].copy()
    for row, k in [*((r, known[0]) for r in x[:8]), *((r, known[1]) for r in y[:8])]:
        row[rng.choice(240, 240 - k, replace=False)] = 0
    data = [(i, r.tolist()) for i, r in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(data, "profile_id long, alleles array<short>")
    got = {(r.train_id, r.eval_id) for r in cross_split_pairs(df.where("profile_id >= 60"), df.where("profile_id < 60"), "profile_id", "alleles", 0.02).collect()}
    want = {(60 + i, int(j)) for i, r in enumerate(y) for j in np.flatnonzero(distances(np.broadcast_to(r, x.shape), x) <= 0.02)}
    assert got == want and len(want) >= 12


def test_several_shards_and_blocks(spark, rows, monkeypatch):
    df, ids, x = rows
    train, test = df.where("profile_id % 3 <> 0"), df.where("profile_id % 3 = 0")
    one = sorted(map(tuple, cross_split_pairs(train, test, "profile_id", "alleles", 0.02).collect()))
    for name in ("SHARD", "BLOCK", "CHUNK"):
        monkeypatch.setattr(overlap, name, 40)
    assert sorted(map(tuple, cross_split_pairs(train, test, "profile_id", "alleles", 0.02).collect())) == one


def test_matches_are_maximal_and_merged(spark):
    rng = np.random.default_rng(8)
    one = rng.integers(1, 900, 240)
    two, three, four = one.copy(), one.copy(), one.copy()
    two[100] += 1  # parts the profile in two matches, each with a whole segment
    three[[3, 100, 170, 235]] += 1  # of the segments of 48 loci only the second has no difference: from 4 to 99
    four[50:80] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate([one, one, two, three, four])], "profile_id long, alleles array<short>")
    got = {r.eval_id: (r.matched_loci, r.n_spans) for r in cross_split_pairs(df.where("profile_id = 0"), df.where("profile_id > 0"), "profile_id", "alleles", 0.02).collect()}
    assert got == {1: (240, 1), 2: (239, 2), 3: (96, 1), 4: (210, 1)}


def test_index_is_its_text():
    x = np.maximum(family(9)[:200], 0)
    index = SuffixIndex.load(SuffixIndex.dump(x), 240)
    assert (index.x == x).all()
    assert (index.profiles(7, np.arange(200)) == np.lexsort(x[:, 7:].T[::-1])).all() or len(np.unique(x[:, 7:], axis=0)) < 200


@pytest.mark.parametrize("loci", [1, 7, 301])
def test_other_widths(spark, loci):
    rng = np.random.default_rng(loci)
    x = rng.integers(1, 4, (40, loci)).astype(np.int16)
    x[20:] = x[:20]
    x[20:, rng.integers(0, loci)] += 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "profile_id long, alleles array<short>")
    d = all_distances(x)
    got = {(r.train_id, r.eval_id) for r in cross_split_pairs(df.where("profile_id < 20"), df.where("profile_id >= 20"), "profile_id", "alleles", 0.02).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.02)) if i < 20 <= j}
    near = {(r.profile_id, r.neighbour) for r in nearest_profiles(df, "profile_id", "alleles", 5, 0.05).collect()}
    want = {(i, j) for i in range(40) for j in sorted(np.flatnonzero(d[i] <= 0.05), key=lambda j: (d[i, j], j))[:5]}
    assert len(near & want) >= 0.9 * len(want)


def test_large_cells_are_parted(monkeypatch):
    """Lists inside a cell, and between the blocks of one, find the pairs that brute force does."""
    monkeypatch.setattr(neighbours, "LIST_SIZE", 60)
    x = np.maximum(family(11, 2400), 0)
    d = all_distances(x)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 0.05))}
    got = {(int(a), int(b)) for q, o, _ in scan_cell(x, x, 0.05, 5) for a, b in zip(q, o)}
    assert got <= want and len(got) >= 0.95 * len(want)
    left, right = x[::2], x[1::2]
    pairs = {(int(a) * 2, int(b) * 2 + 1) for q, o, _ in scan_cell(left, right, 0.05, 5) for a, b in zip(q, o)}
    apart = {(i, j) for i, j in want if i % 2 == 0 and j % 2}
    assert pairs <= apart and len(pairs) >= 0.95 * len(apart)


def test_overlap_memory_does_not_grow_with_the_anchors():
    """3,000 near copies meet 800: every anchor finds most of the 2.4 million pairs again."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.integers(1, 900, (1, 240)), 3800, 0).astype(np.int16)
    for row in x:
        row[rng.choice(240, 1)] = rng.integers(1, 900)
    y, x = x[:800], x[800:]
    index = SuffixIndex.of(x)
    tracemalloc.start()
    r, at, d, *_ = near_pairs_in_block(index, y, 0.02)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(zip(r.tolist(), at.tolist()))) == len(r) == 800 * 3000 and d.max() <= 0.02
    assert peak < 400e6


def test_index_is_compact():
    """Of random profiles, each allele a run of its own, the index holds less than 22 bytes a locus."""
    x = np.random.default_rng(2).integers(1, 900, (4000, 240)).astype(np.int16)
    blob = SuffixIndex.dump(x)
    tracemalloc.start()
    index = SuffixIndex.load(blob, 240)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 22 * x.size and (index.x == x).all()
