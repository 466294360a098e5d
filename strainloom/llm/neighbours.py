"""The most similar allele profiles of every profile.

Profiles become sign vectors (one hashed sign for each allele, 0 where missing) under a random rotation; cells
are fitted by k-means on a bounded sample, without centres so near each other that they would cut a family of
near copies, and every profile enters its nearest cells. A large cell is parted into lists in the same way, so the
comparisons of a profile don't grow with the table. Inside a list the vectors are scanned in blocks of columns:
after each block a hypothesis test on the partial distance abandons most candidates, and the exact distance decides
on the rest. Where most candidates would pass to the end, the exact distances of the tile are counted at once. Only
the k best of each profile are kept on the way.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainloom.functions.profiles import distances, extent, matrix, pack, unpack
from strainloom.operators.skew import skew_join
from strainloom.session import BROADCAST_ROWS, cut

#: Most cells, profiles a cell should hold, profiles of the sample for each cell (so the sample has at most
#: CELLS * SAMPLE of them, whatever the table's size), k-means rounds, and cells or lists that a profile enters: at most
#: PROBES, those whose centres' products with its vector are within MARGIN of the best one.
CELLS, CELL_SIZE, SAMPLE, ROUNDS, PROBES, MARGIN = 1024, 500, 20, 3, 3, 0.5
#: A large cell is parted into lists of about LIST_SIZE, fitted on at least FIT of its own profiles for each list.
LIST_SIZE, FIT = 500, 8
#: A cell that is expected to hold more is cut into blocks of this size; each pair of blocks is one group.
BLOCK = 32_768
#: Rows and columns of a tile of a list; share of a tile's pairs from which exact distances of all are cheaper than
#: tests, rows and columns of those; pairs tested at once.
TILE, DENSE, DENSE_TILE, PAIRS = (1024, 2048), 0.02, (256, 1024), 50_000
#: Columns after which candidates are tested, and the width of the test.
COLUMNS, EPSILON = (32, 64, 128), 2.1
ROTATION_SEED = 7


@functools.cache
def _rotation(loci: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(ROTATION_SEED).standard_normal((loci, loci)))[0].astype(np.float32)


def sign_vectors(x: np.ndarray) -> np.ndarray:
    """Rotated sign vectors of the profiles: the squared distance of two is at most 4 for each differing locus plus
    1 for each locus missing in one of them."""
    with np.errstate(over="ignore"):
        k = (x.astype(np.uint64) + np.uint64(65536) * np.arange(x.shape[1], dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(29)
        k *= np.uint64(0xBF58476D1CE4E5B9)
        k ^= k >> np.uint64(32)
    signs = np.where(x > 0, np.where(k & np.uint64(1), 1, -1), 0).astype(np.float32)
    return signs @ _rotation(x.shape[1])


def fit_lists(vectors: np.ndarray, n_lists: int, limit: float) -> np.ndarray:
    """Spherical k-means centres of the sample, no two of which are as near as two profiles within a quarter of `limit`
    are on average: the centres of the parts of one family of near copies are, so it is not cut, however large a
    share of the sample it is."""
    rng = np.random.default_rng(ROTATION_SEED)
    near = 1 - limit / 2
    units, order = _unit(vectors), rng.permutation(len(vectors))
    centres = units[:0]
    for k in range(0, len(order), 1024):
        part = units[order[k : k + 1024]]
        if len(centres):
            part = part[(part @ centres.T).max(1) < near]
        centres = np.concatenate([centres, part[_apart(part, near)]])[:n_lists]
        if len(centres) == n_lists:
            break
    for _ in range(ROUNDS):
        centres = _unit(centres)
        own = nearest_list(vectors, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        centres = np.where(np.bincount(own, minlength=len(centres))[:, None] > 0, sums, centres)
    centres = _unit(centres)
    weight = np.bincount(nearest_list(vectors, centres), minlength=len(centres))
    centres = centres[np.argsort(-weight, kind="stable")]
    return centres[_apart(centres, near)]


def _apart(units: np.ndarray, near: float) -> list[int]:
    """Places of rows, in order, whose cosine with all chosen before is below `near`."""
    chosen, dropped = [], np.zeros(len(units), bool)
    for i in range(len(units)):
        if not dropped[i]:
            chosen.append(i)
            dropped |= units @ units[i] >= near
    return chosen


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-6)


def nearest_list(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Place of the centre with the smallest angle (by length, short centres would draw in all outliers)."""
    return (vectors @ centres.T).argmax(1)


def probed_lists(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that each vector enters."""
    probes = min(PROBES, len(centres))
    score = vectors @ centres.T
    lists = np.argpartition(-score, probes - 1, 1)[:, :probes]
    score = np.take_along_axis(score, lists, 1)
    row, k = np.nonzero(score >= score.max(1, keepdims=True) - MARGIN)
    return row, lists[row, k]


def _best(q: np.ndarray, other: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each q, ties by the smaller id."""
    order = np.lexsort((other, d, q))
    sorted_q = q[order]
    first = np.flatnonzero(np.r_[True, sorted_q[1:] != sorted_q[:-1]]) if len(q) else np.empty(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[place < k]


class KBest:
    """The k nearest of each row of a block, ties by the smaller place; memory is rows x k."""

    def __init__(self, n: int, k: int, limit: float):
        self.k, self.d, self.other = k, np.full((n, k), np.inf), np.full((n, k), -1)
        self.worst = np.full(n, np.nextafter(limit, 2))
        self.limit = self.worst[:1].copy()

    def add(self, q: np.ndarray, other: np.ndarray, d: np.ndarray) -> None:
        """Candidates within the limit, in any order."""
        if not len(q):
            return
        rows = np.unique(q)
        q, other, d = np.r_[q, np.repeat(rows, self.k)], np.r_[other, self.other[rows].ravel()], np.r_[d, self.d[rows].ravel()]
        top = _best(q, other, d, self.k)  # each row has k places already, so k remain
        self.other[rows], self.d[rows] = other[top].reshape(-1, self.k), d[top].reshape(-1, self.k)
        self.worst[rows] = np.minimum(self.d[rows, -1], self.limit)

    def add_tile(self, rows: np.ndarray, others: np.ndarray, d: np.ndarray) -> None:
        """Distances of rows x others. Others come in ascending order from tile to tile, so one that only equals
        the worst kept loses the tie."""
        better = d < self.worst[rows][:, None]
        if len(others) > self.k and better.sum() > 4 * self.k * len(rows):
            # distances of unequal shares lie further apart than the column's part of the key
            key = np.where(better, d, 9) + np.arange(len(others)) * 1e-13
            few = np.argpartition(key, self.k - 1, 1)[:, : self.k]
            at = np.repeat(np.arange(len(rows)), self.k), few.ravel()
            at = tuple(v[better[at]] for v in at)
        else:
            at = np.nonzero(better)
        self.add(rows[at[0]], others[at[1]], d[at])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.nonzero(self.other >= 0)
        return at[0], self.other[at], self.d[at]


def _all_distances(xa: np.ndarray, xb: np.ndarray) -> np.ndarray:
    """`distances` of each row of xa and each of xb."""
    ka, kb = xa > 0, xb > 0
    a, b = np.where(ka, xa, -1).T.copy(), np.where(kb, xb, -2).T.copy()
    equal = np.zeros((len(xa), len(xb)), np.uint8 if len(a) < 256 else np.uint16)
    same = np.empty(equal.shape, bool)
    for u, v in zip(a, b):
        np.equal(u[:, None], v[None, :], out=same)
        np.add(equal, same.view(np.uint8), out=equal)
    known = ka.astype(np.float32) @ kb.T.astype(np.float32)
    return np.where(known > 0, (known - equal) / np.maximum(known, 1).astype(np.float64), 1.0)


def scan(xa: np.ndarray, xb: np.ndarray, limit: float, k: int, va: np.ndarray | None = None, vb: np.ndarray | None = None) -> tuple[KBest, KBest]:
    """The k best of xb for the rows of xa and of xa for the rows of xb within `limit`, by the adaptive scan. Where xb
    is xa, both are the same and no row meets itself. Ties go to the smaller place."""
    same = xb is xa
    va = sign_vectors(xa) if va is None else va
    vb = va if same else sign_vectors(xb) if vb is None else vb
    ma, mb = (xa <= 0).sum(1), (xb <= 0).sum(1)
    loci = xa.shape[1]
    columns = [*(c for c in COLUMNS if c < loci), loci]
    if len(columns) == 1:
        columns = [loci, loci]
    base = 4 * limit * loci
    best_a = KBest(len(xa), k, limit)
    best_b = best_a if same else KBest(len(xb), k, limit)
    # for each stage: the partial distance minus what the missing loci allow, as one product of augmented rows
    factor = [np.float32((1 + (EPSILON / np.sqrt(d) if d < loci else 1e-4)) ** 2 * d / loci) for d in columns]
    wide_a = [_augmented(va[:, :d], ma, f, True) for d, f in zip(columns[:-1], factor)]
    wide_b = [_augmented(vb[:, :d], mb, f, False) for d, f in zip(columns[:-1], factor)]
    begin = 0
    # any row meets the others in ascending order: as a row of the tiles after it, before as a column
    for i in range(0, len(xa), TILE[0]):
        rows = slice(i, i + TILE[0])
        for j in range(i if same else 0, len(xb), TILE[1]):
            cols = slice(j, j + TILE[1])
            # a tile goes on to more columns as a whole while many of its pairs pass; the next one begins where it ended
            for stage in range(begin, len(wide_a)):
                excess = wide_a[stage][rows] @ wide_b[stage][cols].T
                ok = excess <= factor[stage] * base
                if same and j < i + TILE[0]:
                    ok &= np.arange(i, i + ok.shape[0])[:, None] < np.arange(j, j + ok.shape[1])[None, :]
                passed = np.count_nonzero(ok)
                many = passed > max(PAIRS, DENSE * ok.size)
                if not many:
                    break
            begin = stage if passed * 8 > max(PAIRS, DENSE * ok.size) else max(0, stage - 1)
            if many:
                _dense(xa, xb, range(i, i + ok.shape[0]), range(j, j + ok.shape[1]), same, best_a, best_b)
                continue
            flat = np.flatnonzero(ok)
            at_a, at_b = flat // ok.shape[1], flat % ok.shape[1]
            for p in range(0, len(flat), PAIRS):
                a, b = at_a[p : p + PAIRS] + i, at_b[p : p + PAIRS] + j
                part = excess[at_a[p : p + PAIRS], at_b[p : p + PAIRS]] + factor[stage] * (ma[a] + mb[b])
                for start, upto, f in zip(columns[stage:], columns[stage + 1 :], factor[stage + 1 :]):
                    step = va[a, start:upto] - vb[b, start:upto]
                    part = part + np.einsum("ij,ij->i", step, step)
                    keep = part <= f * (base + ma[a] + mb[b])
                    a, b, part = a[keep], b[keep], part[keep]
                exact = distances(xa[a], xb[b])
                keep = exact <= limit
                a, b, exact = a[keep], b[keep], exact[keep]
                best_a.add(a, b, exact)
                best_b.add(b, a, exact)
    return best_a, best_b


def _augmented(v: np.ndarray, missing: np.ndarray, factor: np.float32, first: bool) -> np.ndarray:
    """Rows whose product with those of the other side is |a - b|^2 - factor * (missing loci of both)."""
    own = (np.einsum("ij,ij->i", v, v) - factor * missing)[:, None].astype(np.float32)
    one = np.ones_like(own)
    return np.concatenate([-2 * v, own, one] if first else [v, one, own], 1)


def _dense(xa: np.ndarray, xb: np.ndarray, rows: range, cols: range, same: bool, best_a: KBest, best_b: KBest) -> None:
    """Exact distances of all pairs of a tile; where xb is xa, of each pair once."""
    for i in rows[:: DENSE_TILE[0]]:
        a = np.arange(i, min(i + DENSE_TILE[0], rows.stop))
        for j in cols[:: DENSE_TILE[1]]:
            b = np.arange(j, min(j + DENSE_TILE[1], cols.stop))
            if same and b[-1] <= a[0]:
                continue
            d = _all_distances(xa[a], xb[b])
            if same and j < a[-1] + 1:
                d[a[:, None] >= b[None, :]] = 9
            best_a.add_tile(a, b, d)
            best_b.add_tile(b, a, d.T)


def scan_cell(xa: np.ndarray, xb: np.ndarray, limit: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of xa, row of xb, distance) of the k best of each side found in a cell or a pair of blocks of one, perhaps
    more than once; where xb is xa each pair comes for both. A large cell is parted into lists as the whole table is
    into cells, so the comparisons of a row don't grow with the cell, and lists are scanned one by one."""
    same = xb is xa
    va = sign_vectors(xa)
    vb = va if same else sign_vectors(xb)
    n_lists = max(len(xa), len(xb)) // LIST_SIZE
    if n_lists > 2 * PROBES**2:  # fewer lists would save nothing, as a row enters PROBES of them
        every = max(1, max(len(xa), len(xb)) // (n_lists * FIT))
        centres = fit_lists(np.concatenate([va[::every], vb[1::every]]) if not same else va[::every], n_lists, limit)
        in_a = probed_lists(va, centres)
        in_b = in_a if same else probed_lists(vb, centres)
        lists = [(in_a[0][in_a[1] == c], in_b[0][in_b[1] == c]) for c in range(len(centres))]
    else:
        lists = [(np.arange(len(xa)), np.arange(len(xb)))]
    for a, b in lists:
        if not len(a) or not len(b):
            continue
        first = xa[a]
        best_a, best_b = scan(first, first if same else xb[b], limit, k, va[a], None if same else vb[b])
        r, o, d = best_a.result()
        yield a[r], (a if same else b)[o], d
        if not same:
            o, r, d = best_b.result()
            yield a[r], b[o], d


def nearest_profiles(profiles: DataFrame, id_col: str, alleles: str, k: int, limit: float) -> DataFrame:
    """(id, neighbour, distance): for every profile its k nearest others within `limit`, ties by the smaller id.

    Ids are longs and unique. Profiles without any known locus have no neighbours, shorter arrays miss their last loci;
    exact copies are searched once and each gets its own row of neighbours (a group of copies may be any size). The
    search is approximate: the tests compare it with brute force. An empty table gives no rows; other columns are
    ignored.
    """
    known = profiles.where(F.exists(alleles, lambda v: v > 0)).select(F.col(id_col).alias("id"), F.col(alleles).alias("x"))
    n, loci = extent(known, "x")
    n_cells = max(1, min(CELLS, n // CELL_SIZE))
    size = n_cells * SAMPLE
    sample = known.where(F.pmod(F.xxhash64("id", F.lit(ROTATION_SEED)), F.lit(max(1, n // size))) == 0).select("x").limit(size).toArrow()
    loci = max(1, loci)
    vectors = sign_vectors(matrix(sample.column("x"), loci)) if sample.num_rows else np.zeros((1, loci), np.float32)
    centres = fit_lists(vectors, n_cells, limit)
    sizes = np.bincount(probed_lists(vectors, centres)[1], minlength=len(centres)) * max(1.0, n / max(1, len(vectors)))
    blocks = np.maximum(1, np.ceil(sizes / BLOCK)).astype(np.int64)

    prints = known.select("id", F.xxhash64("x").alias("h1"), F.hash("x").alias("h2"))
    copies = prints.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(skew_join(prints, copies, ["h1", "h2"]).select("id", "rep"))
    # the k + 1 smallest of a group of copies, found in two steps so that no group meets in one task
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    w1, w2 = Window.partitionBy("rep", "salt").orderBy("id"), Window.partitionBy("rep").orderBy("id")
    few = salted.withColumn("r", F.row_number().over(w1)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(w2)).where(F.col("r") <= k + 1)
    firsts = few.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    extra = members.where("id <> rep").select("id")
    reps = known.join(F.broadcast(extra) if extra.count() <= BROADCAST_ROWS else extra, "id", "left_anti")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("id").to_numpy(), matrix(batch.column("x"), loci)
            if not len(ids):
                continue
            row, cell = probed_lists(sign_vectors(x), centres)
            own = ids[row] % 1_000_003 * 7919 % 1_000_003 % blocks[cell]
            # a row of a cell of several blocks meets all of them
            times = blocks[cell]
            row, cell, own = (np.repeat(v, times) for v in (row, cell, own))
            other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            out = {"cell": cell.astype(np.int32), "i": np.minimum(own, other).astype(np.int32), "j": np.maximum(own, other).astype(np.int32), "own": own.astype(np.int32), "id": ids[row]}
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in out.values()), pack(x).take(pa.array(row))], [*out, "x"])

    def within(group: pa.Table) -> pa.Table:
        ids, own, x = group.column("id").to_numpy(), group.column("own").to_numpy(), unpack(group.column("x"), loci)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        order = np.argsort(ids, kind="stable")
        left, right = order[own[order] == i], order[own[order] == j]
        first, (ids_a, ids_b) = x[left], (ids[left], ids[right])
        q, other, d = [], [], []
        for a, b, dist in scan_cell(first, first if i == j else x[right], limit, k):
            q.append(ids_a[a]), other.append((ids_a if i == j else ids_b)[b]), d.append(dist)
            if i != j:
                q.append(ids_b[b]), other.append(ids_a[a]), d.append(dist)
        kinds = {"q": np.int64, "other": np.int64, "d": np.float64}
        return pa.table({c: np.concatenate(v) if v else np.empty(0, t) for (c, t), v in zip(kinds.items(), (q, other, d))})

    cells = reps.mapInArrow(assign, "cell int, i int, j int, own int, id long, x binary")
    found = cells.groupBy("cell", "i", "j").applyInArrow(within, "q long, other long, d double")
    best = F.slice(F.sort_array(F.collect_set(F.struct("d", "other"))), 1, k)
    nearest = found.groupBy("q").agg(best.alias("b")).select("q", F.inline("b"))
    # copies: each neighbour stands for the first of its group, and a group's own members are nearest of all
    spread = nearest.join(firsts.withColumnRenamed("rep", "other"), "other", "left").select("q", "d", F.explode(F.coalesce("ids", F.array("other"))).alias("id"))
    own = firsts.select(F.col("rep").alias("q"), F.lit(0.0).alias("d"), F.explode("ids").alias("id"))
    ranked = cut(spread.unionByName(own).groupBy("q").agg(F.sort_array(F.collect_set(F.struct("d", "id"))).alias("near")))
    # every member of a group of copies has the neighbours of its representative; a member that has no copies is one
    asked = members.select("id", F.col("rep").alias("q"))
    alone = ranked.join(firsts.select(F.col("rep").alias("q")), "q", "left_anti").select(F.col("q").alias("id"), "near")
    queries = alone.unionByName(skew_join(asked, ranked, ["q"]).select("id", "near"))
    return queries.select("id", F.explode(F.slice(F.filter("near", lambda v: v["id"] != F.col("id")), 1, k)).alias("v")).select(F.col("id").alias(id_col), F.col("v.id").alias("neighbour"), F.col("v.d").alias("distance"))
