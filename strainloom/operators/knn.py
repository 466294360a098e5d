"""Attribution by the nearest training profiles: missing-aware distances, weighted votes and trust."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strainloom.functions.cells import Cells, least_distance
from strainloom.functions.portable import folds
from strainloom.functions.profiles import extent, matrix, pack, unpack
from strainloom.operators.association import normal_tail
from strainloom.session import cut

#: Most rows of a block of queries and of a block of training profiles that meet in one task, and least rows of a block
#: of queries where there are fewer tasks than partitions. A row is copied once for each block of the other side.
QUERY_BLOCK, TRAIN_BLOCK, LEAST_QUERIES = 40_000, 80_000, 100
#: Queries and training rows compared at once, and pairs of which the exact distance is worked out at once.
TILE, PAIRS = (64, 4096), 4_000
#: Training rows that share a bound of the loci that must agree.
BOUND = 512
#: Above so many pairs of queries and training rows a search goes cell by cell. Rows to fit the cells on at once, rounds of
#: that, share of the loci by which rows of the next round differ from all centres (or are unknown), most queries and
#: training rows of a cell that meet at once, cells that a query visits first, and rows up to which those of a cell are
#: compared one by one.
DIRECT, SAMPLE, ROUNDS, NEAR, CELL_BLOCK, VISITS, SMALL = 20_000_000, 61_440, 4, 0.42, (10_000, 40_000), 3, 1024
#: Rows of a part of an index of alleles, least queries for which one is made, matches of a pair of rows up to which one is
#: used, and rows by queries of which bits are counted at once.
PART, LEAST_INDEXED, MATCHES, CHUNK = 16_384, 32, 8, (8, 4096)
#: Distance up to which counts of two bits a locus tell far rows, of which a quarter of the loci agree by chance, and up
#: to which a query leaves out cells.
COARSE = 0.6
#: Rows within a query's limit above which, of labels, bounds are taken from the rows themselves.
MANY = 64


def block_distances(y: np.ndarray, x: np.ndarray, plain: bool = False) -> np.ndarray:
    """Distances of each row of y to each row of x, locus by locus: share of differing loci among those known in
    both (1 for none); plain: share of differing raw codes over all loci."""
    out = np.empty((len(y), len(x)), np.float32 if plain else np.float64)
    for i in range(0, len(y), TILE[0]):
        for j in range(0, len(x), TILE[1]):  # tiles stay in the cache
            a, b = np.ascontiguousarray(y[i : i + TILE[0]].T), np.ascontiguousarray(x[j : j + TILE[1]].T)
            diff = np.zeros((a.shape[1], b.shape[1]), np.uint16)
            if plain:
                for p in range(len(a)):
                    diff += a[p][:, None] != b[p][None, :]
                out[i : i + TILE[0], j : j + TILE[1]] = diff / len(a)
                continue
            known = ((a > 0).astype(np.float32).T @ (b > 0).astype(np.float32)).astype(np.uint16)
            same = np.zeros_like(diff)
            for p in range(len(a)):
                same += (a[p][:, None] == b[p][None, :]) & (a[p] > 0)[:, None]
            out[i : i + TILE[0], j : j + TILE[1]] = np.where(known > 0, (known - same) / np.maximum(known, 1), 1.0)
    return out


class _Coded:
    """Rows of alleles beside what the bound of their distances needs: a byte a locus (`missing` for none, equal for
    equal alleles), a bit a locus and the number of known loci."""

    def __init__(self, rows: np.ndarray, missing: int):
        self.rows = np.where(rows > 0, rows, 0 if missing else -1).astype(rows.dtype)  # a missing one is equal to none of the other side
        self.codes = np.where(rows > 0, rows % 254 + 1, missing).astype(np.uint8)
        bits = np.packbits(rows > 0, axis=1)
        self.bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
        self.known = (rows > 0).sum(1).astype(np.float32)

    def planes(self, centre: np.ndarray | None = None) -> np.ndarray:
        """Bits of each allele, then a bit for each missing one: (plane, word, row). Two hashed bits, with a centre none of
        them for its allele and a bit for another."""
        mixed = (self.rows.astype(np.uint16) * np.uint16(40503)) >> 9
        bits = [(mixed & 1) > 0, (mixed >> 1 & 1) > 0]
        if centre is not None:
            other = self.rows != centre
            bits = [other, *(b & other for b in bits)]
        packed = [np.packbits(b, axis=1) for b in (*bits, self.rows <= 0)]
        return np.ascontiguousarray(np.stack([np.pad(b, ((0, 0), (0, -b.shape[1] % 8))).view(np.uint64).T for b in packed]))


def _same_bits(y: np.ndarray, x: np.ndarray, known: np.ndarray, kind: type) -> np.ndarray:
    """Loci known in both with the same bits of each row of planes y (known: its known loci) and each of x: at least the
    loci of the same allele."""
    total = np.empty((y.shape[2], x.shape[2]), kind)
    for j in range(0, x.shape[2], 8192):  # these parts stay in the cache
        part = np.ascontiguousarray(x[:, :, j : j + 8192])
        differ, other = np.empty((2, part.shape[2]), np.uint64)
        for i in range(y.shape[2]):
            n = np.zeros(part.shape[2], kind)
            for w in range(y.shape[1]):
                np.bitwise_xor(part[0, w], y[0, w, i], out=differ)
                for p in range(1, len(y) - 1):
                    np.bitwise_xor(part[p, w], y[p, w, i], out=other)
                    np.bitwise_or(differ, other, out=differ)
                np.bitwise_or(differ, part[-1, w], out=differ)
                np.bitwise_and(differ, ~y[-1, w, i], out=differ)
                np.add(n, np.bitwise_count(differ), out=n)
            np.subtract(known[i], n, out=total[i, j : j + 8192])
    return total


def _same_pairs(y: np.ndarray, x: np.ndarray, known: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """As _same_bits of the pairs of rows (planes row by row)."""
    out = np.empty(len(rows), np.int64)
    for k in range(0, len(rows), PAIRS):
        a, b = y[rows[k : k + PAIRS]], x[cols[k : k + PAIRS]]
        differ = ((a[:, 0] ^ b[:, 0]) | (a[:, 1] ^ b[:, 1]) | b[:, 2]) & ~a[:, 2]
        out[k : k + PAIRS] = known[rows[k : k + PAIRS]] - np.bitwise_count(differ).sum(1, dtype=np.int64)
    return out


def _same_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Loci with the same code of each column of a and each of b (loci first): at least the loci of the same allele."""
    shape = a.shape[1], b.shape[1]
    equal, total = np.empty(shape, bool), np.zeros(shape, np.uint8 if len(a) <= 255 else np.uint16)
    for at in range(0, len(a), 255):  # a byte counts to 255
        part = np.zeros(shape, np.uint8)
        for p in range(at, min(at + 255, len(a))):
            np.equal(a[p][:, None], b[p][None, :], out=equal)
            np.add(part, equal.view(np.uint8), out=part)
        total += part
    return total


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits of each row in words: (word, row)."""
    packed = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64).T)


class _Index:
    """Rows by locus and allele, to count the loci of the same allele of other rows and these. Alleles of the centre, or
    where none is given of each locus the most frequent one, are bits; others are shared by few rows."""

    def __init__(self, x: np.ndarray, centre: np.ndarray | None = None):
        self.n, self.loci = x.shape
        self.kind = np.uint8 if self.loci <= 255 else np.uint16
        self.top = max(0, int(x.max(initial=0))) + 1  # alleles above have no rows
        self.first, self.parts = np.arange(self.loci) * self.top, []
        if centre is None:
            some = x[:: max(1, self.n // 4096)]
            n = np.bincount((np.maximum(some, 0) + self.first).ravel(), minlength=self.loci * self.top).reshape(self.loci, self.top)
            centre = n[:, 1:].argmax(1) + 1 if self.top > 1 else np.zeros(self.loci, np.int64)
        self.centre = centre.astype(x.dtype)
        self.bits = _words((x == self.centre) & (x > 0))
        for at in range(0, self.n, PART):
            own = np.ascontiguousarray(self._own(x[at : at + PART]).T)
            n = np.bincount((own + self.first[:, None]).ravel(), minlength=self.loci * self.top)
            self.parts.append((at, np.append(0, np.cumsum(n)).astype(np.int32), np.argsort(own, axis=1, kind="stable").astype(np.int16).ravel()))

    def _own(self, rows: np.ndarray) -> np.ndarray:
        """Alleles above 0 that are not the centre's, else 0."""
        there = (rows > 0) & (rows < self.top)
        return np.where(there & (rows != self.centre), rows, 0)

    def matches(self, y: np.ndarray) -> float:
        """Matches looked up for a pair of a row of y and one of these, on average."""
        most = y[:: max(1, len(y) // 512)]
        keys = self._own(most) + self.first
        keys = keys[keys > self.first]
        return sum(float((n[keys + 1] - n[keys]).sum(dtype=np.int64)) for _, n, _ in self.parts) / max(1, len(most) * self.n)

    def same(self, y: np.ndarray) -> np.ndarray:
        """Loci of the same allele of each row of y and each of these."""
        total = np.zeros((len(y), self.n), self.kind)
        mine = _words((y == self.centre) & (y > 0)).T
        for j in range(0, self.n, CHUNK[1]):  # these parts stay in the cache
            part = np.ascontiguousarray(self.bits[:, j : j + CHUNK[1]])
            both, ones = np.empty((CHUNK[0], part.shape[1]), np.uint64), np.empty((CHUNK[0], part.shape[1]), np.uint8)
            for i in range(0, len(y), CHUNK[0]):
                out, word = total[i : i + CHUNK[0], j : j + CHUNK[1]], mine[i : i + CHUNK[0]]
                for w in range(len(part)):
                    np.bitwise_and(part[w][None, :], word[:, w][:, None], out=both[: len(word)])
                    np.bitwise_count(both[: len(word)], out=ones[: len(word)])
                    np.add(out, ones[: len(word)], out=out)
        own, flat = self._own(y), total.reshape(-1)
        row, locus = np.nonzero(own)
        keys = own[row, locus] + self.first[locus]
        for at, start, order in self.parts:
            lo = start[keys]
            n = start[keys + 1] - lo
            some = np.flatnonzero(n)
            for few in np.array_split(some, max(1, int(n.sum(dtype=np.int64)) // 500_000)):
                ends = np.cumsum(n[few])
                if len(few):
                    place = np.arange(ends[-1]) + np.repeat(lo[few] - ends + n[few], n[few])
                    np.add.at(flat, order[place] + np.repeat(row[few] * self.n + at, n[few]), self.kind(1))
        return total


def _alike(y: _Coded, x: np.ndarray):
    """(first row, counts) of tiles of y: at least the loci of the same allele of each row of y and each of x."""
    index = _Index(x) if len(y.rows) >= LEAST_INDEXED and len(x) else None
    if index and index.matches(y.rows) > MATCHES:
        index = None
    codes = None if index else np.ascontiguousarray(_Coded(x, 255).codes.T)
    for i in range(0, len(y.rows), TILE[0]):
        yield i, index.same(y.rows[i : i + TILE[0]]) if index else _same_codes(np.ascontiguousarray(y.codes[i : i + TILE[0]].T), codes)


def _within(y: _Coded, x: _Coded, rows: np.ndarray, cols: np.ndarray, same: np.ndarray, limit: np.ndarray, counted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, cols, distances) of the pairs of rows within their row's limit; same: at least their loci of the same allele
    (counted: just these)."""
    kept = []
    for k in range(0, len(rows), PAIRS):
        r, c = rows[k : k + PAIRS], cols[k : k + PAIRS]
        known = np.bitwise_count(y.bits[r] & x.bits[c]).sum(1, dtype=np.int64)
        some = same[k : k + PAIRS] >= (1 - limit[r]) * known - 1e-3
        r, c, known = r[some], c[some], known[some]
        equal = same[k : k + PAIRS][some].astype(np.int64) if counted else np.bitwise_count(np.packbits(y.rows[r] == x.rows[c], axis=1)).sum(1, dtype=np.int64)
        d = np.where(known > 0, (known - equal) / np.maximum(known, 1), 1.0)
        some = d <= limit[r]
        kept.append((r[some], c[some], d[some]))
    return tuple(np.concatenate(v) for v in zip(*kept)) if kept else (rows, cols, np.empty(0))


def _leading(same: np.ndarray, k: int) -> np.ndarray:
    """k different columns of each row that hold high counts: the highest of k parts of the row."""
    n = same.shape[1]
    width = max(1, min(64, n // (4 * k)))
    parts = n // width
    most = same[:, : parts * width].reshape(len(same), width, parts).max(1)
    part = np.argpartition(most, parts - k, axis=1)[:, -k:]
    cols = part[:, :, None] + np.arange(width) * parts
    return (part + np.take_along_axis(same, cols.reshape(len(same), -1), 1).reshape(cols.shape).argmax(2) * parts).astype(np.int64)


def _first(query: np.ndarray, label: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each query and label, ties by the smaller id."""
    order = np.lexsort((ids, d, label, query))
    new = np.append(True, (np.diff(query[order]) != 0) | (np.diff(label[order]) != 0))[: len(order)]
    start = np.flatnonzero(new)
    return order[np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < k]


def _foremost(query: np.ndarray, label: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int, each: int) -> np.ndarray:
    """The k nearest of each query and the first `each` of each of its labels."""
    return np.union1d(_first(query, np.zeros(len(query), np.int64), ids, d, k), _first(query, label, ids, d, each))


def k_nearest(
    y: np.ndarray, x: np.ndarray, k: int, apart: tuple[np.ndarray, np.ndarray] | None = None, limit: np.ndarray | None = None, centre: np.ndarray | None = None, labels: np.ndarray | None = None, each: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, row of x, distance) of the k rows of x nearest to each row of y, ties by the earlier row; exact.

    Loci of the same allele are counted from an index of the alleles beside the centre's; where very many rows share each,
    loci of the same code are counted in bytes, or bits. The distances to k rows with many of them bound the k-th distance,
    and at least known(y) + known(x) - loci loci are known in both, so few pairs need their exact distance. With
    apart (a value for each row of y, of x) rows of the same value do not meet. With limit no pairs beyond the limit of
    the row of y are listed; a centre is one that most rows are like. With labels (a number for each row of x) the first
    `each` of every label are listed beside the k nearest.
    """
    (n, loci), found = x.shape, []
    labels = np.zeros(n, np.int64) if labels is None else labels
    blank = (y <= 0).all(1)
    if blank.any() and n > k:  # at distance 1 from all rows: the first ones
        at = np.flatnonzero(blank if limit is None else blank & (limit >= 1))
        for i in at.tolist():
            c = np.arange(n) if apart is None else np.flatnonzero(apart[1] != apart[0][i])
            c = c[np.sort(_foremost(np.zeros(len(c)), labels[c], c, np.zeros(len(c)), k, each))] if each else c[:k]
            found.append((np.full(len(c), i), c, np.ones(len(c))))
        rest = np.flatnonzero(~blank)
        r, c, d = k_nearest(y[rest], x, k, None if apart is None else (apart[0][rest], apart[1]), None if limit is None else limit[rest], centre, labels, each)
        r, c, d = (np.concatenate(v) for v in zip((rest[r], c, d), *found))
        order = np.argsort(r, kind="stable")
        return r[order], c[order], d[order]
    turn = np.lexsort((-(x > 0).sum(1), labels))  # rows of like numbers of known loci lie together, so have one bound
    start = np.flatnonzero(np.append(True, np.diff(labels[turn]) != 0)[:n])
    spans = list(zip(start, np.append(start[1:], n)))
    of = np.searchsorted(start, np.arange(n), side="right") - 1  # the label of each row in turn
    at = np.concatenate([np.arange(s, e, BOUND) for s, e in spans]) if n else turn
    sizes = np.diff(np.append(at, n))
    left, right, kind = _Coded(y, 0), _Coded(x[turn], 255), np.uint8 if loci <= 255 else np.uint16
    least = right.known[at + sizes - 1] if n else right.known
    most = np.ones(len(y)) if limit is None else np.array(limit, np.float64)
    index = _Index(x[turn], centre) if len(y) >= LEAST_INDEXED and n else None
    if index and index.matches(y) > MATCHES:
        index = None
    bits = np.full(len(y), centre is not None or index is not None) if limit is None or index else (most <= COARSE)
    planes = (left.planes(centre), right.planes(centre)) if bits.any() and not index else None
    by_locus = None if bits.all() else np.ascontiguousarray(right.codes.T)
    tiles = [own for half in (np.flatnonzero(bits), np.flatnonzero(~bits)) for own in np.array_split(half, max(1, -(-len(half) // TILE[0]))) if len(own) and n]
    for own in tiles:
        if index:
            same = index.same(y[own])
        elif bits[own[0]]:
            same = _same_bits(planes[0][:, :, own], planes[1], left.known[own].astype(kind), kind)
        else:
            codes = np.ascontiguousarray(left.codes[own].T)
            same = np.concatenate([_same_codes(codes, np.ascontiguousarray(by_locus[:, j : j + TILE[1]])) for j in range(0, n, TILE[1])], axis=1)
        together = None if apart is None else apart[0][own][:, None] == apart[1][turn][None, :]
        if together is not None:
            same[together] = 0
        most_of = np.repeat(most[own][:, None], len(spans), axis=1)

        def reach(wide: np.ndarray) -> np.ndarray:
            """Bounds for these queries of the distances in which their k nearest and the first of each label are."""
            mine, width = same if len(wide) == len(own) else same[wide], each or k
            held = [v for v, (s, e) in enumerate(spans) if e - s > width]
            bounds, c = np.ones((len(wide), len(spans))), [_leading(mine[:, s:e], width) + s for s, e in (spans[v] for v in held)]
            if not c:
                return bounds
            c = np.concatenate(c, axis=1)
            whose, c, m = np.repeat(wide, c.shape[1]), c.ravel(), c.shape[1]
            d = _within(left, right, own[whose], c, same[whose, c], np.ones(len(y)), index is not None)[2]
            if together is not None:
                d = np.where(together[whose, c], 1.0, d)
            d = d.reshape(len(wide), m)
            bounds[:, held] = d.reshape(len(wide), len(held), width).max(2)
            if each:  # any k rows bound the k-th distance
                bounds = np.maximum(bounds, np.partition(d, k - 1, axis=1)[:, k - 1 : k] if m >= k else 1.0)
            return bounds

        def meeting() -> np.ndarray:
            bound = np.ceil(np.maximum((least[None, :] + (left.known[own] - loci)[:, None]) * (1 - most_of[:, of[at]]) - 1e-3, 0)).astype(kind)
            return same >= np.repeat(bound, sizes, axis=1)

        wide = np.flatnonzero((most[own] > COARSE) | (limit is None))
        met = meeting() if len(wide) < len(own) else None
        if each and met is not None and np.count_nonzero(met) > MANY * len(own):  # the limit leaves far more than the first of each label
            wide = np.arange(len(own))
        if len(wide):
            most_of[wide] = np.minimum(most_of[wide], reach(wide))
            most[own], met = most_of.max(1), meeting()
        near = 1 - most_of
        if together is not None:
            met &= ~together
        r, c = np.divmod(np.flatnonzero(met), n)
        some = same[r, c] >= (right.known[c] + (left.known[own[r]] - loci)) * near[r, of[c]] - 1e-3
        r, c = r[some], c[some]
        r, c, d = _within(left, right, own[r], c, same[r, c], most, index is not None)
        c = turn[c]
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        top = np.sort(_foremost(r, labels[c], c, d, k, each)) if each else np.arange(len(r)) - np.searchsorted(r, r) < k
        found.append((r[top], c[top], d[top]))
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _blocks(spark: SparkSession, rows_q: int, rows_t: int) -> tuple[int, int]:
    """Blocks of queries and of training rows: of the grids of enough tasks the one that copies the fewest rows."""
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_query = max(1, -(-rows_q // QUERY_BLOCK), min(round((tasks * rows_q / max(1, rows_t)) ** 0.5), rows_q // LEAST_QUERIES))
    n_train = max(1, -(-rows_t // TRAIN_BLOCK), min(-(-tasks // n_query), rows_t // TILE[1]))
    return max(n_query, min(-(-tasks // n_train), rows_q // LEAST_QUERIES)), n_train


def _grid(queries: DataFrame, train: DataFrame, sizes: tuple[int, int, int], k: int, per_label: bool = False, pool: int | None = None, apart: str | None = None) -> DataFrame:
    """(query_id, train_id, label, distance, plain): at least the k nearest (of every label) of each query, or the pool
    nearest by plain code distance, from blocks of queries that meet blocks of training rows."""
    rows_q, rows_t, loci = sizes
    n_query, n_train = _blocks(queries.sparkSession, rows_q, rows_t)
    own = F.col(apart) if apart else F.lit(0)
    q = queries.select(F.col("id").alias("i"), F.col("alleles").alias("x"), own.alias("o"), F.pmod(F.xxhash64("id"), F.lit(n_query)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_train - 1))).alias("tb"))
    t = train.select(F.col("id").alias("i"), F.col("alleles").alias("x"), "label", own.alias("o"), F.pmod(F.xxhash64("id"), F.lit(n_train)).cast("int").alias("tb"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"))
    keep = pool or k

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "train_id": [], "label": [], "distance": [], "plain": []}
        if left.num_rows and right.num_rows:
            order = np.argsort(right.column("i").to_numpy())
            x, ids = matrix(right.column("x"), loci)[order], right.column("i").to_numpy()[order]
            labels = np.array(right.column("label").to_pylist(), dtype=object)[order]
            y, mine = matrix(left.column("x"), loci), left.column("i").to_numpy()
            sides = (left.column("o").to_numpy(), right.column("o").to_numpy()[order]) if apart else None
            groups = [np.flatnonzero(labels == v) for v in sorted(set(labels.tolist()))] if per_label else [np.arange(len(ids))]
            for g in groups if not pool else []:
                rows, cols, d = k_nearest(y, x[g], k, sides and (sides[0], sides[1][g]))
                cols = g[cols]
                for c, v in (("query_id", mine[rows]), ("train_id", ids[cols]), ("label", labels[cols]), ("distance", d), ("plain", d)):
                    out[c].append(v)
            for at in range(0, len(y) if pool else 0, 256):
                d = block_distances(y[at : at + 256], x)
                rank = block_distances(y[at : at + 256], x, plain=True)
                for g in groups:
                    top = np.argsort(rank[:, g], axis=1, kind="stable")[:, :keep]
                    rows = np.repeat(np.arange(len(top)), top.shape[1])
                    cols = g[top.ravel()]
                    out["query_id"].append(mine[at + rows]), out["train_id"].append(ids[cols]), out["label"].append(labels[cols])
                    out["distance"].append(d[rows, cols]), out["plain"].append(rank[rows, cols])
        return pa.table({c: pa.array(np.concatenate(v) if v else [], _KINDS[c]) for c, v in out.items()})

    return q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInArrow(best, "query_id long, train_id long, label string, distance double, plain double")


_KINDS = {"query_id": pa.int64(), "train_id": pa.int64(), "label": pa.string(), "distance": pa.float64(), "plain": pa.float64()}


def _fitted(train: DataFrame, rows_t: int, loci: int) -> Cells:
    """Cells of the training rows: fitted on a sample, then on rows far from all centres so far, until one sample holds
    about all of these."""
    cells, asked = Cells(loci), train.select("i", "x")

    def strange(batches):
        for b in batches:
            yield b.filter(pa.array(cells.place(unpack(b.column("x"), loci))[2] > NEAR * loci))

    expected = rows_t
    for turn in range(ROUNDS):
        parts = max(1, -(-int(expected) // SAMPLE))
        picked = asked.where(F.pmod(F.xxhash64("i", F.lit(turn)), F.lit(parts)) == 0)
        rows = unpack((picked.mapInArrow(strange, picked.schema) if turn else picked).select("x").toArrow().column(0), loci)
        for part in (rows[: len(rows) // 3], rows[len(rows) // 3 :]):
            cells.fit(part)
        expected = parts * (cells.place(rows)[2] > NEAR * loci).sum()
        if turn and parts == 1 or not expected:
            break
    cells.tables = []
    return cells


def _parted(ids: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """A part of so many for each id."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def _spread(start: np.ndarray, copies: np.ndarray, step: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(row, group): each row so many times, its groups from start on in steps."""
    row = np.repeat(np.arange(len(start)), copies)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    return row, start[row] + nth * np.broadcast_to(step, len(start))[row]


def _batch(b: pa.RecordBatch, row: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, *map(pa.array, more.values())], names=[*b.schema.names, *more])


def _met(y: _Coded, centres: np.ndarray, near: np.ndarray, differ: np.ndarray, far: np.ndarray, limit: np.ndarray):
    """(queries, cells, least far) by tiles of queries: the cells of which a row may be within the limit of a query, without
    those it visited first (near), and the least loci by which such a row differs from the centre (or is unknown)."""
    for i, same in _alike(y, centres):
        known, bound = y.known[i : i + TILE[0]], limit[i : i + TILE[0]] + 1e-6
        met = (least_distance(known, same, differ, far) <= bound[:, None]) & (far >= 0)
        at, which = np.nonzero((near[i : i + TILE[0]] >= 0) & (near[i : i + TILE[0]] < len(centres)))
        met[at, near[i : i + TILE[0]][at, which]] = False
        r, c = np.nonzero(met)
        yield i + r, c, np.maximum(np.floor(known[r] * (1 - bound[r]) - same[r, c]), 0).astype(np.int64), same[r, c]


def _meeting(q: DataFrame, t: DataFrame, loci: int, k: int, per_label: bool, apart: bool, centres: np.ndarray, groups: int, limited: bool, each: int = 0) -> DataFrame:
    """(query_id, train_id, label, distance): k nearest (of every label; or beside the first `each` of every label) of each
    query among the training rows of its group g in the cells that are near it. Limited: among all of a group from `groups` on, and of the cells of others that are not
    near those within a query's `most`."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], _KINDS[c]) for c in ("query_id", "train_id", "label", "distance")})
        ids, of, far, differ = (right.column(c).to_numpy() for c in ("i", "cell", "far", "differ"))
        order = np.lexsort((ids, far, of))
        ids, of, far, differ, x = ids[order], of[order], far[order], differ[order], unpack(right.column("x"), loci)[order]
        text = np.array(right.column("label").to_pylist(), dtype=object)[order]
        labels = np.unique(text.astype(str), return_inverse=True)[1] if per_label or each else np.zeros(len(text), np.int64)
        y, mine, most = unpack(left.column("x"), loci), left.column("i").to_numpy(), left.column("most").to_numpy()
        sides = left.column("o").to_numpy(), right.column("o").to_numpy()[order]
        found = []

        def top_of(r: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
            return _foremost(r, labels[c], ids[c], d, k, each) if each else _first(r, labels[c], ids[c], d, k)

        def compared(q: np.ndarray, g: np.ndarray, centre: np.ndarray | None) -> None:
            g = g[np.argsort(ids[g])]
            for part in [g] if each else (g[labels[g] == v] for v in np.unique(labels[g])):
                rows, cols, d = k_nearest(y[q], x[part], k, (sides[0][q], sides[1][part]) if apart else None, most[q] if limited else None, centre, labels[part], each)
                found.append((q[rows], part[cols], d))

        if limited and left.column("g")[0].as_py() >= groups:
            compared(np.arange(len(y)), np.arange(len(x)), None)
        else:
            held, start = np.unique(of, return_index=True)
            end = np.append(start[1:], len(of))
            near = left.column("near").combine_chunks().flatten().to_numpy().reshape(len(y), -1)
            at = np.minimum(np.searchsorted(held, near), len(held) - 1)
            near = np.where(held[at] == near, at, -1)  # places among the cells of this group
            coded, here = _Coded(y, 0), _Coded(x, 255)
            if limited:
                entries = _met(coded, centres[held], near, np.maximum.reduceat(differ, start), far[end - 1], most)
            else:
                whose, which = np.nonzero(near >= 0)
                cell = near[whose, which]
                entries = [(whose, cell, np.zeros(len(whose), np.int64), np.zeros(len(whose)))]
            large, later, sketch = end - start > SMALL, [], None
            if not limited:  # all pairs of these are compared
                large |= (end - start) * np.bincount(entries[0][1], minlength=len(held)) > PAIRS
            for whose, cell, least, same in entries:
                lo = np.searchsorted(of * (loci + 1) + far, held[cell] * (loci + 1) + least)
                big, tiny = (np.flatnonzero((lo < end[cell]) & (large[cell] == v)) for v in (True, False))
                later.append((whose[big], cell[big], lo[big]))
                whose, cell, lo, same = whose[tiny], cell[tiny], lo[tiny], same[tiny]
                ends = np.cumsum(end[cell] - lo)
                for own in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(ends // 500_000)) + 1):
                    at, c = _spread(lo[own], end[cell[own]] - lo[own], 1)
                    r, alike = whose[own[at]], same[own[at]]
                    some = np.ones(len(r), bool)
                    if limited:
                        apart_by = np.maximum(coded.known[r] - alike - far[c], 0)
                        some = apart_by <= (most[r] + 1e-6) * np.maximum(apart_by + alike + differ[c], 1)
                    if apart:
                        some &= sides[0][r] != sides[1][c]
                    r, c = r[some], c[some]
                    if limited and sketch is None and len(r):
                        sketch = [np.ascontiguousarray(v.planes().transpose(2, 0, 1)) for v in (coded, here)]
                    r, c, d = _within(coded, here, r, c, _same_pairs(*sketch, coded.known, r, c) if sketch else np.full(len(r), np.inf), most)
                    top = top_of(r, c, d)
                    found.append((r[top], c[top], d[top]))
            whose, cell, lo = map(np.concatenate, zip(*later))
            step = (lo - start[cell]) * 8 // np.maximum(end[cell] - start[cell], 1)
            turn = np.lexsort((step, cell))
            for own in np.split(turn, np.flatnonzero(np.diff(cell[turn]) | np.diff(step[turn])) + 1) if len(turn) else []:
                compared(np.sort(whose[own]), np.arange(lo[own].min(), end[cell[own[0]]]), centres[held[cell[own[0]]]])
        r, c, d = map(np.concatenate, zip(*found))
        top = top_of(r, c, d)
        r, c, d = r[top], c[top], d[top]
        return pa.table({"query_id": mine[r], "train_id": ids[c], "label": pa.array(text[c], pa.string()), "distance": d})

    return q.groupBy("g").cogroup(t.groupBy("g")).applyInArrow(best, "query_id long, train_id long, label string, distance double")


def _by_cells(queries: DataFrame, train: DataFrame, sizes: tuple[int, int, int], k: int, apart: str | None = None, named: DataFrame | None = None, each: int = 0, guess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, train_id, label, distance): at least the k nearest of each query.

    A query first meets the cells whose centres are most like it, of which the k nearest bound its k-th distance. Then it
    meets the rows in no cell and those of all other cells that, by how far both are from the centre, may be within that
    bound. Queries with a bound that tells little meet all rows. With named (query_id, prediction) these are at least the
    rows within the median of the k nearest (k odd) of the named label and of the nearest other one, of all labels.
    With guess, (query_id, prediction) from k nearest, these are, beside the k nearest, the rows within the distance of the
    `each`-th of the label it names and of that of the nearest other one, ranked (rank, among their label own); a query for
    which the rows inside name another label than all do is asked again where its bound falls short.
    """
    rows_q, rows_t, loci = sizes
    spark, own = queries.sparkSession, F.col(apart) if apart else F.lit(0)

    def packed(batches):
        for b in batches:
            yield b.set_column(1, "x", pack(matrix(b.column("x"), loci)))

    t = train.select(F.col("id").alias("i"), F.col("alleles").alias("x"), own.cast("long").alias("o"), "label")
    t = cut(t.mapInArrow(packed, "i long, x binary, o long, label string"))
    cells = _fitted(t, rows_t, loci)
    centres = cells.centres

    def placed(batches):
        for b in batches:
            cell, differ, far = cells.place(unpack(b.column("x"), loci))
            yield _batch(b, np.arange(len(cell)), cell=cell, differ=differ, far=far)

    def like(batches):
        for b in batches:
            x = matrix(b.column("x"), loci)
            near, some = np.full((len(x), VISITS), -1, np.int32), min(VISITS, len(centres))
            for i, same in _alike(_Coded(x, 0), centres) if some else ():
                near[i : i + TILE[0], :some] = np.argpartition(same, -some, axis=1)[:, -some:]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * VISITS), pa.array(near.ravel()))
            yield pa.RecordBatch.from_pydict({"i": b.column("i"), "x": pack(x), "o": b.column("o"), "near": lists})

    q = queries.select(F.col("id").alias("i"), F.col("alleles").alias("x"), own.cast("long").alias("o"))
    q = cut(q.mapInArrow(like, "i long, x binary, o long, near array<int>"))
    t = t.mapInArrow(placed, "i long, x binary, o long, label string, cell int, differ int, far int")
    got = t.groupBy("cell").agg(F.count(F.lit(1)), F.max("differ"), F.max("far")).toArrow()
    n, differ, far = np.zeros(len(centres) + 1, np.int64), *np.full((2, len(centres) + 1), -1, np.int64)
    for v, c in zip((n, differ, far), got.columns[1:]):
        v[got.column(0).to_numpy()] = c.to_numpy()  # the last is for none
    n, differ, far, none = n[:-1], differ[:-1], far[:-1], int(n[-1])
    # large cells have groups of their own, small ones share some
    n_train, n_query = np.maximum(1, -(-n // CELL_BLOCK[1])), np.maximum(1, -(-n * rows_q // (max(1, rows_t) * CELL_BLOCK[0])))
    large = n > CELL_BLOCK[1] // 8
    shared = np.cumsum(np.where(large, 0, n + 1)) // (CELL_BLOCK[1] // 4)
    n_train, n_query = np.where(large, n_train, 1), np.where(large, n_query, 1)
    copies = np.where(large, n_train * n_query, 0)
    first = np.where(large, shared.max(initial=0) + 1 + np.cumsum(copies) - copies, shared)
    groups = int(max(shared.max(initial=0) + 1, (first + copies).max(initial=0)))

    def sent(b, row, cell):
        """A copy of a row for each group in which it meets one of its cells."""
        ids = b.column("i").to_numpy()
        at, g = _spread(first[cell] + _parted(ids[row], n_query[cell]) * n_train[cell], n_train[cell], 1)
        pair = np.unique(row[at] * groups + g)
        return _batch(b, pair // groups, g=pair % groups)

    def train_rows(batches):
        for b in batches:
            cell, ids = b.column("cell").to_numpy(), b.column("i").to_numpy()
            row, g = _spread(first[cell] + _parted(ids, n_train[cell]), n_query[cell], n_train[cell])
            yield _batch(b, row, g=g)

    def query_rows(batches):
        for b in batches:
            near = b.column("near").flatten().to_numpy()
            row = np.arange(len(near)) // VISITS
            some = (near >= 0) & (n[near] > 0 if len(n) else False)
            yield sent(b, row[some], near[some])

    of_q, of_t = "i long, x binary, o long, near array<int>, most double, g long", "i long, x binary, o long, label string, cell int, differ int, far int, g long"

    def further(q: DataFrame, rows_q: int, inside: DataFrame, kth: DataFrame) -> DataFrame:
        """The rows within the bound (i, most) of each query q, of which those inside are known; without one all rows."""
        near_q = kth.where(F.col("most") <= COARSE)
        sure = near_q.count()
        # groups after those of cells: sure queries by rows in no cell, then the others by all rows
        blocks = [_blocks(spark, a, b) for a, b in ((sure, none), (rows_q - sure, rows_t))]
        start = groups, groups + blocks[0][0] * blocks[0][1]

        def others(batches):
            for b in batches:
                cell, ids = b.column("cell").to_numpy(), b.column("i").to_numpy()
                which = np.flatnonzero(cell >= 0)
                row, g = _spread(first[cell[which]] + _parted(ids[which], n_train[cell[which]]), n_query[cell[which]], n_train[cell[which]])
                yield _batch(b, which[row], g=g)
                for at, which in enumerate((np.flatnonzero(cell < 0), np.arange(len(ids)) if sure < rows_q else [])):
                    if len(which):
                        row, g = _spread(start[at] + _parted(ids[which], blocks[at][1]), np.full(len(which), blocks[at][0]), blocks[at][1])
                        yield _batch(b, which[row], g=g)

        def asking(batches):
            for b in batches:
                ids, most = b.column("i").to_numpy(), b.column("most").to_numpy()
                close, far_off = np.flatnonzero(most <= COARSE), np.flatnonzero(most > COARSE)
                for at, which in enumerate((close if none else close[:0], far_off)):
                    row, g = _spread(start[at] + _parted(ids[which], blocks[at][0]) * blocks[at][1], np.full(len(which), blocks[at][1]), 1)
                    yield _batch(b, which[row], g=g)
                near = b.column("near").flatten().to_numpy().reshape(-1, VISITS)[close]
                for row, cell, *_ in _met(_Coded(unpack(b.column("x"), loci)[close], 0), centres, near, differ, far, most[close]):
                    yield sent(b, close[row], cell)

        asked = q.join(kth, "i", "left").select("i", "x", "o", "near", F.coalesce("most", F.lit(1.0)).alias("most"))
        outside = _meeting(asked.mapInArrow(asking, of_q), t.mapInArrow(others, of_t), loci, k, named is not None, bool(apart), centres, groups, True, each)
        found = inside.join(near_q.select(F.col("i").alias("query_id")), "query_id", "left_semi")  # the others meet their rows again
        return found.select("query_id", "train_id", "label", "distance").unionByName(outside)

    inside = _meeting(q.withColumn("most", F.lit(1.0)).mapInArrow(query_rows, of_q), t.where("cell >= 0").mapInArrow(train_rows, of_t), loci, k, named is not None, bool(apart), centres, groups, False, each)
    by = ["query_id"] if named is None else ["query_id", "label"]
    w = Window.partitionBy(*by)

    def ranked(found: DataFrame) -> DataFrame:
        got = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "train_id")))
        got = got.withColumn("own", F.row_number().over(Window.partitionBy("query_id", "label").orderBy("distance", "train_id")))
        return got.where((F.col("rank") <= k) | (F.col("own") <= each))

    def wanted(found: DataFrame) -> DataFrame:
        """(i, most): the largest of the k-th distance, that of the label named and that of the nearest other one."""
        joined = found.join(guess(found.where(F.col("rank") <= k)).select("query_id", "prediction"), "query_id")
        mine, reached = F.col("label") == F.col("prediction"), F.col("own") == each
        got = joined.groupBy(F.col("query_id").alias("i")).agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("c"), F.max(F.when(mine & reached, F.col("distance"))).alias("a"), F.min(F.when(~mine & reached, F.col("distance"))).alias("b"))
        return got.select("i", F.when(F.expr("a is not null and b is not null and c is not null"), F.greatest("a", "b", "c")).otherwise(1.0).alias("most"))

    if each:
        inside = cut(ranked(inside))
        bounds = cut(wanted(inside))
        found = cut(ranked(further(q, rows_q, inside, bounds)))
        short = cut(wanted(found).join(bounds.withColumnRenamed("most", "had"), "i").where("most > had").drop("had"))
        n_short = short.count()
        if not n_short:
            return found
        again = ranked(further(q.join(short, "i", "left_semi"), n_short, inside, short))
        return cut(found.join(short.select(F.col("i").alias("query_id")), "query_id", "left_anti").unionByName(again))
    inside = inside.withColumn("rank", F.row_number().over(w.orderBy("distance", "train_id"))).where(F.col("rank") <= k)
    inside = cut(inside.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("last", F.max("distance").over(w)))
    kth = inside.where((F.col("rank") == 1) & (F.col("n") == k))
    if named is not None:
        mine, kth = F.col("label") == F.col("prediction"), inside.where(F.col("rank") == (k + 1) // 2).withColumn("last", F.col("distance"))
        kth = kth.join(named.select("query_id", "prediction"), "query_id").groupBy("query_id").agg(F.max(F.when(mine, F.col("last"))).alias("a"), F.min(F.when(~mine, F.col("last"))).alias("b"))
        kth = kth.where("a is not null and b is not null").withColumn("last", F.greatest("a", "b"))
    kth = cut(kth.select(F.col("query_id").alias("i"), F.col("last").alias("most")))
    return cut(further(q, rows_q, inside, kth))


def nearest(queries: DataFrame, train: DataFrame, k: int, per_label: bool = False, pool: int | None = None, min_dist: float = 5e-5, apart: str | None = None) -> DataFrame:
    """(query_id, train_id, label, distance, rank): the k nearest training profiles of every query, exact.

    queries(id, alleles), train(id, alleles, label); ties by the smaller train id. Large tables are compared cell by
    cell; queries of which another cell may hold a nearer row meet all rows, as do all in small tables or with
    per_label (k of every label). With `pool`, candidates are first the pool nearest by plain code distance, as a
    two-phase index would give them. With `apart`, a column of both, rows of the same value of it do not meet.
    Distances are at least min_dist; a null or short array counts as missing loci.
    """
    (rows_t, loci_t), (rows_q, loci_q) = extent(train, "alleles"), extent(queries, "alleles")
    sizes = rows_q, rows_t, max(1, loci_t, loci_q)
    direct = per_label or pool or rows_q * rows_t <= DIRECT
    found = _grid(queries, train, sizes, k, per_label, pool, apart) if direct else _by_cells(queries, train, sizes, k, apart)
    by = ["query_id", "label"] if per_label else ["query_id"]
    if pool:
        found = found.withColumn("p", F.row_number().over(Window.partitionBy(*by).orderBy("plain", "train_id"))).where(F.col("p") <= pool)
    w = Window.partitionBy(*by).orderBy("distance", "train_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "train_id", "label", F.round(F.greatest(F.col("distance"), F.lit(min_dist)), 9).alias("distance"), "rank")


def nearest_of_labels(queries: DataFrame, train: DataFrame, named: DataFrame, k: int, min_dist: float = 5e-5) -> DataFrame:
    """(query_id, label, distance): k distances of each query to labels with so many rows (all of others), in which the named
    label of (query_id, prediction) and the nearest other one by the median have theirs as among the k nearest; k is odd.

    Of labels that cannot be the nearest, distances above those are written as 1.
    """
    if k % 2 == 0:
        raise ValueError(f"an odd k is needed, not {k}")
    (rows_t, loci_t), (rows_q, loci_q) = extent(train, "alleles"), extent(queries, "alleles")
    if rows_q * rows_t <= DIRECT:
        return nearest(queries, train, k, per_label=True, min_dist=min_dist).select("query_id", "label", "distance")
    rare = [r.label for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k).collect()]  # labels are few
    found = _by_cells(queries, train.where(~F.col("label").isin(rare)), (rows_q, rows_t, max(1, loci_t, loci_q)), k, named=named)
    w = Window.partitionBy("query_id", "label").orderBy("distance", "train_id")
    held = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).groupBy("query_id", "label").agg(F.collect_list("distance").alias("ds"))
    filled = F.concat("ds", F.array_repeat(F.lit(1.0), F.lit(k) - F.size("ds")))
    got = held.select("query_id", "label", F.explode(filled).alias("d")).select("query_id", "label", F.round(F.greatest("d", F.lit(min_dist)), 9).alias("distance"))
    if rare:  # of these all rows count
        got = got.unionByName(nearest(queries, train.where(F.col("label").isin(rare)), k, per_label=True, min_dist=min_dist).select("query_id", "label", "distance"))
    return got


def nearest_and_labels(queries: DataFrame, train: DataFrame, k: int, k_label: int, guess: Callable[[DataFrame], DataFrame], min_dist: float = 5e-5) -> tuple[DataFrame, DataFrame]:
    """(query_id, label, distance) with the distances of which the median is that of the k_label (odd) nearest of a label,
    for the label that guess names, (query_id, prediction) from the k nearest, and the nearest other one; and the k nearest
    as nearest gives them. One search; labels that cannot be the nearest may be left out."""
    if k_label % 2 == 0:
        raise ValueError(f"an odd k_label is needed, not {k_label}")
    (rows_t, loci_t), (rows_q, loci_q) = extent(train, "alleles"), extent(queries, "alleles")
    w, within = Window.partitionBy("query_id").orderBy("distance", "train_id"), F.round(F.greatest(F.col("distance"), F.lit(min_dist)), 9).alias("distance")
    if rows_q * rows_t <= DIRECT:
        per = cut(nearest(queries, train, max(k, k_label), per_label=True, min_dist=min_dist))
        return per.where(F.col("rank") <= k_label).select("query_id", "label", "distance"), per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    sizes, each = (rows_q, rows_t, max(1, loci_t, loci_q)), (k_label + 1) // 2
    rare = [r.label for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k_label).collect()]  # labels are few

    def guessed(found: DataFrame) -> DataFrame:
        return guess(found.select("query_id", "train_id", "label", within, "rank"))

    found = _by_cells(queries, train.where(~F.col("label").isin(rare)), sizes, k, each=each, guess=guessed)
    per = found.where(F.col("own") == each).select("query_id", "label", within)
    near = found.where(F.col("rank") <= k).select("query_id", "train_id", "label", "distance")
    if rare:  # of these all rows count
        few = cut(_grid(queries, train.where(F.col("label").isin(rare)), sizes, k_label, per_label=True))
        per = per.unionByName(few.select("query_id", "label", within))
        near = near.unionByName(few.select("query_id", "train_id", "label", "distance"))
    near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return per, near.select("query_id", "train_id", "label", within, "rank")


def class_weights(train: DataFrame, gamma: float = 2.5) -> DataFrame:
    """(label, n, weight): (n / (smallest n + 1)) ** (-1 / gamma)."""
    n = train.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    least = F.broadcast(n.agg(F.min("n").alias("least")))
    return n.crossJoin(least).select("label", "n", F.round(F.pow(F.col("n") / (F.col("least") + 1), F.lit(-1 / gamma)), 6).alias("weight"))


def probabilities(near: DataFrame, weights: DataFrame, min_dist: float = 5e-5, delta: float = 1.0, voting: str = "distance", method: str = "softmax") -> DataFrame:
    """(query_id, label, proba) for every class, from class-weighted votes.

    voting: distance (the nearest votes 1, the j-th (d_k - d_j) / (d_k - d_1 + min_dist)), inverse (2 / distance) or
    uniform (1). method: softmax of the sums of the votes times the class weight, or softmin of the means of the inverse
    votes over the class weight (a vote counts as at least min_dist there).
    """
    w = Window.partitionBy("query_id")
    first, last, d = F.min("distance").over(w), F.max("distance").over(w), F.col("distance")
    votes = {"distance": F.when(F.col("rank") == 1, 1.0).otherwise((last - d) / (last - first + min_dist)), "inverse": 2 / d, "uniform": F.lit(1.0)}
    if voting not in votes or method not in ("softmax", "softmin"):
        raise ValueError(f"unknown voting {voting} or method {method}")
    voted = near.withColumn("w", votes[voting]).withColumn("k", F.count(F.lit(1)).over(w))
    if method == "softmin":
        voted = voted.withColumn("w", -1 / F.greatest("w", F.lit(min_dist)) / F.col("k"))
    sums = voted.groupBy("query_id", "label").agg(F.sum("w").alias("w"))
    grid = near.select("query_id").distinct().crossJoin(F.broadcast(weights.select("label", "weight")))  # classes are few
    weight = F.col("weight") if method == "softmax" else 1 / F.col("weight")
    scored = grid.join(sums, ["query_id", "label"], "left").withColumn("z", delta * weight * F.coalesce("w", F.lit(0.0)))
    shifted = scored.withColumn("e", F.exp(F.col("z") - F.max("z").over(w)))
    return shifted.select("query_id", "label", F.round(F.col("e") / F.sum("e").over(w), 6).alias("proba"))


def named_probabilities(proba: DataFrame, classes: list[str]) -> DataFrame:
    """(query_id, p_<class> ...): one column a class."""
    return proba.groupBy("query_id").agg(*[F.max(F.when(F.col("label") == c, F.col("proba"))).alias(f"p_{c}") for c in classes])


def predictions(proba: DataFrame) -> DataFrame:
    """(query_id, prediction, proba): the most probable class, ties by the smaller label."""
    w = Window.partitionBy("query_id").orderBy(F.desc("proba"), "label")
    return proba.withColumn("r", F.row_number().over(w)).where("r = 1").select("query_id", F.col("label").alias("prediction"), "proba")


def distance_ratio(per_label: DataFrame, own_class: DataFrame, mean: bool = False) -> DataFrame:
    """(query_id, prediction, own, other, ratio): distance to the named class of (query_id, prediction), to the nearest
    other one and their ratio; a class's distance is the median (or mean) of the listed neighbours."""
    d = per_label.groupBy("query_id", "label").agg((F.avg("distance") if mean else F.median("distance")).alias("d"))
    j = d.join(own_class.select("query_id", "prediction"), "query_id")
    got = j.groupBy("query_id", "prediction").agg(F.min(F.when(F.col("label") == F.col("prediction"), F.col("d"))).alias("own"), F.min(F.when(F.col("label") != F.col("prediction"), F.col("d"))).alias("other"))
    return got.withColumn("ratio", F.col("other") / (F.col("own") + 1e-7))


def ratio_statistics(per_label: DataFrame, truth: DataFrame) -> DataFrame:
    """(label, n, mean_ratio, sd_ratio, skewness): median, population deviation and skewness of the distance ratios of
    labelled rows (query_id, label) by class; distances are means over the listed neighbours."""
    ratios = distance_ratio(per_label, truth.select("query_id", F.col("label").alias("prediction")), mean=True)
    return ratios.where("ratio is not null").groupBy(F.col("prediction").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.median("ratio").alias("mean_ratio"), F.stddev_pop("ratio").alias("sd_ratio"), F.coalesce(F.skewness("ratio"), F.lit(0.0)).alias("skewness"))


def trust(per_label: DataFrame, predicted: DataFrame, beta: float = 2.0, mean: bool = False, statistics: DataFrame | None = None) -> DataFrame:
    """(query_id, trust): sigmoid of beta (ratio - 1), the ratio of the distance to the nearest other class and to the
    predicted one. With the ratio_statistics of the classes it is the normal distribution of the standardised ratio
    plus the class's skewness, times beta; null for a class without statistics or deviation."""
    got = distance_ratio(per_label, predicted, mean)
    if statistics is None:
        return got.select("query_id", F.round(1 / (1 + F.exp(-beta * (F.col("ratio") - 1))), 6).alias("trust"))
    joined = got.join(F.broadcast(statistics.withColumnRenamed("label", "prediction")), "prediction", "left")  # a row a class
    z = beta * (F.try_divide(F.col("ratio") - F.col("mean_ratio"), F.col("sd_ratio")) + F.col("skewness"))
    return joined.select("query_id", F.round(1 - normal_tail(z), 6).alias("trust"))


def confusion(labelled: DataFrame) -> DataFrame:
    """(label, prediction, n, recall) of rows (label, prediction)."""
    n = labelled.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("recall", F.when(F.col("label") == F.col("prediction"), F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 6)))


def cross_validated(train: DataFrame, k: int, n_folds: int, seed: int) -> DataFrame:
    """(id, fold, label, prediction): each fold is predicted from the others, by one search in which no rows of the same
    fold meet."""
    placed = cut(folds(train.where("label is not null"), "id", "label", n_folds, seed))
    ranked = nearest(placed, placed, k, apart="fold")
    guessed = predictions(probabilities(ranked, class_weights(placed)))
    return placed.join(guessed, placed.id == guessed.query_id).select("id", "fold", "label", "prediction")


def trust_histogram(scored: DataFrame, bins: int = 15) -> DataFrame:
    """(bin, n, accuracy): rows (trust, correct) in equal bins from the smallest to the largest trust."""
    span = F.broadcast(scored.agg(F.min("trust").alias("lo"), F.max("trust").alias("hi")))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("trust") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return scored.crossJoin(span).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def results(near: DataFrame, proba: DataFrame, trusted: DataFrame, truth: DataFrame, names: DataFrame) -> DataFrame:
    """One row for each query: label, prediction, trust, its neighbours' ids, names, labels and distances in order,
    and the probability of every class as a map. names(id, name) holds the training profiles' names."""
    named = near.join(names.select(F.col("id").alias("train_id"), "name"), "train_id", "left")
    lists = named.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "train_id", "name", "label", "distance"))).alias("n"))
    maps = proba.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", F.round("proba", 3))))).alias("probabilities"))
    joined = truth.join(predictions(proba), "query_id").join(trusted, "query_id", "left").join(lists, "query_id").join(maps, "query_id")
    return joined.select("query_id", "label", "prediction", "trust", "n.train_id", F.col("n.name").alias("neighbour_names"), F.col("n.label").alias("neighbour_labels"), F.col("n.distance").alias("distances"), "probabilities")


def dense_enough(near: DataFrame, alpha: float) -> DataFrame:
    """(query_id, radius) of the points whose farthest listed neighbour lies within the (1 - alpha) percentile."""
    radius = near.groupBy("query_id").agg(F.max("distance").alias("radius"))
    limit = F.broadcast(radius.agg(F.percentile("radius", 1 - alpha).alias("limit")))
    return radius.crossJoin(limit).where(F.col("radius") <= F.col("limit")).drop("limit")
