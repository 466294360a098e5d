"""Cells of near profiles: centres fitted on a sample, and a bound from below for the distance to all rows of a cell."""

from __future__ import annotations

import numpy as np

#: Draws of three loci by which a row finds its centre, and least share of a row's known loci that agree with it.
DRAWS, ALIKE = 32, 0.4
#: Largest share of the loci in which a row of a cell is unknown or differs from the centre; others are in no cell.
REACH = 0.6


class Cells:
    """Centres of cells. Where a row belongs decides only which rows are compared first, never the result."""

    def __init__(self, loci: int):
        self.centres = np.zeros((0, loci), np.int16)
        self.picks = np.random.default_rng(0).integers(0, max(1, loci), (DRAWS, 3))
        self.tables: list[dict[int, int]] = [{} for _ in range(DRAWS)]
        self.sorted: list[tuple[np.ndarray, np.ndarray]] = []

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        """A number for the alleles of each draw of loci (row by draw), -1 where one is missing."""
        a = rows[:, self.picks].astype(np.int64)
        return np.where((a > 0).all(2), a[:, :, 0] << 32 | a[:, :, 1] << 16 | a[:, :, 2], -1)

    def fit(self, rows: np.ndarray) -> None:
        """Add centres for the rows that are like no centre: each joins one of them or founds its own, and three or more
        that joined make a centre of the most frequent allele of each locus."""
        rows = rows[(rows > 0).sum(1) >= 0.5 * rows.shape[1]]
        keys, known, first = self._keys(rows).tolist(), (rows > 0).sum(1), len(self.centres)
        centres, joined, n = np.concatenate([self.centres, rows]), [], first
        for row, own, k in zip(rows, keys, known):
            tried = np.array(sorted({t[v] for t, v in zip(self.tables, own) if v in t}), np.int64)
            same = (centres[tried] == row).sum(1) if len(tried) else np.zeros(1)
            if same.max() > ALIKE * k:
                joined.append(int(tried[same.argmax()]))
                continue
            centres[n] = row
            joined.append(n)
            for t, v in zip(self.tables, own):
                if v >= 0:
                    t.setdefault(v, n)
            n += 1
        joined = np.array(joined, np.int64)
        order, made = np.argsort(joined, kind="stable"), []
        for members in np.split(order, np.flatnonzero(np.diff(joined[order])) + 1) if len(order) else []:
            if joined[members[0]] >= first and len(members) > 2:
                part = rows[members[:256]]
                votes = np.stack([(part == r).sum(0) for r in part[:32]]) * (part[:32] > 0)  # of the alleles of the first rows the most frequent
                made.append(part[votes.argmax(0), np.arange(part.shape[1])])
        self.centres = np.concatenate([self.centres, np.array(made, np.int16).reshape(-1, rows.shape[1])])
        self.tables = [{} for _ in range(DRAWS)]
        for at, own in enumerate(self._keys(self.centres).tolist()):
            for t, v in zip(self.tables, own):
                if v >= 0:
                    t.setdefault(v, at)
        self.sorted = []
        for t in self.tables:
            k = np.array(sorted(t), np.int64)
            self.sorted.append((k, np.array([t[v] for v in k.tolist()], np.int32)))

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, known loci that differ from its centre, the same and unknown ones) of each row; cell -1 for none."""
        cell, differ = np.full(len(rows), -1, np.int32), np.zeros(len(rows), np.int32)
        apart = np.full(len(rows), rows.shape[1], np.int32)
        for i in range(0, len(rows) if len(self.centres) else 0, 2048):
            part = rows[i : i + 2048]
            keys = self._keys(part)
            owner = np.full(keys.shape, -1, np.int32)
            for t, (known, of) in enumerate(self.sorted):
                if len(known):
                    at = np.minimum(np.searchsorted(known, keys[:, t]), len(known) - 1)
                    owner[:, t] = np.where(known[at] == keys[:, t], of[at], -1)
            votes = (owner[:, :, None] == owner[:, None, :]).sum(2, dtype=np.uint8) * (owner >= 0)
            best = owner[np.arange(len(part)), votes.argmax(1)]
            there = part > 0
            same = ((self.centres[best] == part) & there).sum(1)
            far = part.shape[1] - same
            good = (best >= 0) & (far <= REACH * part.shape[1])
            cell[i : i + 2048], differ[i : i + 2048], apart[i : i + 2048] = np.where(good, best, -1), there.sum(1) - same, far
        return cell, differ, apart


def least_distance(known: np.ndarray, same: np.ndarray, differ: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Bound from below of the distances of queries (rows: known loci, and loci at most the same as each centre) to all
    rows of cells (columns: most loci that differ from the centre, and that do or are unknown).

    Of the loci where a query differs from the centre all but `apart` hold the centre's allele in a row, so they differ;
    the others known in both are at most those that agree with the centre and those where the row differs from it."""
    y = np.maximum(known[:, None] - same - apart[None, :], 0).astype(np.float32)
    return y / np.maximum(y + same + differ[None, :], 1)
