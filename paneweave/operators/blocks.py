"""The best pairs between a block of queries and a block of an index, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Queries that are compared at once.
ROWS = 128
#: Beyond what the order of a sum of doubles can change, relative to the product of the norms.
SLACK = 1e-9


def _vectors(column: pa.ChunkedArray) -> tuple[list[list | None], dict[int, np.ndarray], np.ndarray]:
    """The rows, the places of plain vectors by their length, and those of the others."""
    rows = column.to_pylist()
    plain: dict[int, list[int]] = {}
    odd = []
    for i, v in enumerate(rows):
        if v and None not in v and np.abs(np.array(v)).max() < 1e100:
            plain.setdefault(len(v), []).append(i)
        else:
            odd.append(i)
    return rows, {n: np.array(p) for n, p in plain.items()}, np.array(odd, np.int64)


def _fold(a: list | None, b: list | None) -> float | None:
    """As ``vectors.dot`` adds: null for a missing vector or value, and for other lengths."""
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def best_pairs(q: pa.ChunkedArray, e: pa.ChunkedArray, names: pa.ChunkedArray, own: pa.ChunkedArray | None, same: pa.ChunkedArray, k: int) -> tuple[list[int], list[int], list[float | None]]:
    """Places of queries and index rows, and scores: each query's ``k`` best by score (NaN first, null last), then name.

    With ``own``, pairs whose ``own`` and ``same`` are equal, or of which one is null, are left out.
    """
    asked, by_length, odd_asked = _vectors(q)
    index, known, odd = _vectors(e)
    label = names.to_pylist()
    order = sorted(range(len(label)), key=lambda i: (label[i] is not None, label[i]) if label[i] is not None else (False,))
    place = np.empty(len(label), np.int64)
    place[order] = np.arange(len(order))
    mine, theirs = (own.to_pylist(), same.to_pylist()) if own is not None else (None, None)
    of: dict = {}
    for i, s in enumerate(theirs or ()):
        of.setdefault(s, []).append(i)
    barred = lambda i: mine is not None and mine[i] is None
    left_out = lambda i: {*of.get(mine[i], ()), *of.get(None, ())} if mine is not None else set()
    out: tuple[list[int], list[int], list[float | None]] = ([], [], [])

    def keep(i: int, found: list[tuple[int, float | None]]) -> None:
        """The best of these and, if they are too few, of what has no score."""
        rank = lambda f: (f[1] is None, f[1] == f[1], -f[1] if f[1] is not None and f[1] == f[1] else 0.0, place[f[0]])
        for j, score in sorted(found, key=rank)[:k]:
            out[0].append(i)
            out[1].append(j)
            out[2].append(score)

    def slow(i: int, places) -> list[tuple[int, float | None]]:
        gone = left_out(i)
        return [(int(j), _fold(asked[i], index[j])) for j in places if j not in gone]

    for i in odd_asked:
        if not barred(i):
            keep(int(i), slow(i, range(len(index))))
    for length, rows in by_length.items():
        columns = known.get(length, np.array([], np.int64))
        b = np.array([index[j] for j in columns], np.float64).reshape(-1, length)
        norms = np.linalg.norm(b, axis=1)
        others = np.setdiff1d(np.arange(len(index)), columns)
        where = {int(j): c for c, j in enumerate(columns)}
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            a = np.array([asked[i] for i in part], np.float64)
            near = a @ b.T
            slack = SLACK * np.linalg.norm(a, axis=1) * norms.max(initial=0.0)
            for r, i in enumerate(part):
                if barred(i):
                    continue
                row = near[r]
                row[[where[j] for j in left_out(i) if j in where]] = -np.inf
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
                c = np.flatnonzero((row >= least - 2 * slack[r]) & (row > -np.inf))
                exact = np.zeros(len(c))
                for d in range(length):
                    exact += a[r, d] * b[c, d]
                c, exact = (x[np.lexsort((place[columns[c]], -exact))[:k]] for x in (c, exact))
                found = [(int(columns[j]), float(s)) for j, s in zip(c, exact, strict=True)]
                # rows of another length, or with null, NaN or endless values, are few or none
                keep(int(i), found + (slow(i, odd if len(found) >= k else others) if len(others) else []))
    return out
