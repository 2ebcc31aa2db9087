"""Nearest neighbours by a block matrix join with int8 product tiles.

Query bands and candidate lanes meet in tiles.  In a tile both sides are cut to
int8 codes; their product gives each squared distance up to a bound that follows
from the norms of the quantisation errors.  Pairs that may still be among the k
nearest are recomputed in double precision and kept in one heap a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import best, by_tile, grid, search, usable

BAND_ROWS = LANE_ROWS = 4096
_STRIP = 256


class Codes:
    """Rows as int8 codes of one scale, with norms and norms of what the codes miss."""

    def __init__(self, rows: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore"):
            self._fill(rows)

    def _fill(self, rows: np.ndarray) -> None:
        largest = np.abs(rows).max(initial=0.0)
        self.scale = largest / 127 if largest > 0 else 1.0
        if not np.isfinite(self.scale) or self.scale == 0:
            self.scale = 1.0
        self.codes = np.clip(np.rint(rows / self.scale), -127, 127).astype(np.int8)
        back = self.codes.astype(np.float64) * self.scale
        self.square = (rows * rows).sum(axis=1)
        self.norm, self.near, self.miss = np.sqrt(self.square), np.sqrt((back * back).sum(axis=1)), np.sqrt(((rows - back) ** 2).sum(axis=1))


def bounds(q: Codes, c: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all squared distances of a tile.

    The int8 product is exact: its sums stay below 2**24 in single precision up
    to 1,040 dimensions, and are taken in double precision beyond.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        return _bounds(q, c)


def _bounds(q: Codes, c: Codes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.float32 if q.codes.shape[1] <= 1040 else np.float64
    product = (q.codes.astype(kind) @ c.codes.astype(kind).T).astype(np.float64) * (q.scale * c.scale)
    about = q.square[:, None] + c.square[None, :] - 2 * product
    error = 2 * (q.miss[:, None] * c.norm[None, :] + q.near[:, None] * c.miss[None, :])
    error += 1e-9 * (q.square[:, None] + c.square[None, :]) + 1e-300  # rounding of the sums themselves
    low, high = about - error, about + error
    unknown = ~np.isfinite(low) | ~np.isfinite(high)  # squares beyond a double tell nothing
    low[unknown], high[unknown] = -np.inf, np.inf
    return low, high


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows; components are summed in their order.

    Where squares leave the range of a double the differences are scaled first.
    """
    def summed(a: np.ndarray, b: np.ndarray, by: np.ndarray | float = 1.0) -> np.ndarray:
        total = np.zeros(len(a))
        for k in range(a.shape[1]):
            d = (a[:, k] - b[:, k]) / by
            total += d * d
        return np.sqrt(total)

    with np.errstate(over="ignore", invalid="ignore"):
        out = summed(a, b)
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
        if len(odd):
            most = np.abs(a[odd] - b[odd]).max(axis=1, initial=0)
            fit = (most > 0) & np.isfinite(most)
            odd, most = odd[fit], most[fit]
            out[odd] = summed(a[odd], b[odd], most) * most
    return out


def _run(k: int):
    def tile(ids: np.ndarray, queries: np.ndarray, heaps: list[list], found: np.ndarray, rows: np.ndarray) -> None:
        code = Codes(rows)
        for s in range(0, len(ids), _STRIP):
            part = queries[s : s + _STRIP]
            low, high = bounds(Codes(part), code)
            own = ids[s : s + _STRIP, None] == found[None, :]
            low[own], high[own] = np.inf, np.inf
            limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(part), np.inf)
            held = np.array([h[0][2] * h[0][2] * (1 + 1e-9) + 1e-300 if len(h) == k else np.inf for h in heaps[s : s + _STRIP]])
            i, j = np.nonzero((low <= np.minimum(limit, held)[:, None]) & ~own)
            for a in range(0, len(i), 200_000):
                ii, jj = i[a : a + 200_000], j[a : a + 200_000]
                for q, d, v in zip((ii + s).tolist(), distances(part[ii], rows[jj]).tolist(), found[jj].tolist()):
                    entry = (-d, -v, d)  # the heap's top is the farthest, of equals the one with the largest id
                    if len(heaps[q]) < k:
                        heapq.heappush(heaps[q], entry)
                    elif entry > heaps[q][0]:
                        heapq.heapreplace(heaps[q], entry)

    def out(ids: np.ndarray, heaps: list[list]) -> pa.RecordBatch:
        rows = [(q, -v, d) for q, h in zip(ids.tolist(), heaps) for _, v, d in h]
        columns = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, heaps = np.zeros(0, np.int64), None, []
        for kind, found, rows, new in by_tile(batches):
            if new:
                if len(ids):
                    yield out(ids, heaps)
                ids, queries, heaps = np.zeros(0, np.int64), None, []
            if kind == 0:
                ids = np.concatenate([ids, found])
                queries = rows if queries is None else np.concatenate([queries, rows])
                heaps += [[] for _ in found]
            elif len(ids):
                for a in range(0, len(found), LANE_ROWS):
                    tile(ids, queries, heaps, found[a : a + LANE_ROWS], rows[a : a + LANE_ROWS])
        if len(ids):
            yield out(ids, heaps)

    return run


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest other vectors.

    Score: Euclidean distance in double precision on the original vectors; the
    nearest come first, ties go to the smaller vec_id.  A distance beyond a double is
    infinite.  Null, zero and non-finite
    vectors and null ids take no part; repeated ids are one row (the smallest
    vector); a query with fewer candidates gets all.  An empty table gives none.
    """
    tiles = grid(usable(embeddings, nonzero=True), is_query, BAND_ROWS, LANE_ROWS)
    return best(search(tiles, _run(k), "double"), k, F.col("score"))
