"""Exact top-k inner products by the threshold algorithm.

Each lane of candidates holds one sorted list a dimension.  A query goes down the
lists whose next stretch lowers its bound most, from the end that its sign favours,
scores each vector that it meets for the first time, and stops once the best score
that an unmet vector could have is below its kth score.  The lanes' results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import best, by_tile, grid, search, usable

BAND_ROWS, LANE_ROWS = 1024, 16384
#: Entries of a list that a round goes down at first, and so many times more each round; lists a round.
FIRST_STRETCH, GROWTH, LISTS_AT_ONCE = 16, 2.0, 8


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(64 * x) of each component as integers: 64 bits, or Python's where those don't hold them."""
    if np.abs(vectors).max(initial=0) < 2.0**56:
        return np.floor(64 * vectors).astype(np.int64)
    one = np.frompyfunc(lambda x: int(x) * 64 if abs(x) >= 2.0**53 else int(np.floor(64 * x)), 1, 1)
    return one(vectors)  # doubles of 2**53 and more are whole themselves


class Lists:
    """A lane's vectors, ordered by id, with the sorted list of each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.rising = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(self.rows.T, self.rising, axis=1)
        self.top = int(np.abs(self.rows).max(initial=0))
        self.as_kind: dict[type, np.ndarray] = {}

    def typed(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, list values and the query in the smallest kind of number in which every sum is exact."""
        most = len(query) * self.top * int(np.abs(query).max(initial=0))
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        if kind not in self.as_kind:
            self.as_kind[kind] = self.rows.astype(kind)
        return self.as_kind[kind], self.values if kind is not object else self.values.astype(object), query.astype(kind)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and scores of the k best other vectors, and how many were scored."""
        n = len(self.ids)
        met = self.ids == query_id  # the query's own row is never a candidate
        live = np.flatnonzero(query != 0)
        if not len(live):  # all candidates tie at zero
            at = np.flatnonzero(~met)[:k]
            return at, np.zeros(len(at), np.int64), len(at)
        rows, values, typed = self.typed(query)
        weights = query[live].astype(values.dtype)
        falling = weights > 0

        def gain(lists: np.ndarray, depth: np.ndarray) -> np.ndarray:
            """What the entries at ``depth`` add to a score: the most that entries from there on can add."""
            return weights[lists] * values[live[lists], np.where(falling[lists], n - 1 - depth, depth)]

        every = np.arange(len(live))
        depth = np.zeros(len(live), np.int64)
        now = gain(every, depth)
        at, score = np.zeros(0, np.int64), np.zeros(0, values.dtype)
        scored, stretch = 0, float(FIRST_STRETCH)
        unmet = n - int(met.sum())
        while unmet:
            step = int(stretch)
            drop = now - gain(every, np.minimum(depth + step, n - 1))
            chosen = np.lexsort((depth, -drop))[:LISTS_AT_ONCE]
            fresh = np.zeros(n, bool)
            for j in chosen.tolist():
                a, b = int(depth[j]), min(int(depth[j]) + step, n)
                fresh[self.rising[live[j], n - b : n - a] if falling[j] else self.rising[live[j], a:b]] = True
            fresh &= ~met
            new = np.flatnonzero(fresh)
            met |= fresh
            scored, unmet = scored + len(new), unmet - len(new)
            depth[chosen] += step
            if len(new):
                got = np.take(rows, new, axis=0) @ typed
                at, score = np.concatenate([at, new]), np.concatenate([score, got.astype(values.dtype)])
                if len(score) > k:
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    own = score >= least  # all that tie with the kth stay for now
                    at, score = at[own], score[own]
            if (depth >= n).any():  # a list is done, so every vector has been met
                break
            now[chosen] = gain(chosen, depth[chosen])
            if len(score) >= k and now.sum() < score.min():
                break
            stretch = min(stretch * GROWTH, float(n))
        order = np.lexsort((self.ids[at], -score))[:k]
        return at[order], score[order], scored


def _longs(query_id: int, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    if score.dtype == object and len(score) and max(map(abs, score)) >= 1 << 63:
        raise OverflowError(f"a score of query {query_id} with one of {ids.tolist()} does not fit a long")
    return score.astype(np.int64)


def _run(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def answer() -> Iterator[pa.RecordBatch]:
            if not asks or not held:
                return
            lists = Lists(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            out: tuple[list, ...] = ([], [], [], [])
            for ids, rows in asks:
                for query_id, query in zip(ids.tolist(), rows):
                    at, score, scored = lists.search(query_id, query, k)
                    for column, values in zip(out, (np.full(len(at), query_id), lists.ids[at], _longs(query_id, lists.ids[at], score), np.full(len(at), scored))):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], ["query_id", "vec_id", "score", "scored"])

        for kind, ids, rows, new in by_tile(batches):
            if new:
                yield from answer()
                asks, held = [], []
            (held if kind else asks).append((ids, whole(rows)))
        yield from answer()

    return run


def exact_top_k(embeddings: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score and scored of each query's k highest inner products.

    Components become floor(64 * x), as whole numbers of any size; a score among the
    k highest that does not fit a long is an error.  Ties go to the smaller vec_id.
    Null and non-finite vectors and null ids take no part; repeated ids are one row
    (the smallest vector); a query with fewer candidates gets all.  An empty table
    gives no rows.  ``scored`` is the number of vectors of the match's lane that the
    query scored before it stopped.
    """
    tiles = grid(usable(embeddings, nonzero=False), is_query, BAND_ROWS, LANE_ROWS)
    return best(search(tiles, _run(k), "long", "scored long"), k, F.col("score").desc())
