import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import nearest, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 9) for i, v in rows], SCHEMA)


@pytest.fixture
def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 0.3, 5).astype(np.float32).tolist()) for k in range(90)]
    rows += [(200 + k, rows[0][1]) for k in range(25)]  # ties
    rows += [(300, [0.0] * 5), (301, None), (302, [1.0, None, 0, 0, 0]), (303, [float("nan")] * 5), (304, [float("inf"), 0, 0, 0, 0]), (None, rows[1][1]), (305, [])]
    rows += [(5, rows[5][1])]  # a repeated row
    rows += [(400, [0.5, 0.5]), (420, [0.25, 0.5])]  # of another length
    return rows


def small_tiles(monkeypatch):
    for module in (nearest, topk):
        monkeypatch.setattr(module, "BAND_ROWS", 4)
        monkeypatch.setattr(module, "LANE_ROWS", 16)
    monkeypatch.setattr(topk, "FIRST_STRETCH", 2)
    monkeypatch.setattr(topk, "LISTS_AT_ONCE", 2)


def brute(rows, asks, k, score, best_first, zero_out):
    good = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or (zero_out and not any(v)):
            continue
        good[i] = min(good.get(i, v), v)
    out = []
    for q in sorted(i for i in good if asks(i)):
        found = sorted(((score(good[q], v) * best_first, i) for i, v in good.items() if i != q and len(v) == len(good[q])))
        out += [(q, n + 1, i, s * best_first) for n, (s, i) in enumerate(found[:k])]
    return out


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (float(np.float32(x)) - float(np.float32(y))) ** 2
    return total**0.5


def product(a, b):
    return sum(int(np.floor(64 * float(np.float32(x)))) * int(np.floor(64 * float(np.float32(y)))) for x, y in zip(a, b))


def test_nearest_is_brute_force(spark, odd_rows, monkeypatch):
    small_tiles(monkeypatch)
    got = nearest.nearest(table(spark, odd_rows), F.col("vec_id") % 5 == 0, 10).orderBy("query_id", "rank").collect()
    want = brute(odd_rows, lambda i: i % 5 == 0, 10, distance, 1, True)
    assert [tuple(r)[:3] for r in got] == [w[:3] for w in want]
    assert np.allclose([r.score for r in got], [w[3] for w in want], rtol=1e-15, atol=0)


def test_top_k_is_brute_force(spark, odd_rows, monkeypatch):
    small_tiles(monkeypatch)
    got = topk.exact_top_k(table(spark, odd_rows), F.col("vec_id") % 5 == 0, 20).orderBy("query_id", "rank").collect()
    assert [tuple(r)[:4] for r in got] == brute(odd_rows, lambda i: i % 5 == 0, 20, product, -1, False)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nearest.nearest(empty, F.col("vec_id") % 100 == 0).count() == 0
    assert topk.exact_top_k(empty, F.col("vec_id") % 20 == 0).count() == 0
    assert vectors.usable(empty, True).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (40, 64)), rng.normal(0, 3, (50, 64))
    low, high = nearest.bounds(nearest.Codes(a), nearest.Codes(b))
    true = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()


def test_threshold_stops_early_when_it_may():
    rows = np.zeros((5000, 3), np.int64)
    rows[:30, 0] = 1000 - np.arange(30)
    _, score, scored = topk.Lists(np.arange(5000), rows).search(-1, np.array([3, 0, 0]), 5)
    assert score.tolist() == [3000 - 3 * k for k in range(5)] and scored < 200


def test_the_share_scored_falls_with_skew():
    """Where few dimensions carry the weight, few vectors are scored; in like dimensions nearly all are."""
    rng = np.random.default_rng(8)
    shares = []
    for power in (0.0, 1.0, 2.0):
        rows = np.floor(200 * rng.normal(0, 1, (4000, 16)) * (np.arange(16) + 1.0) ** -power).astype(np.int64)
        lists, seen = topk.Lists(np.arange(4000), rows), []
        for q in range(0, 4000, 200):
            at, score, scored = lists.search(q, rows[q], 10)
            scores = rows @ rows[q]
            scores[q] = -(1 << 40)
            order = np.lexsort((np.arange(4000), -scores))[:10]
            assert at.tolist() == order.tolist() and score.tolist() == scores[order].tolist()
            seen.append(scored / 4000)
        shares.append(np.mean(seen))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.2


def test_zero_and_tied_queries():
    rows = np.array([[0, 0], [1, 1], [1, 1], [-1, 5]])
    lists = topk.Lists(np.array([7, 3, 9, 1]), rows)
    at, score, _ = lists.search(7, np.array([0, 0]), 2)
    assert lists.ids[at].tolist() == [1, 3] and score.tolist() == [0, 0]
    at, score, _ = lists.search(1, np.array([1, 0]), 2)
    assert lists.ids[at].tolist() == [3, 9] and score.tolist() == [1, 1]


def test_large_components_stay_exact(spark):
    rows = [(1, [1.0, 2.0]), (2, [3e6, 1e6]), (3, [2.0**28, -(2.0**28)]), (4, [2.0**21 + 0.5, 1.0])]
    got = topk.exact_top_k(table(spark, rows), F.col("vec_id") == 2, 5).orderBy("rank").collect()
    want = sorted(((product(dict(rows)[2], v), i) for i, v in rows if i != 2), key=lambda x: (-x[0], x[1]))
    assert [(r.score, r.vec_id) for r in got] == want
    with pytest.raises(Exception, match="does not fit a long"):
        topk.exact_top_k(table(spark, [(2, [3e38, 1.0]), (5, [3e38, 1.0])]), F.col("vec_id") == 2, 5).collect()


def test_distances_of_any_size(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 3e180]), (2, [-1e200, 1e200]), (3, [1e-200, 2e-200]), (4, [1e-200, 5e-200]), (5, [1.0, 1.0]), (6, [1e308, 0.0]), (7, [-1e308, 0.0])]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(made, F.lit(True), 10).orderBy("query_id", "rank").collect()
    assert len(got) == 8 * 7
    first = {r.query_id: (r.vec_id, r.score) for r in got if r.rank == 1}
    assert first[0] == (1, 3e180) and first[3][0] == 4 and abs(first[3][1] / 3e-200 - 1) < 1e-12
    assert [r.score for r in got if r.query_id == 6 and r.vec_id == 7] == [float("inf")] and not any(np.isnan(r.score) for r in got)
