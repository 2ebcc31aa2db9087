"""Replays over ranges, held to a plain fold of each page's whole log."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, replay

OPS = "doc_id string, page int, idx int, op string, args array<double>, color string"
#: Exact in any order of composition: whole numbers, axes flipped or swapped.
TURNS = [(1.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, -1.0), (0.0, 1.0, 1.0, 0.0), (0.0, -1.0, 1.0, 0.0)]


def log(rng, n, doc="d", page=1):
    out = []
    for k in range(n):
        op = rng.choices(["save", "restore", "transform", "stroke", "path", "text"], [3, 3, 4, 3, 5, 1])[0]
        args = {"transform": [*rng.choice(TURNS), float(rng.randint(-9, 9)), float(rng.randint(-9, 9))], "path": [0.0, 0.0, float(rng.randint(350, 500)), rng.choice([0.0, 0.05, 3.0])]}.get(op)
        out.append((doc, page, k, op, args, rng.choice([audit.RULE_COLOR, audit.RULE_COLOR.upper(), "#000000", None]) if op == "stroke" else None))
    return out


def plain(ops):
    """(page_y, width) of a page's rules, highest first, by one loop."""
    m, tint, stack, lines = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], "", [], []
    for _, _, _, op, a, color in sorted(ops, key=lambda x: x[2]):
        if op == "save":
            stack.append((m, tint))
        elif op == "restore" and stack:
            m, tint = stack.pop()
        elif op == "stroke":
            tint = (color or "").lower()
        elif op == "transform":
            m = [m[0] * a[0] + m[2] * a[1], m[1] * a[0] + m[3] * a[1], m[0] * a[2] + m[2] * a[3], m[1] * a[2] + m[3] * a[3], m[0] * a[4] + m[2] * a[5] + m[4], m[1] * a[4] + m[3] * a[5] + m[5]]
        elif op == "path" and tint == audit.RULE_COLOR and abs(a[2] - a[0]) >= audit.RULE_WIDTH and abs(a[3] - a[1]) <= audit.RULE_HEIGHT:
            lines.append((m[5], abs(a[2] - a[0])))
    return sorted(lines, reverse=True)


@pytest.fixture
def ranges(spark):
    """Ranges stay apart, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", range(40))
def test_effects_of_stretches_compose_to_the_fold(seed):
    rng = random.Random(seed)
    kinds = [rng.choice([replay.SAVE, replay.RESTORE, replay.RESTORE, replay.TRANSFORM, replay.STROKE]) for _ in range(rng.randint(0, 60))]
    ops = [(k, [1.0, rng.choice([0.0, 1.0]), 0.0, 1.0, float(rng.randint(-3, 3)), 2.0] if k == replay.TRANSFORM else [float(rng.randint(0, 1))] if k == replay.STROKE else []) for k in kinds]
    now, stack = replay.START, []
    for kind, args in ops:
        now = replay.stepped(now, stack, kind, args)
    cuts = sorted(rng.randint(0, len(ops)) for _ in range(5))
    other, left = replay.START, []
    for a, b in zip([0, *cuts], [*cuts, len(ops)]):
        state, saved, parts = replay.SAME, [], []
        for kind, args in ops[a:b]:
            state = replay.stepped(state, saved, kind, args, parts)
        other = replay.passed(other, left, [*parts, state], saved)
    assert other == now and left == stack


def test_a_hot_page_is_replayed_in_ranges(ranges):
    """One page of 20,000 operations beside small ones, over several ranges, twice as long a nesting as a range."""
    rng = random.Random(5)
    logs = {("d", 1): log(rng, 20_000), **{(doc, page): log(rng, rng.randint(0, 30), doc, page) for doc in ("a", "e", None) for page in (1, 2)}}
    deep = [("z", 1, k, "save" if k < 4000 else "restore" if k >= 4001 and k % 2 else "stroke" if k == 4000 else "path", [0.0, 0.0, 450.0, 0.0], audit.RULE_COLOR) for k in range(12_000)]
    deep[10] = ("z", 1, 10, "transform", [1.0, 0.0, 0.0, 1.0, 0.0, 7.0], None)
    deep[11] = ("z", 1, 11, "stroke", None, audit.RULE_COLOR)
    logs["z", 1] = deep
    rows = [x for own in logs.values() for x in own]
    rng.shuffle(rows)
    got = {}
    found = audit.ruled_lines(ranges.createDataFrame(rows, OPS))
    for r in found.orderBy("idx").collect():
        own = got.setdefault((r.doc_id, r.page), [])
        assert r.idx == len(own)
        own.append((r.page_y, r.width))
    for key, own in logs.items():
        assert got.get(key, []) == plain(own)
    assert len(got["d", 1]) > 500 and len(got["z", 1]) > 3000


def test_missing_numbers_and_no_operations(ranges):
    paths = [("d", 1, 9, "path", [0.0, 0.0, 450.0, 0.0], None), ("d", 1, 5, "path", [0.0, 0.0, 450.0], None), ("d", 1, 6, "path", None, None), ("d", 1, 7, None, None, None)]
    ops = [("d", 1, 0, "stroke", None, audit.RULE_COLOR), ("d", 1, 1, "save", None, None), ("d", 1, 2, "transform", [1.0], None), ("d", 1, 3, "path", [0.0, 0.0, 420.0, 0.0], None), ("d", 1, 8, "restore", None, None), *paths]
    assert [(r.idx, r.page_y, r.width) for r in audit.ruled_lines(ranges.createDataFrame(ops, OPS)).orderBy("idx").collect()] == [(0, 0.0, 450.0), (1, None, 420.0)]
    assert audit.ruled_lines(ranges.createDataFrame([], OPS)).count() == 0
    assert audit.ruled_lines(ranges.createDataFrame(paths, OPS)).count() == 0


def test_ranks_go_on_over_ranges(ranges):
    df = ranges.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 700 == 1, F.lit(None).cast("string")).otherwise(F.lit("big")).alias("key"), F.col("id").alias("v"), F.lit(1).alias("_n"))
    rows = replay.ranked(df, ["key"], [F.desc("v")], "place").collect()
    for key in ("hot", "big", None):
        own = sorted((r for r in rows if r.key == key), key=lambda r: -r.v)
        assert [r.place for r in own] == list(range(len(own))) and own
