"""Drawing operations replayed over ranges of a log, side by side.

A page's state is its matrix and whether the rule's colour is set; save and restore
keep a stack of states.  A stretch of operations is known by its effect alone: what
it does to the state between the restores that reach below its start, and what it
leaves saved.  Effects compose, so no task holds a whole log.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import settle

#: Kinds of operations, in the order in which equal ``idx`` are replayed; ENTRY carries a stretch's state before it.
ENTRY, PATH, RESTORE, SAVE, STROKE, TRANSFORM = range(6)
#: Matrix of six numbers and tint: 1 the rule's colour, 0 another, -1 (of effects) as before.
SAME = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0)
START = (*SAME[:6], 0.0)


def then(p: tuple, q: tuple) -> tuple:
    """The state or effect ``p`` followed by the effect ``q``."""
    a, b, c, d, e, f, tint = p
    i, j, k, m, x, y, other = q
    return a * i + c * j, b * i + d * j, a * k + c * m, b * k + d * m, a * x + c * y + e, b * x + d * y + f, tint if other < 0 else other


def stepped(now: tuple, stack: list, kind: int, args: Iterable[float], below: list | None = None) -> tuple:
    """The state after one operation.  A restore of an empty stack does nothing, or, with ``below``, ends a part of an effect."""
    if kind == SAVE:
        stack.append(now)
    elif kind == RESTORE:
        if stack:
            return stack.pop()
        if below is not None:
            below.append(now)
            return SAME
    elif kind == TRANSFORM:
        return then(now, (*args, -1.0))
    elif kind == STROKE:
        return (*now[:6], *args)
    return now


def passed(now: tuple, stack: list, parts: list, saved: list) -> tuple:
    """The state after a stretch of these effects: ``parts`` between restores from below its start, ``saved`` since the last of those."""
    for part in parts[:-1]:
        now = then(now, part)
        if stack:
            now = stack.pop()
    stack.extend([then(now, s) for s in saved])
    return then(now, parts[-1])


def _flat(states: list) -> list:
    return list(chain.from_iterable(states))


def _states(flat: Iterable[float]) -> list:
    return list(zip(*[iter(map(float, flat))] * 7))


def _measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The effects that a stretch has on its first page and, if another, on its last."""
    segment = page = None
    nth, now, parts, saved = 0, SAME, [], []

    def row() -> pd.DataFrame:
        return pd.DataFrame([(segment, nth, page, _flat([*parts, now]), _flat(saved))], columns=["_segment", "_nth", "_page", "parts", "saved"])

    for pdf in frames:
        for segment, name, kind, args in zip(pdf["_segment"], pdf["_page"], pdf["_kind"], pdf["_args"]):
            if name != page:
                if page is not None and nth == 0:
                    yield row()
                nth, now, parts, saved = 0 if page is None else 1, SAME, [], []
                page = name
            now = stepped(now, saved, kind, args, parts)
    if page is not None:
        yield row()


def _enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each stretch is entered with: the state, and as many saved ones as its restores reach."""
    page, now, stack = None, START, []
    for pdf in frames:
        out = []
        for segment, nth, name, parts, saved in zip(pdf["_segment"], pdf["_nth"], pdf["_page"], pdf["parts"], pdf["saved"]):
            if name != page:
                page, now, stack = name, START, []
            parts = _states(parts)
            if nth == 0:
                reach = min(len(stack), len(parts) - 1)
                out.append((segment, _flat([now, *stack[len(stack) - reach:]])))
            now = passed(now, stack, parts, _states(saved))
        yield pd.DataFrame(out, columns=["_segment", "_args"])


def _lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Page, vertical position and width of each path drawn in the rule's colour."""
    page, now, stack = None, START, []
    for pdf in frames:
        out = []
        for name, kind, args in zip(pdf["_page"], pdf["_kind"], pdf["_args"]):
            if kind == ENTRY:
                now, *stack = _states(args)
                continue
            if name != page:
                if page is not None:
                    now, stack = START, []
                page = name
            if kind == PATH:
                if now[6] == 1:
                    out.append((name, now[5], float(args[0])))
            else:
                now = stepped(now, stack, kind, args)
        yield pd.DataFrame(out, columns=["_page", "page_y", "width"])


def ranked(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """df with ``name``, each row's place (from 0) in ``order`` among the rows of its keys.

    Rows are ranked inside ranges of (keys, order).  Only the key that a range starts
    with can have rows before it, so one number a range, their count, is broadcast.
    """
    rows = settle(df.repartitionByRange(*keys, *order).withColumn("_segment", F.spark_partition_id()), "ranked")
    counts = rows.groupBy("_segment", *keys).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_segment")) - F.col("_n")).where("_before > 0")
    before = before.select(F.col("_segment").alias("_s"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    same = F.col("_segment") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(Window.partitionBy("_segment", *keys).orderBy(*order)) - 1
    out = rows.withColumn("_inside", inside).join(F.broadcast(before), same, "left")
    return out.withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_inside")).cast("int")).select(*df.columns, name)


def drawn_rules(ops: DataFrame, keys: list[str], color: str, least_width: float, most_height: float) -> DataFrame:
    """(keys, idx, page_y, width) of the wide flat paths drawn in ``color``, highest first, numbered from 0.

    ops (keys, idx, op, args, color): ``save``, ``restore``, ``transform`` (six numbers),
    ``stroke`` (a colour of any case) and ``path`` (x, y, x, y); others are left out, as
    are paths that can't be rules.  A restore of nothing does nothing.  A transform with
    a number missing makes the positions that depend on it null; a stroke without a
    colour sets another one.  Of one ``idx`` paths go first, then restores, saves,
    strokes and transforms.

    The log is dealt by ranges of (keys, idx).  Effects of ranges are taken side by
    side; one pass over them, a range or two rows each, gives what each is entered
    with; then all are replayed side by side.  That pass holds a page's open saves.
    """
    nan, op, args = F.lit(float("nan")), F.col("op"), F.col("args")
    side = lambda k: F.abs(F.get(args, k + 2) - F.get(args, k))
    rule = (op == "path") & (side(0) >= least_width) & (side(1) <= most_height)
    kind = F.when(rule, PATH).when(op == "restore", RESTORE).when(op == "save", SAVE).when(op == "stroke", STROKE).when(op == "transform", TRANSFORM)
    tint = F.coalesce(F.lower("color") == color, F.lit(False)).cast("double")
    given = F.when(kind == PATH, F.array(side(0))).when(kind == STROKE, F.array(tint)).when(kind == TRANSFORM, F.array(*[F.coalesce(F.get(args, k), nan) for k in range(6)])).otherwise(F.array().cast("array<double>"))
    page = F.struct(*keys)
    coded = ops.select(F.to_json(page, {"ignoreNullFields": "false"}).alias("_page"), F.col("idx").alias("_idx"), kind.alias("_kind"), given.alias("_args")).where("_kind is not null")
    rows = settle(coded.repartitionByRange("_page", "_idx").withColumn("_segment", F.spark_partition_id()), "replayed")
    parts = 1 + (rows.agg(F.max("_segment")).first()[0] or 0)

    def dealt(df: DataFrame) -> DataFrame:
        # an entry has no page: nulls come first
        return df.repartitionById(parts, F.col("_segment")).sortWithinPartitions("_segment", "_page", "_idx", "_kind", "_args")

    effects = dealt(rows).mapInPandas(_measure, "_segment int, _nth int, _page string, parts array<double>, saved array<double>")
    entries = effects.repartition(1).sortWithinPartitions("_segment", "_nth").mapInPandas(_enter, "_segment int, _args array<double>")
    both = rows.unionByName(entries.withColumn("_kind", F.lit(ENTRY)), allowMissingColumns=True)
    lines = dealt(both).mapInPandas(_lines, "_page string, page_y double, width double")
    of = F.from_json("_page", ops.select(*keys).schema)
    found = lines.select(*[of[k].alias(k) for k in keys], F.when(~F.isnan("page_y"), F.col("page_y")).alias("page_y"), "width")
    return ranked(found, keys, [F.desc("page_y"), F.desc("width")], "idx").select(*keys, "idx", "page_y", "width")
