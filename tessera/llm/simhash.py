"""SimHash near-dedup by pivot distance tables.

Every text gets a 64-bit fingerprint.  Its Hamming distances to fixed reference
fingerprints (the pivots) are computed once and kept beside it.  Two fingerprints
within ``radius`` bits of each other agree in full on at least ``agree`` of
``radius + agree`` segments, so each pair meets under some choice of segments; the
more fingerprints, the more segments must agree, so that groups stay small.  Where
fingerprints meet, by the triangle inequality a pair whose coordinates differ
anywhere by more than the radius can't be near, and only the survivors are compared
bit by bit.
Groups give a spanning forest of their links, never all pairs, and the forests
meet in a distributed connected-components job.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, settle, split_join, text_bytes

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
PIVOTS = 8
#: Fingerprints that share a group by chance, at most, in the mean.
GROUP_ROWS = 64
TILE_ROWS = 4096
_ROWS_A_BLOCK = 1 << 14


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, drawn by a rule so that all tasks have the same."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(n)], dtype=np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 majority bits over the hashes of a text's word shingles; 0 for no words."""
    words = text.lower().split()  # of bytes: lowers A-Z and cuts at 0x20 and 0x09-0x0D alone
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < width:
        hashes = digest(b" ".join(words), seed)
    else:
        joined = b" ".join(words)
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        hashes = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[width:])])
    return majority(np.frombuffer(hashes, np.uint8).reshape(-1, 8))


def majority(rows: np.ndarray) -> int:
    """The bits that over half of the hashes have; each is a row of 8 bytes, the highest first."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(rows), _ROWS_A_BLOCK):
        counts += np.unpackbits(rows[k : k + _ROWS_A_BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and signed 64-bit fingerprint of each whole text (null: no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, fp long")


def coordinates(fp: Column) -> Column:
    """The distances to the pivots, a byte each, as one long."""
    out = F.lit(0).cast("long")
    for k, p in enumerate(pivots().tolist()):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("long"), 8 * k))
    return out


def agreeing(count: int, radius: int = RADIUS) -> int:
    """The fewest segments to agree on, from two on, whose groups hold about GROUP_ROWS of so many fingerprints."""
    agree = 2
    while agree < 6 and count >> (64 * agree // (radius + agree)) > GROUP_ROWS:
        agree += 1
    return agree


def segment_masks(radius: int = RADIUS, agree: int = 2, bits: int = 64) -> list[int]:
    """Bit masks of every choice of ``agree`` out of ``radius + agree`` segments."""
    n = radius + agree
    edges = [bits * k // n for k in range(n + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(one, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(groups: np.ndarray, prints: np.ndarray, coords: np.ndarray, radius: int = RADIUS, seen: dict[str, int] | None = None) -> np.ndarray:
    """Smallest row of the same group that each row reaches by links of its group.

    Rows come sorted by group; ``coords`` holds their packed coordinates.  Row i is
    held against row i + d for d = 1, 2, ... as long as any two such rows share a
    group.  A pair goes on to the exact comparison only if the pivot table leaves
    it.  ``seen`` counts the pairs that met and those compared.
    """
    table = coords.astype("<i8").view(np.int8).reshape(-1, PIVOTS)
    order = np.lexsort((table[:, 0], groups))
    groups, prints, table = groups[order], prints[order], table[order]
    n = len(prints)
    if seen is not None:
        _, sizes = np.unique(groups, return_counts=True)
        seen["met"] = seen.get("met", 0) + int((sizes * (sizes - 1) // 2).sum())
    root = np.arange(n)
    at = np.arange(n - 1)
    d = 1
    while len(at):
        at = at[at + d < n]
        at = at[groups[at] == groups[at + d]]
        at = at[table[at + d, 0] - table[at, 0] <= radius]  # sorted by this pivot: later rows are farther still
        left = at[root[at] != root[at + d]]
        for k in range(1, table.shape[1]):
            if not len(left):
                break
            left = left[np.abs(table[left + d, k] - table[left, k]) <= radius]
        if seen is not None:
            seen["compared"] = seen.get("compared", 0) + len(left)
        left = left[np.bitwise_count(prints[left] ^ prints[left + d]) <= radius]
        if len(left):
            a, b = left, left + d
            while True:
                low = np.minimum(root[a], root[b])
                if (root[a] == low).all() and (root[b] == low).all():
                    break
                np.minimum.at(root, root[a], low)
                np.minimum.at(root, root[b], low)
                while (root[root] != root).any():
                    root = root[root]
        d += 1
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _forest(radius: int):
    """A function over sorted Arrow batches that yields links (a, b) of their groups."""

    def links(rows: pa.Table) -> pa.RecordBatch | None:
        keys = np.column_stack([rows.column(c).to_numpy() for c in ("combo", "key", "tile")])
        new = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
        reps = rows.column("rep").to_numpy()
        to = near_pairs(new, rows.column("fp").to_numpy().view(np.uint64), rows.column("coords").to_numpy(), radius)
        own = to != np.arange(len(to))
        if not own.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(reps[own]), pa.array(reps[to[own]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            keys = np.column_stack([held.column(c).to_numpy() for c in ("combo", "key", "tile")])
            other = np.flatnonzero((keys != keys[-1]).any(axis=1))
            if len(other):
                done, held = held.slice(0, other[-1] + 1), held.slice(other[-1] + 1)
                if (found := links(done)) is not None:
                    yield found
        if held is not None and held.num_rows and (found := links(held)) is not None:
            yield found

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, agree: int | None = None) -> DataFrame:
    """Links (a, b) between representatives: a spanning forest of each group's links.

    ``distinct`` has one row a fingerprint: fp, coords and rep.  A group of over
    ``tile_rows`` rows is cut into blocks; each two blocks meet in a task of their
    own, so that no task holds a whole large group.
    """
    masks = segment_masks(radius, agree or agreeing(distinct.count(), radius))
    keyed = distinct.select(
        "fp", "coords", "rep",
        F.inline(F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])),
    )
    large = keyed.groupBy("combo", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / tile_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        keyed.join(large, ["combo", "key"])
        .withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        .select("combo", "key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).cast("long").alias("tile"), "fp", "coords", "rep")
    )
    return dealt.repartition("combo", "key", "tile").sortWithinPartitions("combo", "key", "tile").mapInArrow(_forest(radius), "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Alternating large-star and small-star rounds; each groups by node with a
    pre-aggregated minimum, the edges of a node with very many are dealt over
    several tasks, and rounds stop when the edges no longer change.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    was, count = None, edges.count()
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        star = split_join(both, low, ["a"], "n", ["b"], total=2 * count).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        old, edges = edges, settle(
            split_join(star, low, ["a"], "n", ["b"], total=2 * count).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct(),
            "edges",
        )
        discard(old)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").bitwiseAND(0xFFFFFFFF))).first()
        if now == was or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was, count = now, now[0]
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    Null and empty texts have fingerprint zero and link like any other.  Repeated
    rows each get a row; the smallest doc_id reachable names the component.  Rows
    with a null doc_id get their fingerprint's component, or null if no row with
    an id has that fingerprint.  An empty table gives no rows.
    """
    prints = settle(fingerprints(docs), "fingerprints")
    distinct = settle(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).withColumn("coords", coordinates(F.col("fp"))), "distinct-prints")
    roots = components(links(distinct, radius))
    named = distinct.join(roots, distinct.rep == roots.node, "left").select("fp", "n", F.coalesce("root", "rep").alias("component_id"))
    return split_join(prints, named, ["fp"], "n", ["doc_id"], "left").select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents with one row of each component of near copies kept; see ``near_copies``."""
    from tessera.llm import near_copies

    return near_copies.keep_first(docs)
