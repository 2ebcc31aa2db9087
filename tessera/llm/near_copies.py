"""Near copies by verified similarity: the pipeline's stage.

Texts are sets of word shingles.  Each set has a SimHash fingerprint with its
distances to the pivots, and fingerprints within a few bits are found by them as in
``simhash``: texts that reach one another by such links meet.  Pairs at the threshold
differ in about ten of 64 bits, more than segments can find among many texts, so those
that share a min-hash band meet as well.  Where texts meet, the Jaccard similarity of
their whole shingle sets is computed, and only pairs that reach the threshold are
links.  Components join the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle, split_join, text_bytes
from tessera.llm.simhash import RADIUS, SEED, components, coordinates, majority
from tessera.llm.simhash import links as print_links

WIDTH, SIMILARITY = 5, 0.8
#: Two texts at similarity 0.8 share no band with probability (1 - 0.8 ** 5) ** 30, below 0.00001.
BANDS, BAND_ROWS = 30, 5
TILE_ROWS, TILE_SHINGLES = 1024, 1 << 21
_PIECE, _CACHE = 1 << 10, 1 << 18


def drawn(name: bytes, n: int) -> np.ndarray:
    """Odd multipliers, drawn by a rule so that all tasks have the same."""
    return np.array([xxhash.xxh64_intdigest(b"%s %d" % (name, k), SEED) | 1 for k in range(n)], dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, cache: dict[bytes, int], width: int = WIDTH) -> tuple[int, np.ndarray]:
    """A hash of the text's words, and the sorted hashes of its word shingles; shorter texts are one shingle."""
    words = text.lower().split()
    whole = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    if len(words) < width:
        return whole, np.array([whole], np.uint64)
    if len(cache) > _CACHE:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh64_intdigest(w, SEED)
    hashes = np.array([cache[w] for w in words], np.uint64)
    n = len(words) - width + 1
    return whole, np.unique(_mixed(sum(hashes[k : k + n] * m for k, m in enumerate(drawn(b"word", width)))))


def bands(own: np.ndarray, factors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), _PIECE):
        low = np.minimum(low, (own[k : k + _PIECE, None] * factors).min(axis=0))
    return _mixed((_mixed(low).reshape(-1, len(weights)) * weights).sum(axis=1, dtype=np.uint64))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similar(own: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that reach the similarity."""
    sizes = np.array([len(x) for x in own])
    order = np.argsort(sizes, kind="stable")
    sizes, own = sizes[order], [own[k] for k in order]
    root, found = np.arange(len(own)), []
    for i in range(len(own) - 1):
        last = np.searchsorted(sizes, sizes[i] / similarity + 1e-9, "right")
        others = i + 1 + np.flatnonzero(root[i + 1 : last] != root[i])
        for a in range(0, len(others), 256):
            part = others[a : a + 256]
            flat = np.concatenate([own[j] for j in part])
            at = np.minimum(np.searchsorted(own[i], flat), sizes[i] - 1)
            common = np.add.reduceat((own[i][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
            for j in part[common >= similarity * (sizes[i] + sizes[part] - common) - 1e-9]:
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    found.append((int(order[i]), int(order[j])))
    return found


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), node (of its words), size (in shingles), bands and fp (fingerprint) of each row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        factors, weights = drawn(b"min", BANDS * BAND_ROWS), drawn(b"band", BAND_ROWS)
        for batch in batches:
            nodes, sizes, keys, prints = [], [], [], []
            for x in batch.column(2):
                node, own = shingles(x.as_py(), cache)
                nodes.append(signed(node))
                sizes.append(len(own))
                keys.append(bands(own, factors, weights).view(np.int64))
                prints.append(signed(majority(own.astype(">u8").view(np.uint8).reshape(-1, 8))))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            starts = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(starts, flat), pa.array(prints, pa.int64())], ["doc_id", "h", "node", "size", "bands", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"), text_bytes(F.col("text")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, h long, node long, size long, bands array<long>, fp long")


def _sets(rows: DataFrame) -> DataFrame:
    """node and the bytes of its shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            own = [shingles(x.as_py(), cache)[1].tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["node", "own"])

    return rows.select("node", text_bytes(F.col("text")).alias("text")).mapInArrow(run, "node long, own binary")


def _verified(similarity: float):
    """A function over sorted Arrow batches that yields the links (a, b) of their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, own = None, [], []

        def done() -> pa.RecordBatch:
            found = similar(own, similarity)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for *at, node, x in zip(*[batch.column(c).to_pylist() for c in ("band", "key", "tile", "node", "own")]):
                if at != key:
                    if len(nodes) > 1:
                        yield done()
                    key, nodes, own = at, [], []
                nodes.append(node)
                own.append(np.frombuffer(x, np.uint64))
        if len(nodes) > 1:
            yield done()

    return run


def print_groups(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """node, size, band (the one after the last) and key: nodes whose fingerprints reach one another within ``radius`` bits.

    The fingerprints meet by equal segments, the pivot table discards, and what is left is
    compared bit by bit.
    """
    distinct = settle(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")).withColumn("coords", coordinates(F.col("fp"))), "near-prints")
    roots = components(print_links(distinct, radius)).withColumnRenamed("node", "rep")
    named = distinct.join(roots, "rep", "left").select("fp", "n", F.coalesce("root", "rep").alias("key"))
    return split_join(nodes.select("node", "size", "fp"), named, ["fp"], "n", ["node"]).select("node", "size", F.lit(BANDS).alias("band"), "key")


def links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, tile_rows: int = TILE_ROWS, by_print: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between nodes whose sets reach the similarity: a forest of each group's links.

    ``by_print`` has the groups of fingerprints, beside those of bands.  Bands in which the same nodes meet are one group.  A large group is cut into
    blocks, of which each two meet in a task of their own.
    """
    keyed = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    if by_print is not None:
        keyed = keyed.unionByName(by_print)
    groups = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")).where("n > 1")
    groups = groups.groupBy("n", "shingles", "x", "y").agg(F.min(F.struct("band", "key")).alias("at")).select("at.*", "n", F.greatest(F.ceil(F.col("n") / tile_rows), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int").alias("blocks"))
    dealt = settle(
        split_join(keyed, settle(groups, "near-groups"), ["band", "key"], "n", ["node"])
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).cast("long").alias("tile"), "node"),
        "near-tiles",
    )
    wanted = nodes.join(dealt.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "h")
    sets = _sets(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(wanted, ["doc_id", "h"])).dropDuplicates(["node"])
    return dealt.join(sets, "node").repartition("band", "key", "tile").sortWithinPartitions("band", "key", "tile").mapInArrow(_verified(similarity), "a long, b long")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each component of near copies kept.

    Near copies are texts whose sets of five-word shingles have a Jaccard
    similarity of ``similarity`` or more, bytes A-Z lowered; texts of fewer words are
    one shingle, and texts without words are alike.  Kept is the row with the
    smallest doc_id; of rows with that id and text, one.  Rows of one id and
    different texts are told apart.  Rows with a null id can't be named and stay.
    An empty table stays empty.
    """
    rows = settle(_hashed(docs), "near-hashes")
    nodes = settle(rows.groupBy("node").agg(F.min(F.struct("doc_id", "h", "size", "bands", "fp")).alias("r")).select("node", "r.*"), "near-nodes")
    by_print = settle(print_groups(nodes), "near-by-print")
    roots = components(links(docs, nodes, similarity, by_print=by_print)).withColumnRenamed("node", "n")
    named = nodes.join(roots, F.col("node") == F.col("n"), "left")
    first = named.groupBy(F.coalesce("root", "node").alias("component")).agg(F.min(F.struct("doc_id", "h")).alias("r")).select(F.col("r.doc_id").alias("doc_id"), F.col("r.h").alias("_h"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("_h"))  # columns of any name lie in the struct
    kept = rows.join(first, ["doc_id", "_h"], "left_semi").dropDuplicates(["doc_id", "_h"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))
