"""What the two vector searches share: usable vectors and the grid of tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import settle

MATCHES = "query_id long, vec_id long, score {kind}"


def usable(embeddings: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, vector and dim of the rows that take part.

    Vectors stay in single precision if the table has them so, and are doubles else.
    Left out are null ids, and vectors that are null or hold null or non-finite
    components; with ``nonzero`` also vectors without a component other than zero.
    A vec_id names a row: of repeated ids the smallest vector stays.  Vectors of
    different lengths never meet.
    """
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and vector is not null")
    rows = rows.where(~F.exists("vector", odd))
    if nonzero:
        rows = rows.where(F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def grid(vectors: DataFrame, is_query: Column, query_rows: int, lane_rows: int) -> DataFrame:
    """Rows dealt to a grid of tiles: each query band meets each lane of candidates.

    Bands hold about ``query_rows`` queries and lanes about ``lane_rows``
    candidates at any size of the table, so a task's memory is bounded.  In a
    tile the queries (kind 0) come before the candidates (kind 1).
    """
    vectors = settle(vectors.withColumn("is_query", is_query), "vectors")
    total, asked = vectors.agg(F.count("*"), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0))).first()
    bands, lanes = max(1, -(-asked // query_rows)), max(1, -(-total // lane_rows))
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["dim", "band", "lane", "kind", "vec_id", "vector"]
    asks = vectors.where("is_query").withColumn("band", spread(bands)).withColumn("lane", every(lanes)).withColumn("kind", F.lit(0)).select(columns)
    held = vectors.withColumn("lane", spread(lanes)).withColumn("band", every(bands)).withColumn("kind", F.lit(1)).select(columns)
    tiles = asks.unionByName(held).repartition(max(1, min(bands * lanes, 20_000)), "dim", "band", "lane")
    return tiles.sortWithinPartitions("dim", "band", "lane", "kind", "vec_id")


def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Kind, ids, matrix and whether a new tile starts, for each run of rows of one tile and kind."""
    last = None
    for batch in batches:
        dim, band, lane, kind, ids = (batch.column(k).to_numpy() for k in range(5))
        keys = np.column_stack([dim, band, lane, kind])
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        vectors = batch.column(5)
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            tile = tuple(keys[a][:3])
            flat = vectors.slice(a, b - a).flatten().to_numpy().astype(np.float64)
            yield int(kind[a]), ids[a:b], flat.reshape(b - a, int(dim[a])), tile != last
            last = tile


def best(matches: DataFrame, k: int, order: Column) -> DataFrame:
    """The first k matches of each query over all lanes, with ranks from 1."""
    own = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return matches.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", *[c for c in matches.columns if c != "query_id"])


def search(tiles: DataFrame, run: Callable, *kinds: str) -> DataFrame:
    """The tiles' matches; ``kinds`` are the kind of the score and further columns."""
    return tiles.mapInArrow(run, ", ".join([MATCHES.format(kind=kinds[0]), *kinds[1:]]))
