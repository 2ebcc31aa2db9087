"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into a fixed number of virtual slots.  Only the bytes of each slot
are gathered (a table bounded by the number of slots), from which a map of slots
to shards is made.  A later rebalancing edits that map: it moves as few slots as
it needs and stores the result as the next version.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import HOT_SHARE, settle, text_bytes, unsigned_crc32

VIRTUAL_SLOTS = 8192
SHARDS = 8
#: Rows of a slot that are ranked together, at least.
PART_ROWS = 256
MAP_SCHEMA = "version int, vslot int, shard int, slot_bytes long, slot_rows long"


def virtual_slot(slots: int = VIRTUAL_SLOTS) -> Column:
    """Slot of a record, from its text alone, so that equal texts stay together."""
    return F.pmod(F.col("text_hash"), F.lit(slots)).cast("int")


def measured(docs: DataFrame, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, a hash of the text, place in the table and vslot of each document, with no text kept."""
    return docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("place"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        unsigned_crc32(F.col("text")).alias("text_crc32"),
        F.xxhash64(text_bytes(F.col("text"))).alias("text_hash"),
    ).withColumn("vslot", virtual_slot(slots))


def settled_rows(docs: DataFrame, slots: int, shards: int = SHARDS) -> DataFrame:
    """The measured documents, written once.

    Equal texts have one slot and so one shard.  Those that hold more than half of what
    a shard should hold can't stay together if shards are to be even: their rows are
    spread over all slots by id and place in the table.  At most 2 * ``shards`` texts,
    and slots, are as large, so both lists are broadcast.
    """
    rows = settle(measured(docs, slots), "shard-rows")
    weights = settle(slot_weights(rows), "shard-weights")
    total = weights.agg(F.coalesce(F.sum("slot_bytes"), F.lit(0))).first()[0]
    most = total // (2 * shards)
    slot = weights.where(F.col("slot_bytes") > most).select("vslot")
    if slot.isEmpty():
        return rows
    large = rows.join(F.broadcast(slot), "vslot", "left_semi").groupBy("text_hash").agg(F.sum("size").alias("n"), F.count("*").alias("copies")).where((F.col("n") > most) & (F.col("copies") > 1))
    found = rows.join(F.broadcast(large), "text_hash", "left")
    spread = F.pmod(F.xxhash64("text_hash", "doc_id", "place"), F.lit(slots)).cast("int")
    return settle(found.withColumn("vslot", F.when(F.col("n").isNotNull(), spread).otherwise(F.col("vslot"))).select(rows.columns), "shard-spread")


def slot_weights(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot: pre-aggregated by task, one row a slot."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def first_map(spark: SparkSession, weights: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1: slots by falling bytes, each to the shard that holds least.

    ``weights`` has at most one row a slot, a bound set by parameter and not by
    the data, so it may meet on the driver.
    """
    found = sorted(((r.slot_bytes, r.slot_rows, r.vslot) for r in weights.collect()), key=lambda x: (-x[0], x[2]))
    heap = [(0, k) for k in range(shards)]
    rows = []
    for size, n, slot in found:
        held, shard = heapq.heappop(heap)
        rows.append((1, slot, shard, size, n))
        heapq.heappush(heap, (held + size, shard))
    return spark.createDataFrame(rows, MAP_SCHEMA)


def rebalanced_map(spark: SparkSession, old: DataFrame, weights: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version of a map: fresh bytes, and slots moved only as needed.

    While some shard holds more than (1 + tolerance) times the mean, its largest
    slot that still lessens the gap goes to the lightest shard.  New shards start
    empty; slots never seen before go to the lightest shard.
    """
    place = {r.vslot: (r.shard, r.version) for r in old.collect()}
    now = {r.vslot: (r.slot_bytes, r.slot_rows) for r in weights.collect()}
    version = 1 + max((v for _, v in place.values()), default=0)
    held = [0] * shards
    own: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    loose = []
    for slot, (size, _) in sorted(now.items()):
        shard = place.get(slot, (shards, 0))[0]
        if shard < shards:
            held[shard] += size
            own[shard].append((size, slot))
        else:
            loose.append((size, slot))
    for size, slot in sorted(loose, reverse=True):
        k = min(range(shards), key=lambda i: (held[i], i))
        held[k] += size
        own[k].append((size, slot))
    mean = sum(held) / shards
    for x in own:
        x.sort()
    while True:
        top, low = max(range(shards), key=lambda i: held[i]), min(range(shards), key=lambda i: held[i])
        if held[top] <= (1 + tolerance) * mean:
            break
        fits = [x for x in own[top] if 0 < x[0] <= (held[top] - held[low]) / 2]
        if not fits:
            break
        size, slot = fits[-1]
        own[top].remove((size, slot))
        own[low].append((size, slot))
        own[low].sort()
        held[top] -= size
        held[low] += size
    rows = [(version, slot, k, *now[slot]) for k in range(shards) for _, slot in own[k]]
    return spark.createDataFrame(rows, MAP_SCHEMA)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append a version to the maps stored at ``path``; a version that is there already is an error."""
    spark = slot_map.sparkSession
    stored, version = load_map(spark, path), slot_map.agg(F.max("version")).first()[0]
    if version is None:
        return
    if stored is not None and stored.agg(F.max("version")).first()[0] >= version:
        raise ValueError(f"version {version} of the slot map is stored already at {path}")
    slot_map.coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest version of the map stored at ``path``, or the one asked for; None if nothing is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and place in the shard (``slot``, gapless from 0) of each row.

    A row's place is the number of rows in earlier virtual slots of its shard plus its
    rank inside its own, so no task sees a whole shard.  A slot that holds very many
    rows is ranked in parts, which follow each other.
    """
    total = slot_map.agg(F.coalesce(F.sum("slot_rows"), F.lit(0))).first()[0]
    most = max(total // HOT_SHARE, PART_ROWS)
    own = F.broadcast(slot_map.select("vslot", "shard", "version", F.greatest(F.ceil(F.col("slot_rows") / most), F.lit(1)).cast("int").alias("parts")))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "place"), F.col("parts"))).otherwise(0).cast("int")
    dealt = rows.join(own, "vslot").withColumn("part", part)
    counts = dealt.groupBy("shard", "vslot", "part").agg(F.count("*").alias("n"))  # at most a row a slot, and HOT_SHARE
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.broadcast(counts.select("vslot", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size", "place")
    return dealt.withColumn("rank", F.row_number().over(inside) - 1).join(base, ["vslot", "part"]).withColumn("slot", F.col("base") + F.col("rank"))


def _placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    return assign(rows, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = VIRTUAL_SLOTS, map_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Spread documents over shards of near-equal bytes; gives rows and the map.

    Law ``bytes``: size is the UTF-8 length plus 1 (null text: 1).  Rows of equal texts,
    a null and an empty one alike, lie in one shard, unless they hold more than half of
    what a shard should.  Repeated rows each get a place; ids may be null.  An empty table
    gives an empty result and an empty map.  Extra columns are not read.

    With ``map_path`` the newest map stored there says where slots go, so documents
    of a later table stay with those of an earlier one; slots that it lacks are
    added as its next version.  Without a stored map the first one is made and
    stored.
    """
    spark = docs.sparkSession
    rows = settled_rows(docs, slots, shards)
    weights = slot_weights(rows)
    stored = load_map(spark, map_path) if map_path else None
    if stored is None:
        slot_map = first_map(spark, weights, shards)
    elif weights.join(stored.select("vslot"), "vslot", "left_anti").isEmpty():
        slot_map = stored.drop("slot_bytes", "slot_rows").join(weights, "vslot").select("version", "vslot", "shard", "slot_bytes", "slot_rows")
    else:
        slot_map = rebalanced_map(spark, stored, weights, shards, tolerance=float("inf"))
    slot_map = settle(slot_map, "shard-map")
    if map_path and (stored is None or slot_map.agg(F.max("version")).first()[0] != stored.agg(F.max("version")).first()[0]):
        save_map(slot_map, map_path)
    return _placed(rows, slot_map), slot_map


def rebalance_documents(docs: DataFrame, map_path: str, shards: int, slots: int = VIRTUAL_SLOTS, tolerance: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Rows and map after the newest map stored at ``map_path`` is edited for ``shards`` and stored as the next version."""
    spark = docs.sparkSession
    rows = settled_rows(docs, slots, shards)
    stored = load_map(spark, map_path)
    if stored is None:
        raise ValueError(f"no slot map is stored at {map_path}")
    slot_map = settle(rebalanced_map(spark, stored, slot_weights(rows), shards, tolerance), "shard-map")
    save_map(slot_map, map_path)
    return _placed(rows, slot_map), slot_map
