"""The trie of conversations' turns, from sorted sequences.

A turn becomes 24 bytes: the first half of a SHA-256 of its role and text, and its
number of words.  A conversation is the sequence of its turns' bytes.  Distinct
sequences are sorted by ranges into blocks.  Beside each row of a block stands its
longest common prefix with the row before.  A sparse table gives the minimum of any
run of those, so each candidate prefix finds its extents by binary search to the left
and to the right, on its own.  All that a node counts is a sum over its rows, so nodes
that reach over the edge of a block are sums of their parts, met by the hash of their
prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import settle, split_join, text_bytes

TURN = 24
#: Bytes and rows of sequences in a block, ids in one text of a group's ids.
BLOCK_BYTES, BLOCK_ROWS, IDS = 32 << 20, 100_000, 4096
NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, all_words long, own_words long, before long, ends_sha256 string"


def turn_code(role: Column, text: Column) -> Column:
    """A turn as hex digits: half a SHA-256 of role and text, then its number of words."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary")), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(F.substring(digest, 1, 32), F.lpad(F.lower(F.hex(words.cast("long"))), 16, "0"))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (codes in order) of each conversation; null turns first, equal turns by their codes."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.struct("turn", F.unhex(turn_code(F.col("role"), F.col("text"))).alias("code")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["code"]).alias("turns"))


def rebuilt(own: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first turns taken from the first of its family.

    As many as its id's CRC-32 says, below ``most``: the family's first h turns, then
    its own after its first h.
    """
    heads = own.select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    joined = own.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("head_id"), "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def id_texts(convs: DataFrame) -> DataFrame:
    """key, first id and the comma-joined ids of pieces of each sequence's conversations, in order.

    Ranges of (key, conv_id) are sorted side by side, so that a group of any size is
    spread; a piece has at most IDS of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            spans = [(k, min(k + IDS, b)) for a, b in zip(cuts, cuts[1:]) for k in range(a, b, IDS)]
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in spans]
            at = pa.array([a for a, _ in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(texts)], ["key", "first", "ids"])

    rows = convs.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return rows.mapInArrow(run, "key binary, first long, ids string")


def ends(convs: DataFrame) -> DataFrame:
    """key and ends_sha256 of each sequence: its pieces pass through one hash, one after another.

    SHA-256 has no parallel form: a group's digits pass one task, as a stream and IDS
    of them a row, so memory stays bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, so_far = None, hashlib.sha256()
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if key == last:
                    so_far.update(b",")
                else:
                    if last is not None:
                        done.append((last, so_far.hexdigest()))
                    last, so_far = key, hashlib.sha256()
                so_far.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["key", "ends"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([so_far.hexdigest()])], ["key", "ends"])

    return id_texts(convs).repartition("key").sortWithinPartitions("key", "first").mapInArrow(run, "key binary, ends string")


def common_turns(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:TURN] != b[:TURN] or not n:
        return 0
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) // TURN if len(differ) else n // TURN


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of every run of 1, 2, 4, ... values."""
    out = [values]
    while 2 << (len(out) - 1) <= len(values):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row of those around ``row`` that share its first ``depth`` turns.

    ``table`` is of the common prefixes of each row with the one before; each
    candidate searches by halving steps, to either side.
    """
    rows = len(table[0])
    left, right = row.copy(), row.copy()
    for k in range(len(table) - 1, -1, -1):
        step, low = 1 << k, table[k]
        to = right + step < rows
        to[to] = low[right[to] + 1] >= depth[to]
        right[to] += step
        to = left - step >= 0
        to[to] = low[left[to] - step + 1] >= depth[to]
        left[to] -= step
    return left, right


def lowest(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of the values from a to b, both included: two runs that may overlap."""
    k = np.frexp(b - a + 1)[1] - 1
    out = np.empty(len(a), table[0].dtype)
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(table[level][a[at]], table[level][b[at] - (1 << level) + 1])
    return out


def summed(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def prefix_keys(sequence: bytes, depth: int) -> list[bytes]:
    """Hashes of the first 0 to ``depth`` turns."""
    so_far, out = hashlib.md5(), [hashlib.md5().digest()]
    for d in range(depth):
        so_far.update(sequence[d * TURN : (d + 1) * TURN])
        out.append(so_far.copy().digest())
    return out


def block_nodes(seqs: list[bytes], n: np.ndarray, low: np.ndarray, own_ends: list[str], before: bytes | None, after: bytes | None) -> pa.RecordBatch:
    """Nodes first met in a block of sorted sequences, and its parts of nodes that reach over its edges.

    A node belongs to the first row that has its prefix.  Nodes and parts that go on
    in another block have a key; so do the parents that do.
    """
    length = np.array([len(s) // TURN for s in seqs])
    shared = np.array([-1 if before is None else common_turns(before, seqs[0]), *map(common_turns, seqs, seqs[1:])])
    shared_after = -1 if after is None else common_turns(seqs[-1], after)
    words = np.frombuffer(b"".join(seqs), ">u8").reshape(-1, TURN // 8)[:, 2].astype(np.int64)
    word_sums, start = summed(words), summed(length)[:-1]
    upto = lambda row, depth: word_sums[start[row] + np.maximum(depth, 0)] - word_sums[start[row]]

    # candidates: each row's depths from its branching point on, of the first row all
    first = np.concatenate([[0], shared[1:]])
    many = length - first + 1
    begin = summed(many)[:-1]
    row = np.repeat(np.arange(len(seqs)), many)
    depth = np.arange(many.sum()) - np.repeat(begin - first, many)
    left, right = extents(sparse_table(shared), row, depth)
    is_own = depth > shared[row]
    is_node = is_own | (row == 0)
    parent = np.arange(len(row)) - 1  # a depth above, in the same row
    branch = np.where(depth == shared[row] + 1, parent, 0)  # or where the row branches off, at the first row that has it
    off = (depth == shared[row] + 1) & (row > 0)
    parent[off] = begin[left[branch[off]]] + depth[off] - 1 - first[left[branch[off]]]
    children = np.bincount(parent[is_own & (depth > 0)], minlength=len(row))

    # what a node counts are sums over its rows
    rows = np.arange(len(seqs))
    every, leaf = upto(rows, length), length > np.concatenate([shared[1:], [shared_after]])
    apart = every - upto(rows, shared)  # words of the nodes that belong to a row
    over = lambda values: summed(values)[right + 1] - summed(values)[row]
    above = upto(row, depth - 1)
    own_words = over(apart) - apart[row] + np.where(is_own, every[row] - above, apart[row])
    smallest = lowest(sparse_table(low), row, right)

    is_open = ~is_own | ((right == len(seqs) - 1) & (depth <= shared_after))
    keys = [prefix_keys(seqs[0], int(shared[0])), prefix_keys(seqs[-1], shared_after)]
    key_of = lambda i: keys[0][depth[i]] if not is_own[i] else keys[1][depth[i]]
    at = np.flatnonzero(is_node)
    up = parent[at]
    has_up = depth[at] > 0
    open_up = has_up & is_open[up]
    ended = is_own & (depth == length[row])
    columns = [
        pa.array([key_of(i) if is_open[i] else None for i in at], pa.binary()), pa.array([key_of(p) if o else None for p, o in zip(up, open_up)], pa.binary()),
        pa.array(depth[at]), pa.array(smallest[at]), pa.array(smallest[up], mask=~has_up | open_up), pa.array(over(n)[at]), pa.array(children[at]), pa.array(over(leaf.astype(np.int64))[at]),
        pa.array(over(n * every)[at]), pa.array(own_words[at]), pa.array(above[at]), pa.array([own_ends[row[i]] if ended[i] else None for i in at], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NODE.split(", ")])


def parts(blocks: DataFrame) -> DataFrame:
    """The nodes and parts of nodes of every block; a block's rows come together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in chain(batches, [None]):
            found = zip(*(batch.column(k).to_pylist() for k in range(6))) if batch is not None else [(None,) * 6]
            for x in found:
                if x[0] != block:
                    if held:
                        own = [r for r in held if r[1] == 1]
                        edge = {r[1]: r[2] for r in held}
                        yield block_nodes([r[2] for r in own], np.array([r[3] for r in own]), np.array([r[4] for r in own]), [r[5] for r in own], edge.get(0), edge.get(2))
                    block, held = x[0], []
                held.append(x)

    return blocks.select("block", "kind", "seq", "n", "conv_id", "ends").mapInArrow(run, NODE)


def nodes(convs: DataFrame) -> DataFrame:
    """The trie of conversations given as conv_id and turns (codes in order): a row a node.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  Equal sequences are one path.  A table
    without conversations has no nodes, not even a root.
    """
    spark = convs.sparkSession
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t)), ""))
    convs = settle(convs.select("conv_id", seq.alias("seq")).withColumn("key", F.unhex(F.md5("seq"))), "trie-conversations")
    distinct = convs.groupBy("key", "seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).join(ends(convs), "key")
    distinct = settle(distinct, "trie-sequences")
    total, rows = distinct.agg(F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)), F.count("*")).first()
    count = max(1, -(-total // BLOCK_BYTES), -(-rows // BLOCK_ROWS))
    ordered = distinct.repartitionByRange(count, "seq").sortWithinPartitions("seq")
    ordered = settle(ordered.select(F.spark_partition_id().alias("block"), F.lit(1).alias("kind"), "seq", "n", "conv_id", "ends"), "trie-blocks")

    # the last row before and the first row after each block: a row a block
    by = Window.orderBy("block")
    edges = ordered.groupBy("block").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).select("block", F.lag("high").over(by).alias("before"), F.lead("low").over(by).alias("after"))
    sides = [edges.select("block", F.lit(k).alias("kind"), F.col(c).alias("seq"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("string").alias("ends")).where("seq is not null") for k, c in ((0, "before"), (2, "after"))]
    tiles = ordered.unionByName(sides[0]).unionByName(sides[1]).repartition(count, "block").sortWithinPartitions("block", "kind", "seq")
    found = settle(parts(tiles), "trie-parts")

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "all_words", "own_words")]
    whole = found.where("key is not null").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), *sums, F.max("before").alias("before"), F.max("ends_sha256").alias("ends_sha256")
    )
    whole = settle(whole, "trie-open")
    every = found.where("key is null").unionByName(whole)
    up = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"), "n_children").where("n_children > 0")
    below = split_join(every.where("parent_key is not null"), up.withColumnRenamed("n_children", "n_below"), ["parent_key"], "n_below", ["conv_id"])
    every = every.where("parent_key is null").unionByName(below.withColumn("parent_conv_id", F.col("up")).select(every.columns))
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("all_words") - F.col("n_convs") * F.col("before") - F.col("own_words")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of all rebuilt conversations.

    Rows without conv_id belong to no conversation.  Null roles and texts are empty.
    Turns go by number, null first, equal numbers by a hash of the turn; repeated rows
    are turns of their own.  A conversation may become turnless: it ends at the root.
    A conversation's turns, 24 bytes each whatever their texts, are one row.  Only
    conv_id, turn, role and text are read, whatever other columns there are.
    """
    return nodes(rebuilt(sequences(conversations)))


ORACLE = rf"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, code) as i, code, words from (
    select conv_id, turn, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as code, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words
    from conversations where conv_id is not null
  )
), own as (
  select conv_id, list(struct_pack(c := code, w := words) order by i) as t from turns group by 1
), crc as (
  select conv_id, t, list_reduce(list_prepend(4294967295::bigint, range(8 * strlen(conv_id::varchar))::bigint[]), lambda crc, k:
    xor(crc >> 1, case when xor(crc, (ord(substr(conv_id::varchar, (k // 8 + 1)::int, 1)) >> (k % 8)::int)::bigint) & 1 = 1 then 3988292384::bigint else 0::bigint end)) as c from own
), heads as (
  select conv_id, t, (xor(c, 4294967295::bigint) % 4)::int as h from crc
), rebuilt as (
  select x.conv_id, list_concat(coalesce(b.t[1:x.h], []), x.t[x.h + 1:]) as t from heads x left join own b on b.conv_id = x.conv_id - x.conv_id % 20
), steps as (
  select conv_id, d, t[1:d] as prefix, len(t) as n from (select conv_id, t, unnest(range(0, len(t) + 1)) as d from rebuilt)
), keyed as materialized (
  select conv_id, d::bigint as depth, n, case when d > 0 then prefix[d].w else 0 end as w, sha256(array_to_string(list_transform(prefix, lambda x: x.c), ',')) as key,
    case when d > 0 then sha256(array_to_string(list_transform(prefix[1:d - 1], lambda x: x.c), ',')) end as up from steps
), nodes as materialized (
  select key, any_value(up) as up, any_value(depth) as depth, min(conv_id) as conv_id, count(*)::bigint as n_convs, any_value(w) as w,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '')) as ends_sha256 from keyed group by 1
), children as (
  select up as key, count(*)::bigint as n_children from nodes where up is not null group by 1
), above as (
  select distinct x.key as top, y.key from keyed x join keyed y on x.conv_id = y.conv_id and x.depth <= y.depth
), below as (
  select top as key, sum((n_convs - 1) * w)::bigint as saved_tokens, count(*) filter (where n_children is null)::bigint as n_leaves from above join nodes using (key) left join children using (key) group by 1
)
select x.conv_id, x.depth, p.conv_id as parent_conv_id, x.n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves, saved_tokens, x.ends_sha256
from nodes x left join nodes p on p.key = x.up left join children c on c.key = x.key join below b on b.key = x.key
"""
