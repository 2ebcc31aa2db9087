"""Best-fit packing of token sequences, certified by dual-feasible functions.

Documents become runs of token ids.  The pieces are dealt to partitions, each of
which packs best-fit decreasing and computes lower bounds on its bins.  A
partition whose bins equal its bound is certified and closed, but for bins that
are less than three quarters full.  The others keep their full bins and exchange
the documents of the rest: these are dealt anew, over fewer partitions, and packed
again until nothing improves.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle

CAPACITY = 1024
END_ID = 2
#: Fixed value: the tokenizer's special string, whose id follows those of the ranks.
END_OF_TEXT = "<|endoftext|>"
GROUP_ITEMS = 20_000
ROUNDS = 4

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(name: str):
    """The vocabulary's encoder, loaded once a worker; END_OF_TEXT in a text is one id, as the tokenizer's file has it."""
    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(public_tokenizers.path(name), "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})
    return lambda text: encoding.encode(text, allowed_special="all") if END_OF_TEXT in text else encoding.encode_ordinary(text)


def token_bytes(text: str | None, vocabulary: str = "byte_bpe_50k.tiktoken") -> bytes:
    """Ids of one text, with no special tokens added, as little-endian uint32 bytes.

    The vocabulary is the one of ``byte_bpe_50k.json`` in the form of ranks, which
    give the same ids several times faster; a test holds the two together.
    """
    return np.array(_encoder(vocabulary)(text or ""), dtype="<u4").tobytes()


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces; only the first may be short."""
    n = len(ids) // 4
    first = n if n <= capacity else (n % capacity or capacity)
    out, start, size = [], 0, first
    while start < n:
        out.append((start, size, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + size)])))
        start, size = start + size, capacity
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Token pieces of each document: doc_id, piece, start, length, ids_crc32."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, (start, length, crc) in enumerate(cut(token_bytes(text.as_py(), vocabulary) + end, capacity)):
                    for column, value in zip(out, (doc, k, start, length, crc)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, packed best-fit decreasing, and the bins' count."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0  # bit r of the mask: some bin has r tokens left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            own = free[room]
            b = own.pop()
            if not own:
                mask &= ~(1 << room)
        else:
            room, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets, count


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of several dual-feasible bounds on the number of bins."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 21):  # rounding functions
        exact = (k + 1) * x % capacity == 0
        scaled = np.where(exact, k * (k + 1) * x, (k + 1) * ((k + 1) * x // capacity) * capacity)  # u(x) * k * (k + 1)
        best = max(best, -(-int((count * scaled).sum()) // (k * (k + 1) * capacity)))
    for a in range(1, capacity // 2 + 1):  # threshold functions: large ones count whole, small ones not
        u = np.where(x > capacity - a, capacity, np.where(x < a, 0, x))
        best = max(best, -(-int((count * u).sum()) // capacity))
    return best


def _packed(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    sizes = pdf["length"].to_numpy(np.int64)
    bins, offsets, count = best_fit(sizes, capacity)
    used, bound = np.bincount(bins, weights=sizes, minlength=count), lower_bound(sizes, capacity)
    return pdf.assign(bin=bins, offset=offsets, bins=count, bound=bound, loose=(used[bins] < capacity) & ((count > bound) | (4 * used[bins] < 3 * capacity)))


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """Place pieces into as few sequences as can be; adds sequence_id and offset.

    Each round's groups hold about ``group_items`` pieces however many there are,
    dealt by a hash of the piece, so one source or document can't fill a group.
    """
    out_schema = PIECES + ", round int, part int, bin long, offset long, bins long, bound long, loose boolean"

    def dealt(pool: DataFrame, parts: int, turn: int) -> DataFrame:
        keyed = pool.withColumn("round", F.lit(turn)).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(parts)).cast("int"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return _packed(pdf, capacity)[[x.split()[0] for x in out_schema.split(", ")]]

        return keyed.groupBy("part").applyInPandas(run, out_schema)

    columns = [x.split()[0] for x in PIECES.split(", ")]
    parts = max(1, -(-items.count() // group_items))
    last = settle(dealt(items.select(columns), parts, 0), "packed-0")
    closed: list[DataFrame] = []
    for turn in range(1, rounds):
        pool = last.where("loose")
        n, before = pool.agg(F.count("*"), F.count_distinct("part", "bin")).first()
        if not n or before < 2:
            break
        parts = max(1, min(parts - 1, -(-n // group_items)))
        again = settle(dealt(pool.select(columns), parts, turn), f"packed-{turn}")
        after = again.agg(F.count_distinct("part", "bin")).first()[0]
        if after >= before:
            break
        closed.append(last.where("not loose"))
        last = again
        if parts == 1:
            break
    for x in closed:
        last = last.unionByName(x)
    number = F.col("round").cast("long") * F.lit(1 << 58) + F.col("part").cast("long") * F.lit(1 << 28) + F.col("bin")
    return last.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", number.alias("sequence_id"), "offset",
        F.col("round").alias("packing_round"), (F.col("bins") == F.col("bound")).alias("certified"),
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Tokenise documents, cut the long ones and pack all pieces.

    A null text is an empty one: its only id is the end id.  Repeated rows are
    packed as often as they occur; a null id stays null.  An empty table gives no
    rows.  Texts are tokenised once: the pieces, without their ids, are written
    to the shared folder.
    """
    return pack(settle(pieces(docs, capacity, vocabulary), "pieces"), capacity)
