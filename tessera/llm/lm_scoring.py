"""Language-model scoring by cross-entropy difference.

Two word bigram models of the same smoothing share one vocabulary, the words of all
documents: one is counted on the target documents, the other on all documents.  A
document's score is the mean, over its tokens, of its loss under the target model
less its loss under the background model: the lower, the more it looks like the
target.  A document's own counts are left out of both models when it is scored.

Texts are read once, into blocks of word numbers.  A block sends each of its
distinct words and bigrams once, as a hash with its count in the block, to the
partition that counts that range of hashes, and gets the corpus counts back.  So a
gram's number of occurrences never weighs on one task, no model is collected or
broadcast, and what is counted grows with the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle, text_bytes

#: Counts that a bigram's word probability weighs; words among which unknown ones are told apart.
BACKOFF, UNKNOWN_WORDS = 1.0, 1 << 20
#: Words of a block (or one longer text); grams that a counting task holds; blocks of a scoring task.
BLOCK_WORDS, PART_GRAMS, TASK_BLOCKS = 1 << 18, 1 << 20, 8
#: Target ids up to this number are broadcast, 16 bytes each; beyond, the text is dealt once to meet them.
BROADCAST_IDS = 1 << 20
SEED = 42
_CACHE = 1 << 17
#: The marks before and after a text's words, as hashes.
_BEGIN, _END = (np.uint64(xxhash.xxh64_intdigest(x, SEED)) for x in (b"\0begin", b"\0end"))
WORDS, BIGRAMS = 0, 1

_BLOCK = "block long, ids array<long>, lengths array<int>, target array<boolean>, places binary, words binary, tokens long, target_tokens long, grams0 long, grams1 long"


def packed(x: np.ndarray) -> bytes:
    """Compressed by planes: all first bytes, then all second bytes, and so on, as high bytes are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"")


def unpacked(x: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Block:
    """Documents as numbers into the block's sorted distinct word hashes, and their bigrams."""

    def __init__(self, lengths: np.ndarray, places: np.ndarray, words: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        hashes = np.concatenate([words, [_END, _BEGIN]])
        filled = self.lengths[self.lengths > 0]
        ends = np.cumsum(filled + 1)
        last, begin = np.zeros(int((filled + 1).sum()), bool), np.zeros(int((filled + 1).sum()), bool)
        last[ends - 1], begin[ends - filled - 1] = True, True
        self.first, self.second = np.empty(len(last), np.int64), np.empty(len(last), np.int64)
        self.second[~last], self.second[last] = places, len(words)
        self.first[~begin], self.first[begin] = places, len(words) + 1
        self.doc = np.repeat(np.flatnonzero(self.lengths > 0), filled + 1)
        self.word_keys, order = np.unique(_mixed(hashes[:-1]), return_inverse=True)
        self.word_at = np.append(order, order[-1])  # texts begin as often as they end
        pairs = _mixed(hashes[self.first] * np.uint64(0x9E3779B97F4A7C15) + _mixed(hashes[self.second]))
        self.pair_keys, self.pair = np.unique(pairs, return_inverse=True)

    def own(self, place: np.ndarray) -> np.ndarray:
        """How often each token's gram occurs in its document."""
        _, at, counts = np.unique(self.doc * (int(place.max(initial=0)) + 1) + place, return_inverse=True, return_counts=True)
        return counts[at]

    def counts(self, target: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Kind, keys, and the counts of each key in all and in the target documents."""
        of_target = target[self.doc]
        for kind, keys, place in ((WORDS, self.word_keys, self.word_at[self.second]), (BIGRAMS, self.pair_keys, self.pair)):
            yield kind, keys, np.bincount(place, minlength=len(keys)), np.bincount(place[of_target], minlength=len(keys))


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows (doc_id, text bytes, target) as blocks of word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        task, number = TaskContext.get().partitionId(), 0
        ids, target, texts, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            nonlocal ids, target, texts, size, number
            lengths = np.array([len(x) for x in texts], np.int32)
            words, places = np.unique(np.concatenate([np.zeros(0, np.uint64), *texts]), return_inverse=True)
            block = Block(lengths, places, words)
            of_target = np.array(target, bool)
            row = {
                "block": (task << 32) + number, "ids": ids, "lengths": lengths.tolist(), "target": target,
                "places": packed(places.astype(np.uint32)), "words": packed(np.diff(words, prepend=np.uint64(0))),  # sorted, so steps are short
                "tokens": len(block.doc), "target_tokens": int(of_target[block.doc].sum()), "grams0": len(block.word_keys), "grams1": len(block.pair_keys),
            }
            number += 1
            ids, target, texts, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("target", pa.list_(pa.bool_())), ("places", pa.binary()), ("words", pa.binary()), *[(x, pa.int64()) for x in ("tokens", "target_tokens", "grams0", "grams1")]])
        for batch in batches:
            for doc_id, text, of_target in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = text.as_py().lower().split()
                if len(cache) > _CACHE:
                    cache.clear()
                for w in set(words).difference(cache):
                    cache[w] = xxhash.xxh64_intdigest(w, SEED)
                ids.append(doc_id)
                target.append(bool(of_target))
                texts.append(np.array([cache[w] for w in words], np.uint64))
                size += len(words)
                if size >= BLOCK_WORDS or len(ids) >= BLOCK_WORDS:
                    yield done()
        if ids:
            yield done()

    return rows.mapInArrow(run, _BLOCK)


def _loaded(row: dict) -> Block:
    words = np.cumsum(unpacked(row["words"], np.uint64), dtype=np.uint64)
    return Block(np.array(row["lengths"], np.int64), unpacked(row["places"], np.uint32).astype(np.int64), words)


def placed(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each key's range of hashes, and 32 bits of its place in that range; both rise with the key."""
    low, high = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)
    at = high * np.uint64(parts) + ((low * np.uint64(parts)) >> np.uint64(32))
    return (at >> np.uint64(32)).astype(np.int64), (at & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _pieces(blocks: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """part (those of words first), block, and the keys' places in that range, as steps, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: tuple[list, ...] = ([], [], [], [], [])
                for kind, keys, count, of_target in _loaded(row).counts(np.array(row["target"], bool)):
                    part, place = placed(keys, parts[kind])
                    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)] if len(keys) else [0]
                    for a, b in zip(cuts, cuts[1:]):
                        piece = int(part[a]) + kind * parts[WORDS], row["block"], *[packed(x.astype(np.uint32)) for x in (np.diff(place[a:b], prepend=0), count[a:b], of_target[a:b])]
                        for column, value in zip(out, piece):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["part", "block", "keys", "background", "target"])

    return blocks.select("block", "lengths", "target", "places", "words").mapInArrow(run, "part int, block long, keys binary, background binary, target binary")


def _counted(pieces: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """The pieces with what the other blocks have of each key in place of the block's own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def done() -> pa.RecordBatch:
            keys = [np.cumsum(unpacked(x["keys"], np.uint32), dtype=np.int64) for x in held]
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            others = []
            for c in ("background", "target"):
                own = np.concatenate([unpacked(x[c], np.uint32) for x in held]).astype(np.int64)
                total = np.bincount(at, weights=own, minlength=len(distinct)).astype(np.int64)
                others.append([packed(x) for x in np.split(total[at] - own, cuts)])
            return pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int32()), pa.array([x["block"] for x in held], pa.int64()), *[pa.array(x, pa.binary()) for x in others]], ["part", "block", "background", "target_counts"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if held:
                        yield done()
                    part, held = row["part"], []
                held.append(row)
        if held:
            yield done()

    dealt = pieces.repartitionById(sum(parts), F.col("part")).sortWithinPartitions("part", "block")
    return dealt.mapInArrow(run, "part int, block long, background binary, target_counts binary")


def _losses(block: Block, target: np.ndarray, found: dict[str, list[np.ndarray]], totals: dict[str, int], backoff: float) -> np.ndarray:
    """Sums of the losses of each document, in the target model and in the background."""
    own_second, own_pair = block.own(block.word_at[block.second]), block.own(block.pair)
    own_first = block.own(block.word_at[block.first])
    size = np.bincount(block.doc, minlength=len(block.lengths))[block.doc]
    out = []
    for model in ("target", "background"):
        words, pairs = found[model]
        less = target[block.doc].astype(np.int64) if model == "target" else np.ones(len(block.doc), np.int64)
        single = (words[block.word_at[block.second]] - less * own_second + 1 / UNKNOWN_WORDS) / (totals[model] - less * size + 1)
        p = (pairs[block.pair] - less * own_pair + backoff * single) / (words[block.word_at[block.first]] - less * own_first + backoff)
        out.append(np.bincount(block.doc, weights=-np.log(p), minlength=len(block.lengths)))
    return np.column_stack(out)


def _scored(blocks: DataFrame, counts: DataFrame, parts: tuple[int, int], totals: dict[str, int], backoff: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held = None, []

        def done() -> pa.RecordBatch:
            block, target = _loaded(row), np.array(row["target"], bool)
            found = {"background": [], "target": []}
            for kind, _, *own in block.counts(target):
                for model, c, n in zip(found, ("background", "target_counts"), own):
                    others = [unpacked(x[c], np.int64) for x in held if (x["part"] >= parts[WORDS]) == bool(kind)]
                    found[model].append(n + np.concatenate([np.zeros(0, np.int64), *others]))
            sums = _losses(block, target, found, totals, backoff)
            tokens = np.where(block.lengths > 0, block.lengths + 1, 0)
            mean = sums / np.maximum(tokens, 1)[:, None]
            return pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(tokens), pa.array(mean[:, 0]), pa.array(mean[:, 1]), pa.array(mean[:, 0] - mean[:, 1])], ["doc_id", "tokens", "target_loss", "background_loss", "score"])

        for batch in batches:
            for x in batch.to_pylist():
                if x["part"] < 0:  # a block comes before its pieces
                    if row is not None:
                        yield done()
                    row, held = x, []
                else:
                    held.append(x)
        if row is not None:
            yield done()

    both = blocks.select("block", F.lit(-1).alias("part"), "ids", "lengths", "target", "places", "words").unionByName(counts, allowMissingColumns=True)
    tasks = max(1, -(-blocks.count() // TASK_BLOCKS))
    return both.repartition(tasks, "block").sortWithinPartitions("block", "part").mapInArrow(run, "doc_id long, tokens long, target_loss double, background_loss double, score double")


def score_documents(docs: DataFrame, target_ids: DataFrame, backoff: float = BACKOFF, part_grams: int = PART_GRAMS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, tokens, target_loss, background_loss and score of each row.

    Tokens are words (runs of other than ASCII white space, A-Z lowered) and the end
    of a text.  A bigram's count is smoothed with ``backoff`` counts of its second
    word's probability, and that with one count that UNKNOWN_WORDS words share.  ``target_ids`` names the target documents by doc_id; all documents
    count for the background.  Null, empty and blank texts have no tokens and zero
    losses.  A null id is never a target.  Repeated rows count and score each; a
    row leaves out its own counts alone.  Without target documents that model is
    uniform.  An empty table gives no rows.
    """
    ids = target_ids.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct().withColumn("target", F.lit(True))
    ids = settle(ids, "target-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(F.col("text")).alias("text"))
    few = ids.count() <= broadcast_ids
    known = texts.where("doc_id is not null") if not few else texts
    rows = known.join(F.broadcast(ids) if few else ids.hint("merge"), F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "target")
    if not few:
        rows = rows.unionByName(texts.where("doc_id is null").withColumn("target", F.lit(False)))
    blocks = settle(_blocks(rows), "word-blocks")
    sums = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "target_tokens", "grams0", "grams1")]).first()
    parts = tuple(max(1, -(-n // part_grams)) for n in sums[2:])
    counts = _counted(_pieces(blocks, parts), parts)
    return _scored(blocks, counts, parts, {"background": sums[0], "target": sums[1]}, backoff)
