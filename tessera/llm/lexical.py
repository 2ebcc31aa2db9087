"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, without random accesses.

Items are taken in bands of bounded text, so that the terms that tasks hold are bounded
by a parameter.  For a band every document becomes its length and the counts of the
band's terms; the corpus counts are sums over those.  Each task cuts its documents into
lanes.  In a lane every term has one list, sorted by falling impact.  An item goes down
its lists in step; each document that is met has a lower bound (the impacts read) and an
upper bound (plus the last impact of the lists where it was not met).  Reading ends
when no document outside the best k can reach them and all that might tie have equal
bounds.  A task carries its best k from lane to lane, and tasks' bests meet by rank.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import settle, text_bytes
from tessera.llm.license_scan import FOLD

K = 10
#: Bytes of item texts in a band, documents and postings in a lane, entries that a list gives first.
BAND_BYTES, LANE_ROWS, LANE_POSTINGS, FIRST_READ = 8 << 20, 65_536, 4_000_000, 64


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n and the counts of the vocabulary's terms of each document that has any term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows, lengths, found, counts = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                words = terms(text.as_py())
                if words:
                    own = Counter(map(known.get, words))
                    own.pop(None, None)
                    rows.append(k)
                    lengths.append(len(words))
                    found.append(list(own.keys()))
                    counts.append(list(own.values()))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", text_bytes(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, counts array<long>")


def weight(n: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def impacts(n: np.ndarray, counts: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term's weight is multiplied by, for documents of n terms; whole numbers throughout."""
    if len(n) and 75 * int(n.max()) * documents >= 1 << 63:
        raise OverflowError("75 times a document's terms times the number of documents leaves 64 bits")
    m = 25 + 75 * n * documents // length
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


class Lane:
    """The impact-sorted lists of some documents."""

    def __init__(self, ids: pa.Array, n: np.ndarray, sizes: np.ndarray, found: np.ndarray, counts: np.ndarray, weights: np.ndarray, corpus: tuple[int, int]):
        self.ids, self.rows = ids, len(n)
        row = np.repeat(np.arange(len(n)), sizes)
        value = weights[found] * impacts(n[row], counts, *corpus)
        order = np.lexsort((row, -value, found))
        self.row, self.value = row[order], value[order]
        self.starts = np.searchsorted(found[order], np.arange(len(weights) + 1))

    def lists(self, asked: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and falling contributions of each term of an item, times its repeats."""
        spans = ((self.starts[t], self.starts[t + 1], times) for t, times in asked)
        return [(self.row[a:b], self.value[a:b] * times) for a, b, times in spans if a < b and self.value[a] > 0]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], rows: int, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows that may be among the best k, ties of the kth included, their exact scores, and the entries read.

    ``known`` are scores met elsewhere, falling; rows below the kth of those and these
    are left out.
    """
    lower = np.zeros(rows, np.int64)
    met = np.zeros(rows, bool)
    depth, step, read = [0] * len(lists), FIRST_READ, 0
    while True:
        bounds = []
        for j, (row, value) in enumerate(lists):
            to = min(depth[j] + step, len(row))
            lower[row[depth[j] : to]] += value[depth[j] : to]  # a list has a document once
            met[row[depth[j] : to]] = True
            read += to - depth[j]
            depth[j] = to
            bounds.append(int(value[to - 1]) if to < len(row) else 0)
        step = sum(depth) // max(1, len(lists)) or FIRST_READ
        rest = sum(bounds)
        at = np.flatnonzero(met)
        best = np.sort(np.concatenate([lower[at], known]))[::-1]
        least = max(int(best[k - 1]), 1) if len(best) >= k else 1
        if rest >= least:  # a document not met yet may be among the best
            continue
        slack = np.full(rows, rest)
        for (row, _), to, bound in zip(lists, depth, bounds):
            if bound:
                slack[row[:to]] -= bound
        open_to = at[lower[at] + slack[at] >= least]
        if not slack[open_to].any():
            return open_to, lower[open_to], read


def merged(k: int, *parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of (ids, whether null, scores), highest first, ties to the smaller id, null ids last."""
    ids, null, scores = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, null, -scores))[:k]
    return ids[order], null[order], scores[order]


def searched(held: DataFrame, asked: dict[int, list[tuple[int, int]]], weights: np.ndarray, corpus: tuple[int, int], k: int) -> DataFrame:
    """item, doc_id and score: the best k of every task's documents for each item."""
    shared = held.sparkSession.sparkContext.broadcast((asked, weights))

    def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[Lane]:
        parts: list[tuple] = []
        rows = entries = 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                sizes = np.diff(batch.column(2).offsets.to_numpy())
                parts.append((batch.column(0), batch.column(1).to_numpy(), sizes, batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()))
                rows, entries = rows + batch.num_rows, entries + int(sizes.sum())
            if parts and (batch is None or rows >= LANE_ROWS or entries >= LANE_POSTINGS):
                ids, *others = zip(*parts)
                yield Lane(pa.concat_arrays(ids), *(np.concatenate(x) for x in others), shared.value[1], corpus)
                parts, rows, entries = [], 0, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best: dict[int, tuple] = {}
        for lane in lanes(batches):
            null = lane.ids.is_null().to_numpy(zero_copy_only=False)
            ids = lane.ids.fill_null(0).to_numpy()
            for item, wanted in shared.value[0].items():
                lists = lane.lists(wanted)
                if lists:
                    so_far = best.get(item, nothing)
                    at, scores, _ = nra(lists, lane.rows, k, so_far[2])
                    best[item] = merged(k, so_far, (ids[at], null[at], scores))
        for item, (own, null, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), item)), pa.array(own, mask=null), pa.array(scores)], ["item", "doc_id", "score"])

    return held.select(F.col("doc_id").cast("long"), "n", "terms", "counts").where(F.size("terms") > 0).mapInArrow(run, "item long, doc_id long, score long")


def band_of(items: DataFrame, band: int, bands: int) -> tuple[dict[bytes, int], dict[int, list[tuple[int, int]]]]:
    """The terms of a band of items, numbered, and each item's terms with their repeats; a bounded text."""
    vocabulary: dict[bytes, int] = {}
    asked = {}
    for r in items.where(F.pmod(F.xxhash64("item"), F.lit(bands)) == band).select("item", text_bytes(F.col("text")).alias("text")).toLocalIterator():
        own = Counter(terms(bytes(r.text)))
        asked[r.item] = [(vocabulary.setdefault(t, len(vocabulary)), times) for t, times in own.items()]
    return vocabulary, asked


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, band_bytes: int = BAND_BYTES) -> DataFrame:
    """item_id, rank from 1, doc_id and score of each item's k best documents.

    Only scores above 0 count; equal scores go by doc_id, null ids last.  Each row of
    ``docs`` is a document; one with a null or empty text, or without terms, takes no
    part.  Rows of ``items`` that repeat id and text are one item, rows of one id, or
    none, and different texts are items of their own.  Empty tables give no rows.
    Only doc_id, text and item_id are read, whatever other columns there are.  A band
    holds about ``band_bytes`` of items' texts, one longer item at most.  Sums that leave
    64 bits are an error.
    """
    spark = docs.sparkSession
    numbered = settle(items.select("item_id", "text").where("text is not null").distinct().withColumn("item", F.monotonically_increasing_id()), "search-items")
    total = numbered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bands = max(1, -(-total // band_bytes))
    found = None
    for band in range(bands):
        vocabulary, asked = band_of(numbered, band, bands)
        held = settle(postings(docs, vocabulary), "search-postings")
        corpus = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for t, n in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most a row a term of the band
            df[t] = n
        part = searched(held, asked, weight(corpus[0], df), (corpus[0], max(1, corpus[1])), k)
        found = part if found is None else found.unionByName(part)
    own = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    first = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return first.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
with rowed as materialized (select row_number() over () as d, doc_id, {_TERMS} as words from documents),
docs as materialized (select d, doc_id, words, len(words) as n from rowed where len(words) > 0),
corpus as (select count(*)::bigint as big_n, sum(n)::bigint as l from docs),
items as materialized (select row_number() over () as i, item_id, {_TERMS} as words from (select distinct item_id, text from benchmark where text is not null)),
asked as (select i, t, count(*)::bigint as times from (select i, unnest(words) as t from items) group by 1, 2),
held as materialized (select d, t, count(*)::bigint as tf from (select d, unnest(words) as t from docs) where t in (select t from asked) group by 1, 2),
weights as (select t, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double))::bigint as w from (select t, count(*)::bigint as df from held group by 1), corpus),
scored as (
  select i, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // l))))::bigint as score
  from asked join held using (t) join weights using (t) join docs using (d), corpus group by 1, 2
)
select item_id, rank::int as rank, doc_id, score from (
  select item_id, doc_id, score, row_number() over (partition by i order by score desc, doc_id) as rank from scored join docs using (d) join items using (i) where score > 0
) where rank <= {K}
"""
