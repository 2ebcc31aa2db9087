"""License scan by ordered signature rules.

Each text becomes its words, lower-cased and joined by single spaces.  A rule is tried
only where its keyword is among the words; its pattern gives intervals of words.  A
detection goes if its interval lies inside one of a better rule: smaller priority
first, then the longer interval, then the earlier rule.  As that order is transitive,
a detection is kept or dropped in one sweep over sorted intervals, at any number of them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_bytes
from tessera.llm.license_rules import CONFIDENCE, Rule, rules

SPAN = "start:bigint,end:bigint,rule:int,label:string,priority:int,base:boolean,kept:boolean"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rule", pa.int32()), ("label", pa.string()), ("priority", pa.int32()), ("base", pa.bool_()), ("kept", pa.bool_())]))
#: Every byte that is no letter, digit or part of a longer character is a space; A-Z are lower-cased.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@functools.lru_cache(maxsize=4096)
def compiled(pattern: str) -> re.Pattern[bytes]:
    """The pattern over words, each behind its space; ``~`` is up to three words."""
    spaced = re.sub(r"^ \(\?:([^()]*) \)\?", r"(?: \1)? ", f" {pattern}")  # an optional first word has its space before it
    return re.compile(spaced.replace(" ~", "(?: [^ ]+){0,3}?").encode() + b"(?= )")


@functools.lru_cache(maxsize=16)
def by_keyword(found: tuple[Rule, ...]) -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    for k, rule in enumerate(found):
        out.setdefault(rule.keyword.encode(), []).append(k)
    return out


def places(words: list[bytes], found: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """First word, last word and rule of every detection, of the rules whose keyword is there."""
    gate = by_keyword(found)
    tried = sorted(k for word in gate.keys() & set(words) for k in gate[word])
    if not tried:
        return []
    line = b" " + b" ".join(words) + b" "
    out = []
    for k in tried:
        at = before = 0
        for m in compiled(found[k].pattern).finditer(line):
            before += line.count(b" ", at, m.start())
            at = m.start()
            out.append((before, before + m.group().count(b" ") - 1, k))
    return out


def kept(spans: list[tuple[int, int, int]], found: tuple[Rule, ...]) -> list[bool]:
    """Whether each span, sorted by start, falling end, priority and rule, lies in no better one.

    Whatever can contain a span comes before it, so the farthest end that each
    priority has reached says whether one does.
    """
    ends = [-1] * (1 + max((found[k].priority for *_, k in spans), default=0))
    out = []
    for _, end, k in spans:
        own = found[k].priority
        out.append(max(ends[: own + 1]) < end)
        ends[own] = max(ends[own], end)
    return out


def detections(text: bytes, found: tuple[Rule, ...]) -> tuple[int, list[tuple]]:
    """Number of words, and the spans of a text with whether each is kept."""
    words = text.translate(FOLD).split()
    spans = sorted(places(words, found), key=lambda s: (s[0], -s[1], found[s[2]].priority, s[2]))
    return len(words), [(a, b, k, found[k].label, found[k].priority, found[k].base, held) for (a, b, k), held in zip(spans, kept(spans, found))]


def scan(docs: DataFrame, signatures: tuple[Rule, ...] | None = None) -> DataFrame:
    """doc_id, n_words and spans (words from 0, rule, label, priority, whether kept) of each document.

    Every row of ``docs`` gives one, nulls and repeats included; a null or empty text
    has no words and no spans.  Whole texts are scanned, one at a time, in a pass
    without a shuffle.  Of a rule's places that overlap each other the first counts.
    Only doc_id and text are read, whatever other columns there are.  An empty table
    gives none.
    """
    found = rules() if signatures is None else signatures
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans = [], []
            for text in batch.column(1):
                n, own = detections(text.as_py(), found)
                counts.append(n)
                spans.append([dict(zip(("start", "end", "rule", "label", "priority", "base", "kept"), s)) for s in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, _SPANS)], ["doc_id", "n_words", "spans"])

    return docs.select("doc_id", text_bytes(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, spans array<struct<{SPAN}>>")


def score(labels: Column, spans: Column) -> Column:
    """How sure it is that a document carries a license: each label counts once, by its surest kept span."""
    sure = lambda label: F.element_at(F.lit(list(CONFIDENCE)), F.array_min(F.transform(F.filter(spans, lambda s: s["label"] == label), lambda s: s["priority"])) + 1)
    return F.lit(1.0) - F.aggregate(labels, F.lit(1.0), lambda left, label: left * (F.lit(1.0) - sure(label)))


def report(docs: DataFrame, signatures: tuple[Rule, ...] | None = None) -> DataFrame:
    """Per document its words, the places and labels of base phrases, all labels, the score and the kept spans.

    A document without base phrases has null first and last words and empty base_labels.
    """
    own = scan(docs, signatures)
    base, held = F.filter("spans", lambda s: s["base"]), F.filter("spans", lambda s: s["kept"])
    own = own.select("doc_id", "n_words", base.alias("base"), held.alias("held"))
    distinct = lambda spans: F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))
    own = own.withColumns({"base_set": distinct("base"), "held_set": distinct("held")})
    return own.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["start"])).alias("first_word"), F.array_max(F.transform("base", lambda s: s["start"])).alias("last_word"),
        F.array_join("base_set", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base_set", "held_set")), ",").alias("labels"),
        score(F.col("held_set"), F.col("held")).alias("score"), F.col("held").alias("spans"),
    )
