"""Removal of repeated passages by content-defined line chunks.

A text is cut into lines and its lines into chunks.  A chunk ends where a rolling
hash over the hashes of the last two lines falls into the first of ``CLASSES``
classes and did not one line before.  That depends on three lines alone, so equal
passages are cut alike wherever they stand, and chunks have two lines at least.
Chunks whose hash occurs more than once are compared byte by byte, and all but the
first are removed.  With ``passage_words`` the shortest runs of lines of more words
are compared too, which are found at any line, so that a repeated passage of more
words goes whole.  Everything here is a DataFrame expression; no Python runs on the
executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle, split_join

#: Chunks have 4.5 lines in the mean.
CLASSES = 3
#: First and last line of a span as one number.
SPAN_BASE = 1 << 31


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5, as a number."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def cut(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, the lines of each text, their marks and the numbers (from 1) of the lines that end chunks.

    ``inline`` over a single struct keeps each array a computed column, so that
    the lambdas below read it instead of computing it anew for every element.
    """
    out = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    out = one(out, "line", F.split("text", "\n", -1)).drop("text")
    out = one(out, "mark", F.transform("line", line_hash))

    def ends(i: Column) -> Column:
        at = lambda k: F.element_at("mark", k.cast("int"))
        n = F.size("mark")

        def first_class(k: Column) -> Column:
            before = F.when(k > 1, at(F.greatest(k - 1, F.lit(1)))).otherwise(F.lit(0))
            return (at(F.greatest(k, F.lit(1))) + before * 31) % CLASSES == 0

        return (i == n) | (first_class(i) & ((i == 1) | ~first_class(i - 1)))

    return one(out, "ending", F.filter(F.sequence(F.lit(1), F.size("line")), ends))


def one(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], F.inline(F.array(F.struct(value.alias(name)))))


def chunk_spans() -> Column:
    """First and last line of each chunk of two or more lines."""

    def span(end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(1)).otherwise(F.element_at("ending", F.greatest(k, F.lit(1)).cast("int")) + 1)
        return F.struct(start.alias("a"), end.alias("b"))

    return F.filter(F.transform("ending", span), lambda s: s["b"] > s["a"])


def run_spans(passage_words: int) -> Column:
    """First and last line of the shortest runs of over ``passage_words`` words from each line on, and up to each line.

    Together they cover every passage of more words, wherever it lies.  Runs start
    and end with lines that have words, so each has at most passage_words + 1 of those.
    """
    one_word, full = 1 << 24, (passage_words + 1) << 24

    def runs(words: Column, filled: Column, back: bool) -> Column:
        def run(start: Column, k: Column) -> Column:
            # words and lines so far, as one number
            step = lambda so_far, n: F.when(so_far >= full, so_far).otherwise(so_far + n.cast("long") * one_word + 1)
            sums = F.aggregate(F.slice(words, k + 1, passage_words + 1), F.lit(0).cast("long"), step)
            end = F.element_at(filled, (k + F.greatest(F.pmod(sums, F.lit(one_word)), F.lit(1))).cast("int"))
            return F.when(sums >= full, F.struct((end if back else start).alias("a"), (start if back else end).alias("b")))

        return F.transform(filled, run)

    return F.array_compact(F.concat(runs(F.col("filled_words"), F.col("filled"), False), runs(F.col("back_words"), F.col("back"), True)))


def spans(cuts: DataFrame, passage_words: int | None) -> DataFrame:
    """``cuts`` with its chunks, and with ``passage_words`` its runs, each once, as ``span``."""
    if passage_words is None:
        return one(cuts, "span", chunk_spans())
    out = one(cuts, "words", F.transform("line", lambda x: F.regexp_count(x, F.lit(r"\S+"))))
    out = one(out, "filled", F.filter(F.sequence(F.lit(1), F.size("line")), lambda i: F.element_at("words", i) > 0))
    out = one(out, "filled_words", F.filter("words", lambda n: n > 0)).drop("words")
    out = one(one(out, "back", F.reverse("filled")), "back_words", F.reverse("filled_words"))  # computed once a text, not in the lambdas
    # spans as single numbers: arrays of structs are made distinct by comparing all pairs
    packed = F.array_distinct(F.transform(F.concat(chunk_spans(), run_spans(passage_words)), lambda s: s["a"].cast("long") * SPAN_BASE + s["b"]))
    return one(out, "span", F.transform(packed, lambda p: F.struct(F.shiftright(p, 31).cast("int").alias("a"), F.pmod(p, F.lit(SPAN_BASE)).cast("int").alias("b"))))


def span_text(s: Column) -> Column:
    return F.array_join(F.slice("line", s["a"], s["b"] - s["a"] + 1), "\n")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``at`` of doc_id and a hash of the text, which tells rows with one id, or none, apart."""
    return docs.withColumn("at", F.struct("doc_id", F.xxhash64("text").alias("h")))


def same_row() -> Column:
    return F.col("at.doc_id").eqNullSafe(F.col("id.doc_id")) & (F.col("at.h") == F.col("id.h"))


def removals(docs: DataFrame, passage_words: int | None = None) -> DataFrame:
    """id (doc_id and hash of the text) and the spans of lines to remove.

    Of equal spans the one with the smallest (doc_id, hash, line) stays; null ids
    come first.  Lines that a span shares with the one that stays, stay too.  Only
    hashes are dealt to find repeats; the texts of repeats are gathered by hash,
    pre-aggregated, as their smallest and largest: where those are equal, all are.
    """
    rows = keyed(docs.select("doc_id", "text"))
    spread = spans(cut(rows, "at"), passage_words).select("at", "line", F.explode("span").alias("s"))
    keys = settle(spread.select("at", "s", F.xxhash64(span_text(F.col("s"))).alias("key")), "span-keys")
    again = settle(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "span-repeats")
    total = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    suspect = settle(split_join(keys, again, ["key"], "n", ["at", "s"], total=total).select("key", "at", "s"), "span-suspects")
    of_row = suspect.groupBy(F.col("at").alias("id")).agg(F.collect_set(F.struct("s", "key")).alias("spans"))
    texts = (
        rows.join(of_row, same_row())
        .select("at", "spans", F.split("text", "\n", -1).alias("line"))
        .select("at", "line", F.explode("spans").alias("x"))
        .select("at", F.col("x.s").alias("s"), F.col("x.key").alias("key"), span_text(F.col("x.s")).alias("text"))
    )
    first = F.min(F.struct("at", "s")).alias("first")
    found = settle(texts.groupBy("key").agg(first, F.count("*").alias("n"), F.min("text").alias("low"), F.max("text").alias("high")).select("key", "first", "n", (F.col("low") == F.col("high")).alias("equal")), "span-firsts")
    others = split_join(suspect, found.where("equal and n > 1").drop("equal"), ["key"], "n", ["at", "s"], total=total).select("at", "s", "first")
    # hashes that different texts share are rare: their texts are told apart themselves
    mixed = settle(texts.join(found.where("not equal").select("key"), "key", "left_semi"), "span-collisions")
    apart = mixed.groupBy("text").agg(first, F.count("*").alias("n")).where("n > 1")
    others = others.unionByName(mixed.join(apart.drop("n"), "text").select("at", "s", "first")).where(~F.struct("at", "s").eqNullSafe(F.col("first")))
    start = F.when(F.col("at").eqNullSafe(F.col("first.at")), F.greatest("s.a", F.col("first.s.b") + 1)).otherwise(F.col("s.a"))
    gone = others.select(F.col("at").alias("id"), F.struct(start.alias("a"), F.col("s.b").alias("b")).alias("s")).where("s.a <= s.b")
    return gone.groupBy("id").agg(F.collect_set("s").alias("gone"))


def dedup(docs: DataFrame, passage_words: int | None = None) -> DataFrame:
    """The documents with repeated passages removed from their texts; all rows stay.

    Removed are repeated chunks and, with ``passage_words``, the lines of every
    repeated run of more words; each line's first place stays.  Adds no column.  A text all of whose chunks occurred before becomes empty; a
    null text stays null.  Rows that repeat a doc_id with the same text are one
    document seen twice and share its fate; rows with one doc_id, or none, and
    different texts are different documents.  An empty table stays empty.
    """
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    rows = keyed(docs.select(rest.alias("row"), "doc_id", "text"))
    found = rows.join(settle(removals(docs, passage_words), "line-removals"), same_row(), "left")
    hit = found.where("gone is not null").select("row", "gone", F.split("text", "\n", -1).alias("line")).select("row", kept_text().alias("text"))
    both = found.where("gone is null").select("row", "text").unionByName(hit)
    return both.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def kept_text() -> Column:
    numbers = F.flatten(F.transform("gone", lambda s: F.sequence(s["a"], s["b"])))
    left = F.array_except(F.sequence(F.lit(1), F.size("line")), numbers)
    return F.array_join(F.transform(left, lambda k: F.element_at("line", k.cast("int"))), "\n")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, chunks, removed_chunks, kept_chars and kept_md5 of each document."""
    rows = keyed(docs.select("doc_id", "text")).join(removals(docs), same_row(), "left")
    gone = F.coalesce("gone", F.array().cast("array<struct<a:int,b:int>>"))
    return cut(rows.withColumn("gone", gone), "doc_id", "gone").withColumn("kept", kept_text()).select(
        "doc_id", F.size("ending").cast("long").alias("chunks"), F.size("gone").cast("long").alias("removed_chunks"),
        F.length("kept").cast("long").alias("kept_chars"), F.md5(F.col("kept").cast("binary")).alias("kept_md5"),
    )


ORACLE = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents
), marks as (
  select doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::bigint as h from lines
), classed as (
  select *, (h + coalesce(lag(h) over (partition by doc_id order by i), 0) * 31) % {CLASSES} = 0 as first_class from marks
), ends as (
  select *, (lead(i) over w is null or (first_class and not coalesce(lag(first_class) over w, false))) as ending from classed
  window w as (partition by doc_id order by i)
), numbered as (
  select *, coalesce(sum(ending::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as number from ends
), chunks as (
  select doc_id, number, count(*) as lines, string_agg(line, chr(10) order by i) as text from numbered group by 1, 2
), marked as (
  select *, lines > 1 and row_number() over (partition by text, lines > 1 order by doc_id, number) > 1 as gone from chunks
)
select doc_id, count(*)::bigint as chunks, count(*) filter (where gone)::bigint as removed_chunks,
  length(coalesce(string_agg(text, chr(10) order by number) filter (where not gone), ''))::bigint as kept_chars,
  md5(coalesce(string_agg(text, chr(10) order by number) filter (where not gone), '')) as kept_md5
from marked group by 1
"""
