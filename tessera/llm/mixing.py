"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent between 0 (all sources alike) and 1
(as they are).  The exponent is bisected until the mix meets its target: at least
a given entropy, or at most a given repetition of the most repeated source.  The
normalised weights become token budgets.  Each source fills its budget with whole
epochs and, for the rest, with the first blocks of a permutation of its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import settle

REPETITION = 1.5
BLOCKS = 1024
SEED = 7
#: Hashes are cut into 2 ** (64 - RANGE_SHIFT) ranges inside the block where a budget runs out.
RANGE_SHIFT = 54
#: Each pass over the sources narrows the exponent to one of so many sections.
SECTIONS, PASSES = 32, 5


def tokens(text: Column) -> Column:
    """Runs of other than ASCII white space; null and blank texts have none."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^ \t-\r]+", "x")
    return F.length(F.translate(words, " \t\n\x0b\x0c\r", "")).cast("long")


def source_shares(sizes: DataFrame) -> DataFrame:
    """source, tokens and share; sources without tokens have no share and no row."""
    by = settle(sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "mix-sources")
    total = by.agg(F.sum("tokens")).first()[0] or 1
    return by.select("source", "tokens", (F.col("tokens") / F.lit(total)).alias("share"))


def exponent(shares: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None) -> float:
    """The largest exponent, up to 1, whose mix has at least ``entropy`` (of its
    greatest, log of the number of sources) or, without that, the smallest whose
    most repeated source is seen at most ``repetition`` times as often as the
    least repeated one.

    Sums over the sources are taken by Spark for all section marks of a pass at
    once, so the number of sources is not bounded.
    """
    low, high = 0.0, 1.0
    log_share = F.log("share")
    ends = shares.agg(F.min(log_share), F.max(log_share), F.count("*")).first()
    if not ends[2] or ends[2] == 1:
        return 1.0
    for _ in range(PASSES):
        marks = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        if entropy is not None:
            wanted = entropy * math.log(ends[2])
            sums = shares.agg(*[f for m in marks for f in (F.sum(F.exp(log_share * m)), F.sum(F.exp(log_share * m) * log_share))]).first()
            good = [math.log(sums[2 * i]) - m * sums[2 * i + 1] / sums[2 * i] >= wanted for i, m in enumerate(marks)]
            if good[-1]:
                return marks[-1]
            last = max((i for i, g in enumerate(good) if g), default=0)
            low, high = marks[last], marks[min(last + 1, SECTIONS)]
        else:
            # a source's repetition follows share ** (exponent - 1), so its extremes are those of the shares
            good = [(1 - m) * (ends[1] - ends[0]) <= math.log(repetition or 1.0) + 1e-12 for m in marks]
            first = min(i for i, g in enumerate(good) if g)
            if first == 0:
                return marks[0]
            low, high = marks[first - 1], marks[first]
    return low if entropy is not None else high


def plan(shares: DataFrame, power: float, budget: int | None = None) -> DataFrame:
    """source, tokens, share, weight and budget of each source.

    Without a budget the mix is as large as it must be to show every document at
    least once: the least repeated source is seen exactly once.
    """
    raw = shares.withColumn("raw", F.exp(F.log("share") * power))
    total, least = raw.agg(F.sum("raw"), F.min(F.col("raw") / F.col("tokens"))).first()
    mixed = raw.withColumn("weight", F.col("raw") / F.lit(total or 1.0))
    target = F.col("raw") / F.lit(least or 1.0) if budget is None else F.col("weight") * F.lit(float(budget))
    return mixed.select("source", "tokens", "share", "weight", F.floor(target + 1e-6).cast("long").alias("budget"))


def realise(sizes: DataFrame, planned: DataFrame, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """One row for each time that a document is shown: doc_id, source, tokens, epoch, block, block_order, weight.

    Documents fall into a fixed number of blocks of their source by a hash.  In
    the last, partial epoch the blocks come in a permuted order until the budget
    is spent; inside the block where it runs out, documents come in hash order,
    and the one that crosses the line is the last.  Only the blocks' sums are
    ordered over a whole source, and inside that block only the sums of ranges of
    hashes, so neither a hot source nor its last block is ever in one task.
    """
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).cast("int")
    rows = settle(sizes.withColumn("block", block), "mix-rows")
    sums = rows.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    turn = F.xxhash64("block", "source", F.lit(seed + 1))
    order = Window.partitionBy("source").orderBy(turn, "block")
    starts = (
        sums.join(planned.select(F.col("source").alias("s"), "weight", "budget", F.col("tokens").alias("source_tokens")), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("block_order", F.row_number().over(order) - 1)
        .withColumn("before", F.sum("block_tokens").over(order) - F.col("block_tokens"))
        .withColumn("epochs", F.floor(F.col("budget") / F.col("source_tokens")).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_tokens") - F.col("before"))
        .select(F.col("source").alias("s"), F.col("block").alias("b"), "weight", "block_order", "epochs", "rest", (F.col("rest") < F.col("block_tokens")).alias("edge"))
    )
    joined = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    partial = F.col("rest") > 0
    edge = joined.where(partial & F.col("edge")).withColumn("turn", F.xxhash64("doc_id", F.lit(seed + 2))).withColumn("range", F.shiftright("turn", RANGE_SHIFT))
    ranges = edge.groupBy(F.col("source").alias("rs"), F.col("block").alias("rb"), F.col("range").alias("rr")).agg(F.sum("tokens").alias("range_tokens"))
    earlier = F.sum("range_tokens").over(Window.partitionBy("rs", "rb").orderBy("rr")) - F.col("range_tokens")
    ranges = ranges.select("rs", "rb", "rr", earlier.alias("earlier"))
    edge = edge.join(ranges, F.col("source").eqNullSafe(F.col("rs")) & (F.col("block") == F.col("rb")) & (F.col("range") == F.col("rr")))
    inside = Window.partitionBy("source", "block", "range").orderBy("turn", "doc_id")
    edge = edge.withColumn("seen", F.col("earlier") + F.sum("tokens").over(inside) - F.col("tokens"))
    columns = ["doc_id", "source", "tokens", "block", "block_order", "weight", "epochs"]
    last = joined.where(partial & ~F.col("edge")).select(columns).unionByName(edge.where("seen < rest").select(columns)).select(*columns[:-1], F.col("epochs").alias("epoch"))
    whole = joined.where("epochs > 0").select(*columns[:-1], F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
    return whole.unionByName(last)


def mix(docs: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """How often and where each document is shown; see ``realise`` for the columns.

    Tokens are white-space words.  A null source is a source of its own.  Rows that
    repeat (doc_id, source) are one document whose tokens add up.  A source
    without any token has no share; its documents are shown once, with weight 0,
    if there is no budget, and not at all otherwise.  An empty table gives no rows.
    """
    sizes = settle(docs.select("doc_id", "source", tokens(F.col("text")).alias("tokens")).groupBy("doc_id", "source").agg(F.sum("tokens").alias("tokens")), "mix-sizes")
    shares = source_shares(sizes)
    planned = settle(plan(shares, exponent(shares, repetition, entropy), budget), "mix-plan")
    shown = realise(sizes, planned)
    if budget is None:
        blank = sizes.join(shares.select(F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")), "left_anti")
        shown = shown.unionByName(blank.select("doc_id", "source", "tokens", F.lit(0).alias("block"), F.lit(0).alias("block_order"), F.lit(0.0).alias("weight"), F.lit(0).alias("epoch")))
    return shown


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents' rows, each as often as the mix shows it; the columns stay as they are."""
    times = mix(docs, **settings).groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source")).agg(F.count("*").cast("int").alias("times"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source")
    found = rows.join(times, F.col("doc_id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source")))
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])
