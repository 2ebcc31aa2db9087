"""Position-by-position comparison of two versions of the same documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.001


def sides(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full join by position: each value as l_ and r_, and which sides have the row."""
    one = lambda df, s: df.select(*keys, *[F.col(v).alias(f"{s}_{v}") for v in values], F.lit(True).alias(f"{s}_here"))
    return one(left, "l").join(one(right, "r"), keys, "full").withColumns({"l_here": F.coalesce("l_here", F.lit(False)), "r_here": F.coalesce("r_here", F.lit(False))})


def count_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose numbers of rows differ, with both numbers."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = n(left, "l_rows").join(n(right, "r_rows"), keys, "full").select(*keys, F.coalesce("l_rows", F.lit(0)).alias("l_rows"), F.coalesce("r_rows", F.lit(0)).alias("r_rows"))
    return both.where("l_rows <> r_rows")


def text_differences(both: DataFrame, text: str = "str") -> DataFrame:
    """Positions on both sides whose texts differ."""
    return both.where(F.col("l_here") & F.col("r_here") & ~F.col(f"l_{text}").eqNullSafe(F.col(f"r_{text}")))


def offset(values: list[str]) -> Column:
    """The largest absolute difference of paired values."""
    gaps = [F.abs(F.col(f"l_{v}") - F.col(f"r_{v}")) for v in values]
    return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]


def compared(left: DataFrame, right: DataFrame, keys: list[str], text: str | None, values: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Aligned positions with kind ``text`` or ``moved`` where they differ, and their offset.

    Where texts differ, geometry is not compared; offsets within tolerance stay
    for the summary's worst offset.
    """
    both = sides(left, right, keys, [*([text] if text else []), *values]).where(F.col("l_here") & F.col("r_here"))
    other = ~F.col(f"l_{text}").eqNullSafe(F.col(f"r_{text}")) if text else F.lit(False)
    gap = F.when(~other, offset(values)) if values else F.lit(None).cast("double")
    return both.withColumn("offset", gap).withColumn("kind", F.when(other, "text").when(F.col("offset") > tolerance, "moved"))


def size_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    both = sides(left, right, ["doc_id", "page"], ["width", "height"])
    return both.where(F.col("l_here") & F.col("r_here") & ((F.col("l_width") != F.col("r_width")) | (F.col("l_height") != F.col("r_height"))))


def summary(differences: DataFrame, aligned: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row a document: identical, differences, worst offset, and the first difference.

    ``differences`` has doc_id, rank and message; ``aligned`` doc_id and offset.
    """
    bad = differences.groupBy("doc_id").agg(F.count("*").alias("differences"), F.min_by("message", "rank").alias("first"))
    worst = aligned.groupBy("doc_id").agg(F.max("offset").alias("worst_offset"), F.count("*").alias("compared"))
    out = subjects.join(bad, "doc_id", "left").join(worst, "doc_id", "left")
    n = F.coalesce("differences", F.lit(0))
    text = F.when(n > 1, F.concat("first", F.lit(" (and "), (n - 1).cast("string"), F.lit(" more)"))).otherwise(F.col("first"))
    return out.select("doc_id", (n == 0).alias("identical"), n.alias("differences"), F.coalesce("worst_offset", F.lit(0.0)).alias("worst_offset"), F.coalesce("compared", F.lit(0)).alias("compared"), text.alias("summary"))


def document_differences(l_pages: DataFrame, r_pages: DataFrame, l_runs: DataFrame, r_runs: DataFrame, l_rules: DataFrame, r_rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(differences, aligned rows with offsets) of two versions of many documents."""
    doc, page = F.col("doc_id"), F.lit(0)

    def rows(df: DataFrame, rank: list[Column], message: Column) -> DataFrame:
        parts = [x.cast("long") for x in rank] + [F.lit(0).cast("long")] * (4 - len(rank))
        return df.select("doc_id", F.array(*parts).alias("rank"), message.alias("message"))

    runs = compared(l_runs, r_runs, ["doc_id", "page", "idx"], "str", ["x", "y", "w"])
    rules = compared(l_rules, r_rules, ["doc_id", "page", "idx"], None, ["page_y", "width"])
    p = F.col("page")
    parts = [
        rows(count_differences(l_pages, r_pages, ["doc_id"]), [page], F.format_string("%d pages versus %d", "l_rows", "r_rows")),
        rows(size_differences(l_pages, r_pages), [p, F.lit(1)], F.format_string("page %d differs in size", "page")),
        rows(count_differences(l_runs, r_runs, ["doc_id", "page"]), [p, F.lit(2)], F.format_string("page %d has %d text runs versus %d", "page", "l_rows", "r_rows")),
        rows(runs.where("kind = 'text'"), [p, F.lit(3), F.col("idx")], F.format_string("page %d text run %d differs", "page", "idx")),
        rows(runs.where("kind = 'moved'"), [p, F.lit(3), F.col("idx")], F.format_string("page %d moves text run %d by %.3f points", "page", "idx", "offset")),
        rows(count_differences(l_rules, r_rules, ["doc_id", "page"]), [p, F.lit(4)], F.format_string("page %d has %d response rules versus %d", "page", "l_rows", "r_rows")),
        rows(rules.where("kind = 'moved'"), [p, F.lit(5), F.col("idx")], F.format_string("page %d moves a response rule by %.3f points", "page", "offset")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out, runs.select("doc_id", "offset").unionByName(rules.select("doc_id", "offset"))


def raster_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_id, page, comparable, channels, differing and worst delta of decoded page images.

    Rasters (doc_id, page, width, height, channels, pixels BINARY) meet by page; a
    page whose shape differs is not compared.  Pixels are bytes, compared by numpy
    one page at a time.
    """
    both = sides(left, right, ["doc_id", "page"], ["width", "height", "channels", "pixels"]).where("l_here and r_here")
    same = (F.col("l_width") == F.col("r_width")) & (F.col("l_height") == F.col("r_height")) & (F.col("l_channels") == F.col("r_channels")) & (F.octet_length("l_pixels") == F.octet_length("r_pixels"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if not r.comparable:
                    out.append((r.doc_id, r.page, False, 0, 0, 0))
                    continue
                gap = np.abs(np.frombuffer(r.l_pixels, np.uint8).astype(np.int16) - np.frombuffer(r.r_pixels, np.uint8))
                out.append((r.doc_id, r.page, True, len(gap), int((gap > 0).sum()), int(gap.max(initial=0))))
            yield pd.DataFrame(out, columns=["doc_id", "page", "comparable", "channels", "differing", "worst_delta"])

    kind = dict(left.dtypes)
    rows = both.select("doc_id", "page", same.alias("comparable"), "l_pixels", "r_pixels")
    return rows.mapInPandas(run, f"doc_id {kind['doc_id']}, page {kind['page']}, comparable boolean, channels long, differing long, worst_delta int")


def verdict(audit: Column, text: Column, pixels: Column) -> Column:
    """All that were looked at hold; pixels count only if they were compared."""
    return audit & text & F.coalesce(pixels, F.lit(True))


def trailing_number(name: Column, ending: str = r"\.png") -> Column:
    return F.regexp_extract(name, rf"(\d+){ending}$", 1).try_cast("int")
