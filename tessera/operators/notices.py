"""Notice boards: order, numbering, pages, dates, images and media limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import is_blank, slug

PAGE_SIZE, MOST_IMAGES, IMAGE_BYTES = 8, 5, 2 * 1024 * 1024
ZONE = "Asia/Seoul"
#: Fixed value: the word between a notice's title and an image's number.
IMAGE_WORDS = "안내 이미지"


def valid(notices: DataFrame) -> DataFrame:
    """Notices with a title and a readable date; no images is an empty list."""
    typed = notices.withColumns({"posted_at": F.try_to_timestamp(F.col("posted_at").cast("string")), "images": F.coalesce("images", F.array().cast("array<string>"))})
    return typed.where(~is_blank(F.col("title")) & F.col("posted_at").isNotNull())


def rooted(images: Column, folder: str = "public/notices/") -> Column:
    """Paths under the public notices folder become root-relative; others stay."""
    return F.transform(images, lambda x: F.when(x.startswith(folder), F.concat(F.lit("/notices/"), F.substring(x, F.lit(len(folder) + 1), F.length(x)))).otherwise(x))


def numbered(notices: DataFrame, board: str, posted: str, ident: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """Newest first within each board: position (from 1), reverse number, page and pages.

    Only the days' counts are ordered over a whole board; notices are ordered within
    their day, so a large board is never in one task.
    """
    day = F.col(posted).cast("date")
    days = notices.groupBy(F.col(board).alias("_board"), day.alias("_day")).agg(F.count("*").alias("_n"))
    later = Window.partitionBy("_board").orderBy(F.col("_day").desc())
    days = days.withColumns({"_before": F.sum("_n").over(later) - F.col("_n"), "total": F.sum("_n").over(Window.partitionBy("_board"))})
    inside = Window.partitionBy(board, "_posted_day").orderBy(F.col(posted).desc(), ident)
    dated = notices.withColumn("_posted_day", day)
    ranked = dated.join(days, F.col(board).eqNullSafe(F.col("_board")) & F.col("_posted_day").eqNullSafe(F.col("_day")))
    ranked = ranked.withColumn("position", (F.col("_before") + F.row_number().over(inside)).cast("int")).drop("_board", "_day", "_n", "_before", "_posted_day")
    return ranked.withColumns({
        "number": F.col("total") - F.col("position") + 1,
        "page": (F.floor((F.col("position") - 1) / page_size) + 1).cast("int"),
        "pages": F.ceil(F.col("total") / page_size).cast("int"),
    }).drop("total")


def local(at: Column, zone: str = ZONE) -> Column:
    """A time without zone, meant as UTC, in the zone's local time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), at)


def iso_day(at: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(at, zone), "yyyy-MM-dd")


def long_day(at: Column, zone: str = ZONE) -> Column:
    return F.date_format(local(at, zone), "yyyy년 M월 d일")


def image_alts(title: Column, images: Column) -> Column:
    return F.transform(images, lambda x, k: F.concat(title, F.lit(f" {IMAGE_WORDS} "), (k + 1).cast("string")))


def detail(notices: DataFrame, ident: str | Column, key: str = "id") -> DataFrame:
    """One notice with its lead image, null if it has none."""
    return notices.where(F.col(key) == ident).withColumn("lead_image", F.try_element_at("images", F.lit(1)))


def media_problems(uploads: DataFrame, keys: list[str], name: str, size: str, order: str, most: int = MOST_IMAGES, limit: int = IMAGE_BYTES) -> DataFrame:
    """Keys with too many images or one that is too large; the first such one is named."""
    big = F.col(size) > limit
    found = uploads.groupBy(*keys).agg(F.count("*").alias("images"), F.count_if(big).alias("too_large"), F.min_by(name, F.when(big, F.col(order))).alias("first_large"))
    return found.where((F.col("images") > most) | (F.col("too_large") > 0)).withColumn("first_large", F.when(F.col("too_large") > 0, F.col("first_large")))


def file_id(posted: Column, title: Column, zone: str = ZONE) -> Column:
    return F.concat(iso_day(posted, zone), F.lit("-"), slug(title))
