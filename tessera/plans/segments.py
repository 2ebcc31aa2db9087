"""Response space as pages: line counts, segments, numbering and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import counted, padded

#: Ruled lines by mode, of a first and of a later page; height of a row in mm.
LINES = {"short-answer": 3, "short-paragraph": 6, "extended-answer": 12}
FIRST_PAGE, LATER_PAGE, ROW_MM = 14, 35, 7
CODES = {"readingComprehension": "C", "criticalThinkingAndAnalysis": "A"}


def response_lines(mode: Column, lines: Column) -> Column:
    """Ruled lines of a mode; null for modes that fill pages."""
    return F.when(mode == "custom-lines", lines).otherwise(F.create_map(*[F.lit(x) for kv in LINES.items() for x in kv])[mode])


def line_segments(lines: Column) -> Column:
    """Array of line counts by page: up to 14 on the first, then up to 35 on each."""
    first = F.least(lines, F.lit(FIRST_PAGE))
    rest = lines - first
    later = F.ceil(rest / LATER_PAGE).cast("int")
    more = F.when(later > 0, F.transform(F.sequence(F.lit(1), F.greatest(later, F.lit(1))), lambda k: F.least(rest - (k - 1) * LATER_PAGE, F.lit(LATER_PAGE)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(lines.isNotNull(), F.concat(F.array(first.cast("int")), more))


def page_segments(mode: Column, pages: Column) -> Column:
    """Array with a null for each page of a page-filling mode: one, or as many as asked."""
    return F.array_repeat(F.lit(None).cast("int"), F.when(mode == "multiple-pages", pages.cast("int")).otherwise(F.lit(1)))


def segments(items: DataFrame) -> DataFrame:
    """One row a part (from 0): lines on it, or null where the page is filled."""
    lines = response_lines(F.col("mode"), F.col("lines"))
    parts = F.coalesce(line_segments(lines), page_segments(F.col("mode"), F.col("pages")))
    return items.select("*", F.posexplode(parts).alias("part", "part_lines"))


def answer_code(section: Column, lesson: Column, idx: Column) -> Column:
    """L<lesson>-C<n> or -A<n>; null for sections without answers."""
    letter = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])[section]
    return F.concat(F.lit("L"), lesson.cast("string"), F.lit("-"), letter, (idx + 1).cast("string"))


def vocabulary_number(idx: Column) -> Column:
    return padded(idx + 1)


def section_summary(n: Column, singular: str, plural: str) -> Column:
    return counted(n, singular, plural)


def fill_rows(height_mm: Column) -> Column:
    return F.floor(height_mm / ROW_MM).cast("int")


def footer_label(edition: Column, lesson_label: Column) -> Column:
    lesson = F.coalesce(lesson_label, F.lit(""))
    return F.when(edition == "teacher", F.when(lesson == "", "Teacher guide").otherwise(F.concat(lesson, F.lit(" · Teacher guide")))).otherwise(lesson)
