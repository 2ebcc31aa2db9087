"""Assembly of nested lessons and manifests from typed rows, with lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import is_slug, padded, slug
from tessera.operators.contract import ITEM_TABS

#: Section names by tab.
SECTIONS = {"Comprehension": "readingComprehension", "Analysis": "criticalThinkingAndAnalysis", "Writing": "paragraphWriting", "Vocabulary": "vocabulary"}
ITEM_FIELDS = {
    "Comprehension": ["prompt", "quotation", "guidance", "teacher_guidance", "response_space"],
    "Writing": ["prompt", "guidance", "teacher_guidance", "rubric", "response_space"],
    "Vocabulary": ["term", "meaning", "definition", "excerpt", "excerpt_context", "chapter_reference"],
}
ITEM_FIELDS["Analysis"] = ITEM_FIELDS["Comprehension"]


def ordered_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items with ``idx``, their position (from 0) by order within each key."""
    return items.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("item_order", "row")) - 1)


def ordered_section(items: DataFrame, keys: list[str], fields: list[str], order: list[str], name: str = "items") -> DataFrame:
    """One row a key with its items in an array, in the order of ``order``.

    A group is the items of one section of one lesson, a bound that the contract
    sets (a page holds a few); sorting inside the array keeps it in one pass.
    """
    gathered = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("item")))).alias("g"))
    return gathered.select(*keys, F.transform("g", lambda x: x["item"]).alias(name))


def lessons(typed: dict[str, DataFrame]) -> DataFrame:
    """One row a lesson: its fields and an array of items for each section."""
    out = typed["Lessons"].withColumnRenamed("row", "lesson_row").drop("sheet")
    for tab in ITEM_TABS:
        section = ordered_section(typed[tab], ["workbook_id", "lesson_number"], ITEM_FIELDS[tab], ["item_order", "row"], SECTIONS[tab])
        out = out.join(section, ["workbook_id", "lesson_number"], "left")
    return out.withColumn("position", F.row_number().over(Window.partitionBy("workbook_id").orderBy("lesson_row")) - 1)


def lineage(typed: dict[str, DataFrame]) -> DataFrame:
    """(workbook, lesson, section, idx) to (sheet, row); lessons have no section."""
    out = typed["Lessons"].select("workbook_id", "lesson_number", F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("idx"), "sheet", "row")
    for tab in ITEM_TABS:
        items = ordered_items(typed[tab], ["workbook_id", "lesson_number"])
        out = out.unionByName(items.select("workbook_id", "lesson_number", F.lit(SECTIONS[tab]).alias("section"), "idx", "sheet", "row"))
    return out


def locate(violations: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds sheet and row to violations with lesson_number and a path like /sections/<name>/<idx>/...

    Falls back to the lesson's row; both stay null for an unknown lesson.
    """
    parts = F.split("path", "/")
    asked = violations.withColumns({"v_section": F.try_element_at(parts, F.lit(3)), "v_idx": F.try_element_at(parts, F.lit(4)).try_cast("int")})
    item = lines.where("section is not null").select(F.col("workbook_id").alias("w"), F.col("lesson_number").alias("l"), F.col("section").alias("v_section"), F.col("idx").alias("v_idx"), F.col("sheet").alias("i_sheet"), F.col("row").alias("i_row"))
    lesson = lines.where("section is null").select(F.col("workbook_id").alias("lw"), F.col("lesson_number").alias("ll"), F.col("sheet").alias("l_sheet"), F.col("row").alias("l_row"))
    found = asked.join(item, (F.col("workbook_id") == F.col("w")) & (F.col("lesson_number") == F.col("l")) & (asked["v_section"] == item["v_section"]) & (asked["v_idx"] == item["v_idx"]), "left")
    found = found.join(lesson, (F.col("workbook_id") == F.col("lw")) & (F.col("lesson_number") == F.col("ll")), "left")
    return found.select(*violations.columns, F.coalesce("i_sheet", "l_sheet").alias("sheet"), F.coalesce("i_row", "l_row").alias("row"))


def lesson_file(number: Column) -> Column:
    return F.concat(F.lit("lessons/lesson-"), padded(number), F.lit(".json"))


def workbook_id(title: Column, explicit: Column | None = None) -> Column:
    """The explicit id, else the title's slug, else ``workbook-`` and eight hex digits of its SHA-256."""
    made = F.coalesce(F.nullif(slug(title), F.lit("")), F.concat(F.lit("workbook-"), F.substring(F.sha2(title, 256), 1, 8)))
    return made if explicit is None else F.coalesce(explicit, made)


def bad_id(ident: Column) -> Column:
    return ~is_slug(ident)


def manifests(metadata: DataFrame, lesson_rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a workbook: fixed fields, id, and its lesson files in order.

    ``ids`` (workbook_id, id) names workbooks that were imported before and keep theirs.
    """
    files = ordered_section(lesson_rows.withColumn("file", lesson_file(F.col("lesson_number"))), ["workbook_id"], ["file"], ["position"], "f")
    out = metadata.join(files, "workbook_id", "left")
    if ids is not None:
        out = out.join(ids.select("workbook_id", F.col("id").alias("known")), "workbook_id", "left")
    else:
        out = out.withColumn("known", F.lit(None).cast("string"))
    return out.select(
        "workbook_id", F.lit(1).alias("schema_version"), workbook_id(F.col("book_title"), F.col("known")).alias("id"),
        "book_title", "author", "series_title", "lesson_range", "cover_subtitle", F.transform("f", lambda x: x["file"]).alias("lesson_files"),
    )
