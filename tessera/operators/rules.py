"""Content rules: lengths and kinds, defaults, layout budgets and wrapping.

``items`` has one row an item of a lesson: workbook_id, lesson_number, section,
idx and the item's fields; ``lessons`` and ``manifests`` as assembled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import guidance_units, is_blank, layout_units, longest_token
from tessera.operators.violations import found, together

#: Limits on the number of code points, of items and of layout units.
LENGTHS = {
    "manifest": {"book_title": (90, True), "author": (80, True), "series_title": (80, False), "lesson_range": (60, True), "cover_subtitle": (180, False)},
    "lesson": {"title": (100, True), "reading_range": (80, True), "framing_note": (400, False), "student_instructions": (400, False)},
    "question": {"prompt": (700, True), "quotation": (700, False), "teacher_guidance": (1200, False), "rubric": (1200, False)},
    "vocabulary": {"term": (60, True), "meaning": (100, True), "definition": (600, True), "excerpt": (600, True), "excerpt_context": (700, True), "chapter_reference": (80, False)},
}
GUIDANCE_ITEMS, GUIDANCE_LENGTH = 6, 180
FIRST_PAGE_LINES = {"short-answer": 3, "short-paragraph": 6, "extended-answer": 12, "full-page": 14, "multiple-pages": 14}
FIRST_PAGE_MOST, LINE_UNITS, ITEM_UNITS = 14, 54, 1800
COVER_UNITS, VOCABULARY_UNITS, TOKEN_LENGTH = 700, 1900, 80
DEFAULT_MODES = {"readingComprehension": "short-answer", "criticalThinkingAndAnalysis": "short-paragraph", "paragraphWriting": "full-page"}
QUESTION_SECTIONS = ["readingComprehension", "criticalThinkingAndAnalysis"]


def rule_table(spark: SparkSession) -> DataFrame:
    """kind, field, check and bound of every length rule, for users to read or replace."""
    rows = []
    for kind, fields in LENGTHS.items():
        for field, (most, needed) in fields.items():
            rows += [(kind, field, "max_length", most), (kind, field, "not_blank", 1)] + [(kind, field, "required", 1)] * needed
    return spark.createDataFrame(rows, "kind string, field string, check string, bound int")


def limits_of(table: DataFrame) -> dict[str, dict[str, tuple[int, bool]]]:
    """The limits that a rule table states, by kind and field; the table has a few rows a field."""
    out: dict[str, dict[str, tuple[int, bool]]] = {}
    for r in table.orderBy("kind", "field", "check").collect():
        most, needed = out.setdefault(r.kind, {}).get(r.field, (None, False))
        out[r.kind][r.field] = (r.bound, needed) if r.check == "max_length" else (most, needed or r.check == "required")
    return out


def length_problems(fields: dict[str, tuple[int, bool]]) -> Column:
    """Array of (field, problem): required, blank and over-long texts, all of them."""
    one = []
    for field, (most, needed) in fields.items():
        text = F.col(field)
        checks = [
            F.when(text.isNull(), "must have required property") if needed else F.lit(None).cast("string"),
            F.when(text.isNotNull() & is_blank(text), "must contain a character that is not blank"),
            F.when(F.length(text) > most, F.lit(f"must NOT have more than {most} characters")) if most is not None else F.lit(None).cast("string"),
        ]
        one += [F.struct(F.lit(field).alias("field"), c.alias("problem")) for c in checks]
    return F.filter(F.array(*one), lambda x: x["problem"].isNotNull())


def guidance_problem(items: Column) -> Column:
    return (
        F.when(F.size(items) > GUIDANCE_ITEMS, f"must NOT have more than {GUIDANCE_ITEMS} items")
        .when(F.size(items) < 1, "must NOT have fewer than 1 items")
        .when(F.exists(items, is_blank), "must contain a character that is not blank")
        .when(F.exists(items, lambda x: F.length(x) > GUIDANCE_LENGTH), f"must NOT have more than {GUIDANCE_LENGTH} characters")
    )


def space_problem(space: Column) -> Column:
    """What is wrong with a response space as a union of its three shapes."""
    mode, lines, pages = space["mode"], space["lines"], space["pages"]
    return F.when(space.isNull(), F.lit(None).cast("string")).when(mode.isNull() | ~mode.isin(*FIRST_PAGE_LINES, "custom-lines"), "must be one of the response modes").when(
        mode == "custom-lines", F.when(lines.isNull() | (lines < 0) | pages.isNotNull(), "must give lines of at least 0 and no pages")
    ).when(mode == "multiple-pages", F.when(pages.isNull() | (pages < 2) | lines.isNotNull(), "must give pages of at least 2 and no lines")).when(
        lines.isNotNull() | pages.isNotNull(), "must not give lines or pages"
    )


def unknown_properties(doc: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that the schema does not know."""
    return F.array_except(F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))


def schema_violations(df: DataFrame, kind: str, subject: str, prefix: Column, rank: list[Column], table: DataFrame | None = None) -> DataFrame:
    """All length and shape problems of rows of one kind, as violations; ``table`` replaces ``rule_table``."""
    limits = LENGTHS if table is None else limits_of(table)
    problems = length_problems({k: v for k, v in limits.get(kind, {}).items() if k in df.columns})
    if "guidance" in df.columns and kind == "question":
        problems = F.concat(problems, F.filter(F.array(F.struct(F.lit("guidance").alias("field"), guidance_problem(F.col("guidance")).alias("problem"))), lambda x: x["problem"].isNotNull()))
    if "response_space" in df.columns and kind == "question":
        problems = F.concat(problems, F.filter(F.array(F.struct(F.lit("response_space").alias("field"), space_problem(F.col("response_space")).alias("problem"))), lambda x: x["problem"].isNotNull()))
    spread = df.withColumn("path_prefix", prefix).select("*", F.posexplode(problems).alias("nth", "p"))
    path = F.concat_ws("/", "path_prefix", "p.field")
    return found(spread, F.col(subject), F.lit(True), [*rank, F.col("nth")], "schema", path, F.concat(path, F.lit(": "), F.col("p.problem")))


def default_mode(section: Column) -> Column:
    """The response mode of a section without one; null for sections that have none."""
    return F.create_map(*[F.lit(x) for kv in DEFAULT_MODES.items() for x in kv])[section]


def normalised_items(items: DataFrame) -> DataFrame:
    """Fills in response space by section, and appends the old ``hints`` to the guidance of writing prompts.

    Checked limits come before this, so a merged list may be longer than they allow.
    """
    space = F.coalesce("response_space", F.when(default_mode(F.col("section")).isNotNull(), F.struct(default_mode(F.col("section")).alias("mode"), F.lit(None).cast("bigint").alias("lines"), F.lit(None).cast("bigint").alias("pages"))))
    out = items.withColumn("response_space", space)
    if "hints" in items.columns:
        merged = F.concat(F.coalesce("guidance", F.array().cast("array<string>")), F.col("hints"))
        out = out.withColumn("guidance", F.when((F.col("section") == "paragraphWriting") & F.col("hints").isNotNull(), merged).otherwise(F.col("guidance"))).drop("hints")
    return out


def normalised_manifests(manifests: DataFrame, series_title: str) -> DataFrame:
    return manifests.withColumn("series_title", F.coalesce("series_title", F.lit(series_title)))


def first_page_lines(mode: Column, lines: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FIRST_PAGE_LINES.items() for x in kv])
    return F.when(mode == "custom-lines", F.least(lines, F.lit(FIRST_PAGE_MOST))).otherwise(known[mode])


def item_budget(mode: Column, lines: Column) -> Column:
    return F.lit(ITEM_UNITS) - first_page_lines(mode, lines) * LINE_UNITS


def item_units(prompt: Column, quotation: Column, guidance: Column) -> Column:
    return layout_units(prompt) + layout_units(quotation) + guidance_units(guidance)


def vocabulary_units(term: Column, *rest: Column) -> Column:
    total = layout_units(term) * F.lit(1.5)
    for x in rest:
        total = total + layout_units(x)
    return total


#: Fixed value: the form in which a layout budget is reported, which the registered SQL states too.
BUDGET_FORM = "%s: estimated layout size %s exceeds %s"
BUDGET_ADVICE = "shorten it or split it in two"


def budget_message(path: Column, actual: Column, most: Column, advice: str | None = None) -> Column:
    """Size and limit in their fixed form, and what to do about it if ``advice`` is given."""
    return F.format_string(BUDGET_FORM + (f"; {advice}" if advice else ""), path, actual.cast("string"), most.cast("string"))


def over_budget(df: DataFrame, subject: str, rule: str, actual: Column, most: Column, path: Column, rank: list[Column]) -> DataFrame:
    rows = df.withColumns({"b_actual": actual, "b_most": most, "b_path": path})
    return found(rows, F.col(subject), F.col("b_actual") > F.col("b_most"), rank, rule, F.col("b_path"), budget_message(F.col("b_path"), F.col("b_actual"), F.col("b_most"), BUDGET_ADVICE))


def unbroken(df: DataFrame, subject: str, leaves: dict[str, Column], rank: list[Column], most: int = TOKEN_LENGTH) -> DataFrame:
    """Violations: texts holding a run without white space of more than ``most`` code points.

    ``leaves`` gives paths and texts; they are laid out as one array and spread once.
    """
    one = F.array(*[F.struct(F.lit(p).alias("path"), longest_token(c).alias("longest")) for p, c in leaves.items()])
    spread = df.select("*", F.posexplode(one).alias("nth", "leaf")).where(F.col("leaf.longest") > most)
    message = F.format_string(f"%s: contains an unbroken text segment of %d characters; the maximum is {most}", "leaf.path", "leaf.longest")
    return found(spread, F.col(subject), F.lit(True), [*rank, F.col("nth")], "unbroken_text", F.col("leaf.path"), message)


def missing_teacher_guidance(items: DataFrame, editions: list[str]) -> DataFrame:
    """Violations: questions without teacher guidance, if the teacher edition is asked for."""
    path = F.concat(F.lit("/sections/"), F.col("section"), F.lit("/"), F.col("idx").cast("string"), F.lit("/teacherGuidance"))
    where = F.col("section").isin(QUESTION_SECTIONS) & is_blank(F.col("teacher_guidance")) & F.lit("teacher" in editions)
    return found(items, F.col("workbook_id"), where, [F.lit(8), F.col("lesson_number"), F.lit(5), F.col("idx")], "teacher_guidance", path, F.concat(path, F.lit(": has no guidance for teachers, whose edition was asked for")))


def layout_violations(lessons: DataFrame, items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Cover, item and vocabulary budgets of normalised lessons, in that order."""
    cover = sum((layout_units(F.col(c)) for c in ("title", "reading_range", "framing_note", "student_instructions")), F.lit(0))
    space = F.col("response_space")
    at = F.concat(F.lit("/sections/"), F.col("section"), F.lit("/"), F.col("idx").cast("string"))
    order = F.array_position(F.array(*map(F.lit, DEFAULT_MODES)), F.col("section"))
    return together(
        over_budget(lessons, "workbook_id", "cover_budget", cover, F.lit(COVER_UNITS), F.lit("/lesson-cover"), [F.lit(8), F.col("lesson_number"), F.lit(7)]),
        over_budget(items, "workbook_id", "item_budget", item_units(F.col("prompt"), F.col("quotation"), F.col("guidance")), item_budget(space["mode"], space["lines"]), at, [F.lit(8), F.col("lesson_number"), F.lit(7), order, F.col("idx")]),
        over_budget(vocabulary, "workbook_id", "vocabulary_budget", vocabulary_units(*[F.col(c) for c in LENGTHS["vocabulary"]]), F.lit(float(VOCABULARY_UNITS)), F.concat(F.lit("/sections/vocabulary/"), F.col("idx").cast("string")), [F.lit(8), F.col("lesson_number"), F.lit(7), F.lit(9), F.col("idx")]),
    )
