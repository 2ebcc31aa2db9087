"""The tab contract of sheet-like workbooks: cells in, typed rows and violations out.

``cells`` has one row a cell: workbook_id, sheet, row, col (from 1), value VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import computed, is_blank, split_guidance, trimmed
from tessera.operators.violations import found, together
from tessera.sources.shared import settle, small

HEADER_ROW, FIRST_DATA_ROW = 4, 5
_GUIDE = "Guidance & requirements (one item per line)"
_SPACE = ["Response space", "Custom lines", "Total response pages"]
_ASK = ["Status", "Lesson number", "Order", "Question", "Quotation (optional)", _GUIDE, "Teacher guidance", *_SPACE]
#: The tabs with their headers, in order; column 1 is a free note.
HEADERS = {
    "Workbook": ["Status", "Book title", "Author", "Series title", "Lesson range", "Cover subtitle / description"],
    "Lessons": ["Status", "Lesson number", "Lesson title", "Chapter or page range", "Framing note / introduction", "General student instructions"],
    "Comprehension": _ASK,
    "Analysis": _ASK,
    "Writing": ["Status", "Lesson number", "Order", "Writing prompt", _GUIDE, "Teacher guidance (optional)", "Example structure or rubric (optional)", *_SPACE],
    "Vocabulary": ["Status", "Lesson number", "Order", "Vocabulary word", "Korean meaning", "English definition", "Excerpt from the book", "Excerpt context", "Chapter reference (optional)"],
}
TABS = list(HEADERS)
ITEM_TABS = TABS[2:]
#: Response modes by the label that a tutor chooses.
RESPONSE_MODES = {
    "Short answer": "short-answer", "Short paragraph": "short-paragraph", "Extended answer": "extended-answer",
    "Full page": "full-page", "Multiple pages": "multiple-pages", "Custom lines": "custom-lines",
}
#: What each tab's columns must hold, in the order in which they are read:
#: (column, field, kind, required).  Response space stands in columns 8 to 10.
_GUIDE_KIND, _TEXT, _WHOLE = "guidance", "text", "whole"
FIELDS = {
    "Workbook": [(2, "book_title", _TEXT, True), (3, "author", _TEXT, True), (4, "series_title", _TEXT, True), (5, "lesson_range", _TEXT, True), (6, "cover_subtitle", _TEXT, False)],
    "Lessons": [(2, "lesson_number", _WHOLE, True), (3, "title", _TEXT, True), (4, "reading_range", _TEXT, True), (5, "framing_note", _TEXT, False), (6, "student_instructions", _TEXT, False)],
    "Comprehension": [(2, "lesson_number", _WHOLE, True), (3, "item_order", _WHOLE, True), (4, "prompt", _TEXT, True), (7, "teacher_guidance", _TEXT, True), (5, "quotation", _TEXT, False), (6, "guidance", _GUIDE_KIND, False)],
    "Writing": [(2, "lesson_number", _WHOLE, True), (3, "item_order", _WHOLE, True), (4, "prompt", _TEXT, True), (5, "guidance", _GUIDE_KIND, False), (6, "teacher_guidance", _TEXT, False), (7, "rubric", _TEXT, False)],
    "Vocabulary": [(2, "lesson_number", _WHOLE, True), (3, "item_order", _WHOLE, True), (4, "term", _TEXT, True), (5, "meaning", _TEXT, True), (6, "definition", _TEXT, True), (7, "excerpt", _TEXT, True), (8, "excerpt_context", _TEXT, True), (9, "chapter_reference", _TEXT, False)],
}
FIELDS["Analysis"] = FIELDS["Comprehension"]
_KEY = ["workbook_id", "sheet", "row"]


def contract_table(spark: SparkSession) -> DataFrame:
    """sheet, tab_no, col and header of the contract, a rule table a user can replace."""
    return spark.createDataFrame([(s, n, k, h) for n, (s, hs) in enumerate(HEADERS.items()) for k, h in enumerate(hs, 1)], "sheet string, tab_no int, col int, header string")


def select_tabs(cells: DataFrame, names: list[str]) -> DataFrame:
    """Cells of the tabs asked for; absent tabs don't appear."""
    return cells.where(F.col("sheet").isin(names))


def kind_of(value: Column) -> Column:
    """``blank``, ``object``, ``number``, ``boolean`` or ``text``."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull() | (kind == "VOID"), "blank")
        .when(kind.rlike("^(OBJECT|ARRAY|DATE|TIMESTAMP)"), "object")
        .when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "number")
        .when(kind == "BOOLEAN", "boolean")
        .when(is_blank(text), "blank")
        .otherwise("text")
    )


def cell_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def read_cell(value: Column) -> Column:
    """struct(kind, text) of a cell: all that the checks need to know of it."""
    return F.struct(kind_of(value).alias("kind"), cell_text(value).alias("text"))


def text_problem(cell: Column, required: bool) -> Column:
    kind = F.coalesce(cell["kind"], F.lit("blank"))
    return F.when(kind == "blank", F.lit("is required.") if required else F.lit(None)).when(kind == "object", "must contain text.")


def whole_number(text: Column, is_number: Column, minimum: int) -> Column:
    """The whole number that a cell holds, or null: digits alone in text, integral numbers."""
    number = F.when(is_number, text.try_cast("double")).when(trimmed(text).rlike("^[0-9]+$"), trimmed(text).try_cast("double"))
    return F.when((number == F.floor(number)) & (number >= minimum), number.try_cast("bigint"))


def cell_number(cell: Column, minimum: int) -> Column:
    return F.when(cell["kind"].isin("number", "text"), whole_number(cell["text"], cell["kind"] == "number", minimum))


def whole_problem(cell: Column, required: bool, minimum: int = 1) -> Column:
    kind = F.coalesce(cell["kind"], F.lit("blank"))
    good = cell_number(cell, minimum).isNotNull()
    return F.when(kind == "blank", F.lit("is required.") if required else F.lit(None)).when(~good, f"must be a whole number of at least {minimum}.")


def response_table(spark: SparkSession) -> DataFrame:
    """The decision table of response space, which a user can replace: label, mode, needs_lines, least_pages.

    A choice needs a number of lines, or at least so many pages, or (null) neither.
    """
    needs = {"custom-lines": (True, None), "multiple-pages": (False, 2)}
    return spark.createDataFrame([(label, mode, *needs.get(mode, (False, None))) for label, mode in RESPONSE_MODES.items()], "label string, mode string, needs_lines boolean, least_pages int")


def response_space(df: DataFrame, label: Column, lines: Column, pages: Column, table: DataFrame | None = None) -> DataFrame:
    """df with ``space``, what the decision table says: struct(mode, lines, pages, col, name, problem).

    ``problem`` is null where the three cells agree, else says what is wrong with
    column ``col``; mode, lines and pages are null then or without a label.  ``table``
    replaces ``response_table``; a label without a row in it is none of the choices, and
    one with two rows is an error.
    """
    table = response_table(df.sparkSession) if table is None else small(table)
    choices = table.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct("mode", "needs_lines", "least_pages")))))).scalar()
    df = computed(df, s_name=trimmed(label), s_lines=lines, s_pages=pages)
    name, lines, pages = F.col("s_name"), F.col("s_lines"), F.col("s_pages")
    df = computed(df, s_choice=F.when(name.isNotNull(), F.try_element_at(choices, name)))
    choice, label = F.col("s_choice"), F.nullif(name, F.lit(""))
    mode, least = choice["mode"], choice["least_pages"]
    by_lines, by_pages = F.coalesce(choice["needs_lines"], F.lit(False)), least.isNotNull()
    neither = choice.isNotNull() & ~by_lines & ~by_pages
    both = "Custom lines / Total response pages"
    unfit = F.concat(F.lit("does not go with the choice "), name, F.lit("."))
    rules = [
        (label.isNull() & (lines.isNotNull() | pages.isNotNull()), 8, "Response space", F.lit("is blank although lines or pages are given.")),
        (label.isNotNull() & choice.isNull(), 8, "Response space", F.lit("is none of the known choices.")),
        (by_lines & lines.isNull(), 9, "Custom lines", F.lit("is missing: this choice needs a number of lines.")),
        (by_lines & pages.isNotNull(), 10, "Total response pages", F.lit("does not go with a number of lines.")),
        (by_pages & (pages.isNull() | (pages < least)), 10, "Total response pages", F.concat(F.lit("is too small: this choice needs at least "), least.cast("string"), F.lit(" pages."))),
        (by_pages & lines.isNotNull(), 9, "Custom lines", F.lit("does not go with a number of pages.")),
        (neither & lines.isNotNull(), 9, both, unfit),
        (neither & pages.isNotNull(), 10, both, unfit),
    ]
    found = F.lit(None).cast("struct<col:int,name:string,problem:string>")
    for when, k, cell, text in reversed(rules):
        found = F.when(when, F.struct(F.lit(k).alias("col"), F.lit(cell).alias("name"), text.alias("problem"))).otherwise(found)
    df = computed(df, s_found=found)
    good = F.col("s_found").isNull()
    space = F.struct(F.when(good, mode).alias("mode"), F.when(good & by_lines, lines).alias("lines"), F.when(good & by_pages, pages).alias("pages"), F.col("s_found.col").alias("col"), F.col("s_found.name").alias("name"), F.col("s_found.problem").alias("problem"))
    return df.withColumn("space", space).drop("s_name", "s_lines", "s_pages", "s_choice", "s_found")


def missing_tabs(cells: DataFrame, contract: DataFrame) -> DataFrame:
    """Violations: tabs of the contract that a workbook lacks."""
    books = cells.select("workbook_id").distinct()
    tabs = contract.groupBy("sheet").agg(F.first("tab_no").alias("tab_no"))
    lacking = books.join(F.broadcast(tabs)).join(cells.select("workbook_id", "sheet").distinct(), ["workbook_id", "sheet"], "left_anti")
    message = F.concat(F.lit('Required tab "'), F.col("sheet"), F.lit('" is missing.'))
    return found(lacking, F.col("workbook_id"), F.lit(True), [F.lit(1), F.col("tab_no")], "missing_tab", F.col("sheet"), message)


def wrong_headers(cells: DataFrame, contract: DataFrame) -> DataFrame:
    """Violations: headers that differ from the contract in any character."""
    present = cells.select("workbook_id", "sheet").distinct().join(F.broadcast(contract), "sheet")
    header = cells.where(F.col("row") == HEADER_ROW).select("workbook_id", "sheet", "col", cell_text(F.col("value")).alias("actual"))
    both = present.join(header, ["workbook_id", "sheet", "col"], "left").withColumn("actual", F.coalesce("actual", F.lit("")))
    message = F.format_string('"%s" column %d must be named "%s"; found "%s".', "sheet", "col", "header", "actual")
    return found(both, F.col("workbook_id"), F.col("actual") != F.col("header"), [F.lit(1), F.col("tab_no"), F.lit(1), F.col("col")], "wrong_header", place(F.col("sheet"), F.lit(HEADER_ROW), F.col("col")), message)


def place(sheet: Column, row: Column, col: Column) -> Column:
    return F.concat(sheet, F.lit("!"), row.cast("string"), F.lit(","), col.cast("string"))


def data_rows(cells: DataFrame) -> DataFrame:
    """One row a data row: its key and c2 to c10, each what ``read_cell`` says of a column.

    Rows from the first data row on, where some contract column after the note
    column is not blank; columns beyond the contract are ignored.
    """
    width = F.create_map(*[F.lit(x) for s, h in HEADERS.items() for x in (s, len(h))])[F.col("sheet")]
    own = cells.where((F.col("row") >= FIRST_DATA_ROW) & F.col("col").between(2, width)).select(*_KEY, "col", read_cell(F.col("value")).alias("cell")).where("cell.kind <> 'blank'")
    wide = own.groupBy(*_KEY).agg(*[F.max(F.when(F.col("col") == k, F.col("cell"))).alias(f"c{k}") for k in range(2, 11)])
    return wide


def typed_rows(rows: DataFrame, tab: str, spaces: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed rows, violations) of one tab: fields by name, problems by cell."""
    own = rows.where(F.col("sheet") == tab)
    out, problems = list(_KEY), []
    rank = 2 if tab == "Workbook" else 3 if tab == "Lessons" else 4 + ITEM_TABS.index(tab)
    for k, (col, field, kind, required) in enumerate(FIELDS[tab]):
        cell = F.col(f"c{col}")
        if kind == _WHOLE:
            problem, value = whole_problem(cell, required), cell_number(cell, 1)
        else:
            problem, text = text_problem(cell, required), F.when(cell["kind"] != "object", cell["text"])
            value = split_guidance(text) if kind == _GUIDE_KIND else text
        out.append(value.alias(field))
        # the unknown-lesson check (rank 2 of a row) comes between the order and the text cells
        problems.append((k if k < 2 or tab not in ITEM_TABS else k + 1, col, HEADERS[tab][col - 1], problem))
    if tab in ITEM_TABS and tab != "Vocabulary":
        last = len(FIELDS[tab]) + 2
        label, lines, pages = F.col("c8"), F.col("c9"), F.col("c10")
        own = response_space(own, label["text"], cell_number(lines, 0), cell_number(pages, 1), spaces)
        mode = F.col("space.mode")
        out.append(F.when(mode.isNotNull(), F.struct(mode.alias("mode"), F.col("space.lines").alias("lines"), F.col("space.pages").alias("pages"))).alias("response_space"))
        cells = [(8, "Response space", text_problem(label, False)), (9, "Custom lines", whole_problem(lines, False, 0)), (10, "Total response pages", whole_problem(pages, False, 1))]
        problems += [(last + k, *x) for k, x in enumerate(cells)]
        problems.append((last + 3, F.col("space.col"), F.col("space.name"), F.when(F.coalesce(*[p for _, _, p in cells]).isNull(), F.col("space.problem"))))
    one = [F.struct(F.lit(k).alias("step"), (F.lit(c) if isinstance(c, int) else c).alias("col"), (F.lit(n) if isinstance(n, str) else n).alias("name"), p.alias("problem")) for k, c, n, p in problems]
    spread = own.select(*_KEY, F.explode(F.filter(F.array(*one), lambda x: x["problem"].isNotNull())).alias("p"))
    message = F.format_string('"%s" row %d, %s %s', "sheet", "row", "p.name", "p.problem")
    bad = found(spread, F.col("workbook_id"), F.lit(True), [F.lit(rank), F.lit(0), F.col("row"), F.col("p.step")], "cell", place(F.col("sheet"), F.col("row"), F.col("p.col")), message)
    return own.select(*out), bad


def duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key occurred before, with ``earlier``: the first row's order.

    The first of each key is a pre-aggregated minimum that joins back, so a very
    frequent key is neither sorted nor gathered in one task.
    """
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("earlier"), F.count("*").alias("copies")).where("copies > 1")
    return rows.join(first, keys).where(F.struct(*order) > F.col("earlier"))


def orphans(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose parent is unknown."""
    return children.join(parents.select(*keys).distinct(), keys, "left_anti")


def uncovered(parents: DataFrame, keys: list[str], kinds: DataFrame, children: DataFrame) -> DataFrame:
    """(parent, kind) pairs without any child; ``kinds`` is a small fixed table."""
    wanted = parents.select(*keys).distinct().join(F.broadcast(kinds))
    return wanted.join(children.select(*keys, *kinds.columns).distinct(), [*keys, *kinds.columns], "left_anti")


def not_exactly_one(subjects: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """Subjects with another number of rows than one, and that number."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return subjects.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def leaves_directory(path: Column) -> Column:
    """True if a relative path climbs out of its directory (or is absolute)."""
    depth = F.aggregate(
        F.split(path, "/"), F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")),
        lambda a, x: F.struct(
            (a["now"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("now"),
            F.least(a["low"], a["now"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("low"),
        ),
        lambda a: a["low"],
    )
    return path.startswith("/") | (depth < 0)


def file_list_problem(files: Column, pattern: str = r"^lessons/[a-z0-9][a-z0-9._-]*\.json$") -> Column:
    return (
        F.when(F.coalesce(F.size(files), F.lit(0)) < 1, "must list at least one file")
        .when(F.size(F.array_distinct(files)) < F.size(files), "must not repeat a file")
        .when(~F.forall(files, lambda f: f.rlike(pattern)), "must name lesson files")
    )


def parse(cells: DataFrame, contract: DataFrame | None = None, spaces: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Typed rows of all six tabs, and all violations of the contract.

    The first violation of a workbook (by rank) is what a reader who stops at the
    first problem reports: tabs and headers, the one metadata row, the lessons,
    then each item tab with its rows, and its coverage of the lessons.  ``contract``
    replaces the table of tabs and headers, ``spaces`` the decision table of response
    space.  The data rows, and the few columns that
    checks between rows need, are written once; each check reads its own columns of them.
    """
    contract = contract_table(cells.sparkSession) if contract is None else contract
    rows = settle(data_rows(cells), "data-rows")
    typed, bad = {}, [missing_tabs(cells, contract), wrong_headers(cells, contract)]
    for tab in TABS:
        typed[tab], problems = typed_rows(rows, tab, spaces)
        bad.append(problems)
    whole = ["lesson_number", "item_order"]
    keys = settle(rows.select(*_KEY, cell_number(F.col("c2"), 1).alias(whole[0]), cell_number(F.col("c3"), 1).alias(whole[1])), "row-keys")
    return typed, together(*bad, *_between_rows(cells.select("workbook_id").distinct(), keys))


def _between_rows(books: DataFrame, keys: DataFrame) -> list[DataFrame]:
    """Violations between rows: how many there are, repeated numbers, unknown lessons, lessons without items.

    keys (workbook_id, sheet, row, lesson_number, item_order) has all tabs, so each check is one join for all of them.
    """
    book, sheet, row = F.col("workbook_id"), F.col("sheet"), F.col("row")
    of = lambda tab: keys.where(sheet == tab)
    numbered = of("Lessons").where("lesson_number is not null")
    items = keys.where(sheet.isin(ITEM_TABS) & F.col("lesson_number").isNotNull())
    rank = 4 + F.array_position(F.array(*map(F.lit, ITEM_TABS)), sheet) - 1
    one = not_exactly_one(books, "workbook_id", of("Workbook"))
    none = books.join(of("Lessons").select("workbook_id").distinct(), "workbook_id", "left_anti")
    twice = duplicates(numbered, ["workbook_id", "lesson_number"], ["row"])
    stray = orphans(items, numbered, ["workbook_id", "lesson_number"])
    again = duplicates(items.where("item_order is not null"), ["workbook_id", "sheet", "lesson_number", "item_order"], ["row"])
    wanted = numbered.withColumn("sheet", F.explode(F.array(*map(F.lit, ITEM_TABS))))
    bare = orphans(wanted, items, ["workbook_id", "sheet", "lesson_number"])
    return [
        found(one, book, F.lit(True), [F.lit(2)], "one_metadata_row", F.lit("Workbook"), F.format_string('"Workbook" must contain exactly one row; found %d.', "n")),
        found(none, book, F.lit(True), [F.lit(3)], "no_lessons", F.lit("Lessons"), F.lit('"Lessons" must contain at least one lesson.')),
        found(twice, book, F.lit(True), [F.lit(3), F.lit(0), row, F.lit(0), F.lit(1)], "repeated_lesson", place(sheet, row, F.lit(2)), F.format_string('"Lessons" row %d repeats Lesson %d from row %d.', "row", "lesson_number", "earlier.row")),
        found(stray, book, F.lit(True), [rank, F.lit(0), row, F.lit(2)], "unknown_lesson", place(sheet, row, F.lit(2)), F.format_string('"%s" row %d refers to Lesson %d, which is not on the Lessons tab.', "sheet", "row", "lesson_number")),
        found(again, book, F.lit(True), [rank, F.lit(0), row, F.lit(99)], "repeated_order", place(sheet, row, F.lit(3)), F.format_string('"%s" row %d repeats order %d of Lesson %d from row %d.', "sheet", "row", "item_order", "lesson_number", "earlier.row")),
        found(bare, book, F.lit(True), [rank, F.lit(1), row], "no_items", sheet, F.format_string('Lesson %d needs at least one row on "%s".', "lesson_number", "sheet")),
    ]
