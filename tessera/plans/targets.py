"""Build targets: which documents a book owes, their names, order and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import padded

EDITIONS = ["student", "teacher"]
#: Fixed value: what a teacher's item shows that has neither guidance nor rubric.
NO_GUIDANCE = "No additional guidance was provided for this prompt."


def editions(requested: list[str] | None = None) -> list[str]:
    """The editions asked for, lower-cased and without repeats, student first."""
    wanted = {x.strip().lower() for x in (EDITIONS if requested is None else requested)}
    if not wanted or wanted - set(EDITIONS):
        raise ValueError(f"Editions must be some of {', '.join(EDITIONS)}; got {sorted(wanted)}.")
    return [x for x in EDITIONS if x in wanted]


def edition_rows(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Each row once an edition, with edition and its number; no join is needed."""
    return df.select("*", F.posexplode(F.array(*map(F.lit, wanted))).alias("edition_no", "edition"))


def target_id(scope: Column, edition: Column, number: Column) -> Column:
    return F.when(scope == "lesson", F.concat(F.lit("lesson-"), padded(number), F.lit("-"), edition)).otherwise(F.concat(F.lit("workbook-"), edition))


def target_name(book: Column, scope: Column, edition: Column, number: Column) -> Column:
    return F.concat(book, F.lit("-"), target_id(scope, edition, number), F.lit(".pdf"))


def target_label(scope: Column, edition: Column, number: Column) -> Column:
    return F.concat(F.when(scope == "lesson", F.concat(F.lit("Lesson "), number.cast("string"))).otherwise(F.lit("Complete workbook")), F.lit(" · "), edition)


def _targets(books: DataFrame, lessons: DataFrame, wanted: list[str]) -> DataFrame:
    numbers = lessons.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("position", "lesson_number"))).alias("n"))
    whole = books.select("book_id").join(numbers, "book_id", "left").select("book_id", F.lit("workbook").alias("scope"), F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("bigint").alias("lesson_number"), F.transform("n", lambda x: x["lesson_number"].cast("bigint")).alias("lesson_numbers"))
    single = lessons.select("book_id", F.lit("lesson").alias("scope"), F.col("position").cast("bigint").alias("position"), F.col("lesson_number").cast("bigint").alias("lesson_number"), F.array(F.col("lesson_number").cast("bigint")).alias("lesson_numbers"))
    both = edition_rows(whole.unionByName(single), wanted)
    scope, edition, number = F.col("scope"), F.col("edition"), F.col("lesson_number")
    return both.withColumns({"name": target_name(F.col("book_id"), scope, edition, number), "label": target_label(scope, edition, number)})


def disk_targets(books: DataFrame, lessons: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Edition by edition, the whole book and then its lessons; ``seq`` orders them.

    ``books`` has book_id; ``lessons`` book_id, position (from 0) and lesson_number.
    """
    wanted = editions(requested)
    return _targets(books, lessons, wanted).withColumn("seq", F.struct("edition_no", (F.col("scope") == "lesson").cast("int").alias("later"), F.coalesce("position", F.lit(0)).alias("at"))).drop("position", "edition_no")


def preview_targets(books: DataFrame, lessons: DataFrame) -> DataFrame:
    """Lesson by lesson both editions, the whole book last."""
    return _targets(books, lessons, EDITIONS).withColumn("seq", F.struct((F.col("scope") == "workbook").cast("int").alias("later"), F.coalesce("position", F.lit(0)).alias("at"), "edition_no")).drop("position", "edition_no")


def target_lessons(targets: DataFrame, lessons: DataFrame) -> DataFrame:
    """The lessons of each target, in book order (``at``)."""
    spread = targets.select("book_id", "name", F.posexplode("lesson_numbers").alias("at", "lesson_number"))
    return spread.join(lessons.withColumn("lesson_number", F.col("lesson_number").cast("bigint")), ["book_id", "lesson_number"])


def name_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names that only one of two plans has, with the side; empty if they agree."""
    one = lambda a, b, side: a.select("name").exceptAll(b.select("name")).withColumn("side", F.lit(side))
    return one(left, right, "left").unionByName(one(right, left, "right"))


def extended(lessons: DataFrame, count: int) -> DataFrame:
    """Books of fewer lessons repeat theirs in turn, renumbered 1 to ``count``; others stay.

    ``source_position`` says which lesson each row is; ``extended`` marks the books.
    """
    sizes = lessons.groupBy("book_id").agg(F.count("*").cast("int").alias("have"))
    slots = sizes.where(F.col("have") < count).select("book_id", "have", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("new_number"))
    more = slots.withColumn("position", (F.col("new_number") - 1) % F.col("have")).join(lessons.withColumn("position", F.col("position").cast("int")), ["book_id", "position"])
    same = lessons.join(sizes.where(F.col("have") >= count), "book_id")
    columns = [c for c in lessons.columns if c not in ("book_id", "position", "lesson_number")]
    shape = lambda df, number, at, flag: df.select("book_id", at.cast("int").alias("source_position"), number.cast("bigint").alias("lesson_number"), F.lit(flag).alias("extended"), *columns)
    return shape(more, F.col("new_number"), F.col("position"), True).unionByName(shape(same, F.col("lesson_number"), F.col("position"), False))


def cover_ranges(manifests: DataFrame, lessons: DataFrame, count: int) -> DataFrame:
    """Manifests (book_id, lesson_range) whose range names all lessons of books that ``extended`` lengthens; others keep theirs."""
    short = lessons.groupBy("book_id").agg(F.count("*").alias("have")).where(F.col("have") < count).select("book_id", F.lit(f"Lessons 1–{count}").alias("longer"))
    return manifests.join(short, "book_id", "left").withColumn("lesson_range", F.coalesce("longer", "lesson_range")).drop("longer")


def fixture_plan(lessons: DataFrame, count: int) -> DataFrame:
    """First lesson and whole book in both editions: id, label and lesson count."""
    per_book = lessons.groupBy("book_id").agg(F.min_by("lesson_number", "position").alias("first"), F.greatest(F.count("*"), F.lit(count)).alias("whole"))
    spread = per_book.select("book_id", F.explode(F.array(
        F.struct(F.lit("lesson").alias("scope"), F.concat(F.lit("Standalone lesson "), F.col("first").cast("string")).alias("text"), F.lit(1).cast("bigint").alias("lesson_count")),
        F.struct(F.lit("workbook").alias("scope"), F.concat(F.lit("Complete workbook ("), F.col("whole").cast("string"), F.lit(" lessons)")).alias("text"), F.col("whole").alias("lesson_count")),
    )).alias("s")).select("book_id", "s.*")
    return edition_rows(spread, EDITIONS).select("book_id", F.concat("scope", F.lit("-"), "edition").alias("id"), F.concat("text", F.lit(" · "), "edition").alias("label"), "scope", "edition", "lesson_count")


def redacted(items: DataFrame) -> DataFrame:
    """Items with ``edition``: students lose guidance and rubric, teachers the response space."""
    student = F.col("edition") == "student"
    neither = F.col("teacher_guidance").isNull() & F.col("rubric").isNull()
    return items.withColumns({
        "teacher_guidance": F.when(student, F.lit(None)).when(neither, NO_GUIDANCE).otherwise(F.col("teacher_guidance")),
        "rubric": F.when(~student, F.col("rubric")),
        "response_space": F.when(student, F.col("response_space")),
    })


class _ExpandTargets:
    def eval(self, book_id: str, lesson_numbers: list[int]):
        for edition in EDITIONS:
            yield book_id, "workbook", edition, None, f"{book_id}-workbook-{edition}.pdf"
            for n in lesson_numbers or []:
                yield book_id, "lesson", edition, n, f"{book_id}-lesson-{n:02d}-{edition}.pdf"


def register(spark: SparkSession) -> None:
    """Make ``expand_targets(book_id, lesson_numbers)`` a table function in SQL, for this session."""
    spark.udtf.register("expand_targets", F.udtf(_ExpandTargets, returnType="book_id string, scope string, edition string, lesson_number long, name string"))
