"""Content packages, notices and bundles: JSON and text files to tables and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import counted
from tessera.operators.contract import duplicates, leaves_directory
from tessera.operators.schema import schema_violations, unbroken_leaves
from tessera.operators.violations import found, together, without
from tessera.sources.shared import discard_path, settle

_SPACE = "struct<mode:string,lines:bigint,pages:bigint>"
_ASK = f"struct<prompt:string,quotation:string,responseSpace:{_SPACE},responseGuidance:array<string>,teacherGuidance:string>"
_WRITE = f"struct<prompt:string,hints:array<string>,responseSpace:{_SPACE},responseGuidance:array<string>,exampleStructureOrRubric:string,teacherGuidance:string>"
_WORD = "struct<term:string,koreanMeaning:string,definition:string,bookExcerpt:string,excerptContext:string,chapterReference:string>"
LESSON = f"schemaVersion int, lessonNumber int, title string, readingRange string, framingNote string, studentInstructions string, sections struct<readingComprehension:array<{_ASK}>,criticalThinkingAndAnalysis:array<{_ASK}>,paragraphWriting:array<{_WRITE}>,vocabulary:array<{_WORD}>>"
MANIFEST = "schemaVersion int, id string, bookTitle string, author string, seriesTitle string, lessonRange string, coverSubtitle string, lessonFiles array<string>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files; a malformed one keeps its text in ``malformed``, and ``doc`` is the raw value."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    doc = F.try_parse_json("value")
    return raw.select("file_path", F.when(doc.isNull(), F.col("value")).alias("malformed"), doc.alias("doc"), F.from_json("value", schema).alias("d")).select("file_path", "malformed", "doc", "d.*")


def read_packages(spark: SparkSession, manifests: str, lessons: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, lessons) with file paths; ``malformed`` marks files that are no JSON."""
    return _read(spark, manifests, MANIFEST), _read(spark, lessons, LESSON)


def malformed_violations(files: DataFrame) -> DataFrame:
    return found(files, F.col("file_path"), F.col("malformed").isNotNull(), [F.lit(0)], "malformed_json", F.col("file_path"), F.lit("is not valid JSON"))


def missing_files(manifests: DataFrame, lessons: DataFrame) -> DataFrame:
    """(workbook_id, position, file) that a manifest lists and no lesson has; both carry workbook_id."""
    wanted = manifests.select("workbook_id", F.posexplode("lesson_files").alias("position", "file"))
    return wanted.join(lessons.select("workbook_id", "file"), ["workbook_id", "file"], "left_anti")


def repeated_lessons(files: DataFrame) -> DataFrame:
    """Violations: lesson files (workbook_id, position, file, lesson_number) whose number an earlier file of the package has."""
    again = duplicates(files.where("lesson_number is not null"), ["workbook_id", "lesson_number"], ["position", "file"])
    message = F.format_string("%s: has Lesson %d, as %s has", "file", "lesson_number", "earlier.file")
    return found(again, F.col("workbook_id"), F.lit(True), [F.lit(0), F.col("position")], "repeated_lesson", F.col("file"), message)


#: Where a file's path says its package and its name in it: groups 1 and 2.
FOLDERS = r"^(.*?)/((?:lessons/)?[^/]+\.json)$"
#: The same for files that Spark writes, a folder a file: partitionBy("package", "file").  Only for few files; see ``write_packed_files``.
PARTITIONS = r"/package=([^/]+)/file=([^/]+)/[^/]+$"
MANIFEST_FILE = "workbook.json"


def read_package_files(spark: SparkSession, root: str, pattern: str = FOLDERS, most_bytes: int | None = None) -> DataFrame:
    """package, file, bytes, malformed and doc (VARIANT) of all files under ``root``, manifests and lessons, in one scan.

    A file over ``most_bytes`` is not opened: its size is known from the listing, and
    it comes with neither text nor doc.  What is no JSON is ``malformed``.
    """
    reader = lambda: spark.read.option("recursiveFileLookup", True)
    size, path = F.col("_metadata.file_size"), F.col("_metadata.file_path")
    small = reader().text(root, wholetext=True).select(path.alias("path"), size.alias("bytes"), "value")
    large = reader().format("binaryFile").load(root).select("path", F.col("length").alias("bytes"))
    part = lambda k: F.url_decode(F.regexp_extract("path", pattern, k))
    return _opened(small, large, most_bytes).select(part(1).alias("package"), part(2).alias("file"), "bytes", "too_large", "malformed", "doc")


def _opened(texts: DataFrame, sizes: DataFrame, most_bytes: int | None) -> DataFrame:
    """Files with bytes, too_large, malformed and doc: ``texts`` have a value, read up to ``most_bytes``; ``sizes`` have none."""
    if most_bytes is not None:
        texts = texts.where(F.col("bytes") <= most_bytes)
    out = texts.withColumn("doc", F.try_parse_json("value")).withColumns({"too_large": F.lit(False), "malformed": F.col("doc").isNull()}).drop("value")
    if most_bytes is None:
        return out
    large = sizes.where(F.col("bytes") > most_bytes)
    return out.unionByName(large.withColumns({"too_large": F.lit(True), "malformed": F.lit(False), "doc": F.lit(None).cast("variant")}))


def write_packed_files(files: DataFrame, root: str) -> None:
    """Write files (package, file, value) under ``root``, many to a container, each one whole.

    A file or folder of its own costs a store the same whether it holds a line or a
    book, so millions of small ones are kept as rows of Parquet: name, size and text.
    """
    files.select("package", "file", F.octet_length("value").cast("bigint").alias("bytes"), "value").write.parquet(root)


def read_packed_files(spark: SparkSession, root: str, most_bytes: int | None = None) -> DataFrame:
    """What ``read_package_files`` gives of loose files, of those that ``write_packed_files`` wrote.

    The sizes lie beside the texts, so a file over ``most_bytes`` is not parsed.
    """
    files = spark.read.schema("package string, file string, bytes bigint, value string").parquet(root)
    return _opened(files, files.drop("value"), most_bytes).select("package", "file", "bytes", "too_large", "malformed", "doc")


def package_violations(files: DataFrame, table: DataFrame | None = None, longest: int = 80) -> DataFrame:
    """All violations of packages, ranked as a reader meets them: the manifest, then its lessons in its order.

    Of a manifest: missing, too large, no JSON, the schema, unbroken texts.  Of a
    lesson: a path that leaves the package, a missing or too large file, no JSON, the
    schema, unbroken texts, a number that an earlier lesson has.  Subjects are packages;
    ``table`` replaces the schema's rules.
    """
    package = F.col("package")
    files = settle(files, "package-files")  # every check reads it; the files themselves are opened once
    manifests, lessons = files.where(F.col("file") == MANIFEST_FILE), files.where(F.col("file") != MANIFEST_FILE)
    listed = manifests.select("package", F.posexplode(F.try_variant_get("doc", "$.lessonFiles", "array<string>")).alias("position", "file"))
    own = listed.join(lessons, ["package", "file"])
    at = lambda check, *more: [F.lit(1), F.col("position"), F.lit(check), *more]
    none = lessons.select("package").distinct().join(manifests.select("package"), "package", "left_anti")
    gone = listed.where(~leaves_directory(F.col("file"))).join(lessons.select("package", "file"), ["package", "file"], "left_anti")
    numbered = own.withColumn("number", F.try_variant_get("doc", "$.lessonNumber", "bigint")).where("number is not null")
    again = duplicates(numbered.select("package", "position", "file", "number"), ["package", "number"], ["position", "file"])
    in_file = lambda v: v.withColumns({"path": F.concat(F.split_part("subject", F.lit("\n"), F.lit(2)), "path"), "subject": F.split_part("subject", F.lit("\n"), F.lit(1))})
    read = own.where("doc is not null").withColumn("both", F.concat_ws("\n", "package", "file"))
    return together(
        found(none, package, F.lit(True), [F.lit(0), F.lit(0), F.lit(0)], "missing_manifest", F.lit(MANIFEST_FILE), F.lit(f"{MANIFEST_FILE}: does not exist")),
        found(manifests, package, F.col("too_large"), [F.lit(0), F.lit(0), F.lit(1)], "too_large", F.col("file"), F.format_string("%s: has %d bytes", "file", "bytes")),
        found(manifests, package, F.col("malformed"), [F.lit(0), F.lit(0), F.lit(2)], "malformed_json", F.col("file"), F.format_string("%s: is not valid JSON", "file")),
        schema_violations(manifests, "manifest", "package", "doc", [F.lit(0), F.lit(0), F.lit(3)], table),
        unbroken_leaves(manifests, "package", "doc", [F.lit(0), F.lit(0), F.lit(4)], longest),
        found(listed, package, leaves_directory(F.col("file")), at(0), "leaves_package", F.col("file"), F.format_string("%s: leaves the package", "file")),
        found(gone, package, F.lit(True), at(1), "missing_file", F.col("file"), F.format_string("%s: does not exist", "file")),
        found(own, package, F.col("too_large"), at(1), "too_large", F.col("file"), F.format_string("%s: has %d bytes", "file", "bytes")),
        found(own, package, F.col("malformed"), at(2), "malformed_json", F.col("file"), F.format_string("%s: is not valid JSON", "file")),
        in_file(schema_violations(read, "lesson", "both", "doc", at(3), table)),
        in_file(unbroken_leaves(read, "both", "doc", at(4), longest)),
        found(again, package, F.lit(True), at(6), "repeated_lesson", F.col("file"), F.format_string("%s: has Lesson %d, as %s has", "file", "number", "earlier.file")),
    )


class NotPublished(Exception):
    """What was staged did not stand the second check; what was published before is as it was."""


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were published whole: each has a record, written last."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/published")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()) for s in (fs.listStatus(at) if fs.exists(at) else []) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))


def digests(rows: DataFrame, key: str) -> DataFrame:
    """A number and a count that tell the rows of each key apart from any others', whatever their order."""
    one = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return rows.groupBy(key).agg(F.sum(one).cast("string").alias("digest"), F.count("*").alias("rows"))


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """key, digest, rows and version of everything that is published at ``path``; None if nothing is."""
    found_versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/published/{found_versions[-1]}") if found_versions else None


def read_published(spark: SparkSession, path: str, key: str = "workbook_id") -> DataFrame | None:
    """The rows that are published at ``path`` now, each key from the version that wrote it last."""
    record = published(spark, path)
    if record is None:
        return None
    wanted = record.select(key, "version")
    return spark.read.parquet(f"{path}/data").join(wanted, [key, "version"], "left_semi").drop("version")


def write_packages(documents: DataFrame, violations: DataFrame, path: str, key: str = "workbook_id", recheck: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Publish the workbooks about which nothing was found and whose rows differ from what is published.

    They are written as a new version, which nobody reads yet, read back, held to the
    digests of what was to be written and to ``recheck`` (which gives violations), and
    then published by a record of where each workbook's rows are: readers follow the
    newest record.  If a check fails, NotPublished is raised and what was published
    stays.  Workbooks that are not in this run, or have violations now, stay as they
    were.  Returns the record.
    """
    spark = documents.sparkSession
    good = without(documents, key, violations)
    before, known = published(spark, path), _versions(spark, path)
    version = known[-1] + 1 if known else 1
    wanted = digests(good, key)
    changed = wanted if before is None else wanted.join(before.select(key, "digest", "rows"), [key, "digest", "rows"], "left_anti")
    changed = settle(changed, "publish-changed")
    stage = f"{path}/data/version={version}"
    good.join(changed.select(key), key, "left_semi").write.mode("overwrite").parquet(stage)
    staged = spark.read.schema(documents.schema).parquet(stage)
    apart = digests(staged, key).join(changed, [key, "digest", "rows"], "left_anti").count() + changed.join(digests(staged, key), [key, "digest", "rows"], "left_anti").count()
    bad = 0 if recheck is None else recheck(staged).count()
    if apart or bad:
        discard_path(spark, stage)
        raise NotPublished(f"version {version}: {apart} workbooks differ from what was to be written, {bad} violations after reading back")
    record = changed.withColumn("version", F.lit(version))
    if before is not None:
        record = record.unionByName(before.join(changed.select(key), key, "left_anti").select(record.columns))
    record.write.mode("overwrite").parquet(f"{path}/published/{version}")
    return spark.read.parquet(f"{path}/published/{version}")


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """id, title, posted_at, images and body of markdown files with front matter."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]+$", 1).alias("id"), "value")
    return notices_of(raw)


def notices_of(raw: DataFrame) -> DataFrame:
    fence = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
    parts = raw.withColumns({"front": F.regexp_extract("value", fence, 1), "body": F.regexp_extract("value", fence, 2)})
    unquote = lambda c: F.regexp_replace(F.trim(c), "^[\"']|[\"']$", "")
    line = lambda name: F.nullif(unquote(F.regexp_extract("front", rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)), F.lit(""))
    listed = F.regexp_extract("front", r"(?s)(?:^|\n)images:[ \t]*\r?\n((?:[ \t]*-[^\n]*(?:\n|$))*)", 1)
    images = F.transform(F.filter(F.split(listed, "\r?\n"), lambda x: x.rlike(r"^\s*-")), lambda x: unquote(F.regexp_replace(x, r"^\s*-\s*", "")))
    return parts.select("id", line("title").alias("title"), line("postedAt").alias("posted_at"), images.alias("images"), "body")


def bundles(targets: DataFrame, manifests: DataFrame, lessons: DataFrame) -> DataFrame:
    """One JSON document a target: build, manifest, and its lessons in book order.

    ``manifests`` has book_id and ``manifest`` (a struct); ``lessons`` book_id,
    lesson_number and ``lesson`` (a struct).  A target's lessons are one book's.
    """
    spread = targets.select("book_id", "name", "scope", "edition", F.posexplode("lesson_numbers").alias("at", "lesson_number"))
    own = spread.join(lessons.withColumn("lesson_number", F.col("lesson_number").cast("bigint")), ["book_id", "lesson_number"])
    gathered = own.groupBy("book_id", "name", "scope", "edition").agg(F.array_sort(F.collect_list(F.struct("at", F.to_json("lesson").alias("j")))).alias("g"))
    body = F.concat(F.lit("["), F.array_join(F.transform("g", lambda x: x["j"]), ","), F.lit("]"))
    build = F.to_json(F.struct("scope", "edition"))
    return gathered.join(manifests, "book_id").select("name", F.concat(F.lit('{"schemaVersion":1,"build":'), build, F.lit(',"manifest":'), F.to_json("manifest"), F.lit(',"lessons":'), body, F.lit("}")).alias("bundle"))


def build_summary(targets: DataFrame, books: DataFrame) -> DataFrame:
    """id, title, number of lessons (and as words) and ordered file names of each book."""
    names = targets.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("g"), F.max(F.when(F.col("scope") == "workbook", F.size("lesson_numbers"))).alias("lessons"))
    return books.join(names, "book_id").select("book_id", "title", "lessons", counted(F.col("lessons"), "lesson", "lessons").alias("lessons_text"), F.array_join(F.transform("g", lambda x: x["name"]), ", ").alias("files"))
