import copy
import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import assembly, audit, contract, rules
from tessera.operators.violations import first_violation, without
from tessera.sources import grids, packages, shared


def snapshot():
    tab = lambda name, *rows: [[], [], [], contract.HEADERS[name], *rows]
    return {
        "spreadsheetName": "b1",
        "grids": {
            "Workbook": tab("Workbook", ["", "The Wide Field", "A. Writer", "Series", "Lessons 1-2", ""]),
            "Lessons": tab("Lessons", ["", 2, "Second", "Ch. 2", "", ""], ["", "1", "First", "Ch. 1", "Note", ""]),
            "Comprehension": tab("Comprehension", ["", 1, 2, "Late?", "", "", "Say so", "", "", ""], ["", 1, 1, "Early?", "quote", "one\n\n two ", "Look", "Custom lines", 0, ""], ["", 2, 1, "Why?", "", "", "Because", "", "", ""]),
            "Analysis": tab("Analysis", ["", 1, 1, "How?", "", "", "So", "Multiple pages", "", 3], ["", 2, 1, "When?", "", "", "Now", "", "", ""]),
            "Writing": tab("Writing", ["", 1, 1, "Write", "", "", "", "", "", ""], ["", 2, 1, "Write more", "", "", "", "", "", ""]),
            "Vocabulary": tab("Vocabulary", ["", 1, 1, "field", "m", "d", "e", "c", ""], ["", 2, 1, {"richText": [{"text": "wi"}, {"text": "de"}]}, "m", "d", "e", {"result": {"text": "c"}}, ""]),
        },
    }


@pytest.fixture
def parse(spark, tmp_path):
    def run(*edits):
        for k, edit in enumerate(edits):
            doc = copy.deepcopy(snapshot())
            doc["spreadsheetName"] = f"b{k}"
            edit(doc["grids"])
            (tmp_path / f"{k}.json").write_text(json.dumps(doc))
        return contract.parse(grids.read_grids(spark, str(tmp_path)))

    return run


def test_valid_workbook_is_assembled(parse):
    typed, bad = parse(lambda g: None)
    assert bad.collect() == []
    got = {r.lesson_number: r for r in assembly.lessons(typed).collect()}
    assert [got[n].position for n in (2, 1)] == [0, 1]
    first = got[1].readingComprehension
    assert [x.prompt for x in first] == ["Early?", "Late?"]
    assert first[0].guidance == ["one", " two "] and first[0].response_space.mode == "custom-lines" and first[0].response_space.lines == 0
    assert got[1].criticalThinkingAndAnalysis[0].response_space.pages == 3
    assert got[2].vocabulary[0].term == "wide" and got[2].vocabulary[0].excerpt_context == "c"
    lines = {(r.lesson_number, r.section, r.idx): r.row for r in assembly.lineage(typed).collect()}
    assert lines[(1, "readingComprehension", 0)] == 6 and lines[(1, None, None)] == 6
    made = assembly.manifests(typed["Workbook"], assembly.lessons(typed)).first()
    assert made.id == "the-wide-field" and made.lesson_files == ["lessons/lesson-02.json", "lessons/lesson-01.json"]


def put(tab, row, col, value):
    return lambda g: g[tab][row - 1].__setitem__(col - 1, value)


CASES = [
    (lambda g: g.pop("Writing"), 'Required tab "Writing" is missing.'),
    (put("Lessons", 4, 3, "Title"), '"Lessons" column 3 must be named "Lesson title"; found "Title".'),
    (put("Workbook", 5, 3, " "), '"Workbook" row 5, Author is required.'),
    (lambda g: g["Workbook"].append(["", "x", "y", "z", "w", ""]), '"Workbook" must contain exactly one row; found 2.'),
    (put("Lessons", 6, 2, 2), '"Lessons" row 6 repeats Lesson 2 from row 5.'),
    (put("Lessons", 6, 2, "one"), '"Lessons" row 6, Lesson number must be a whole number of at least 1.'),
    (put("Comprehension", 5, 2, 9), '"Comprehension" row 5 refers to Lesson 9, which is not on the Lessons tab.'),
    (put("Comprehension", 5, 3, 1), '"Comprehension" row 6 repeats order 1 of Lesson 1 from row 5.'),
    (put("Analysis", 5, 7, ""), '"Analysis" row 5, Teacher guidance is required.'),
    (put("Analysis", 5, 4, {"date": "2024-01-01"}), '"Analysis" row 5, Question must contain text.'),
    (put("Comprehension", 6, 9, ""), '"Comprehension" row 6, Custom lines is missing: this choice needs a number of lines.'),
    (put("Comprehension", 5, 9, 3), '"Comprehension" row 5, Response space is blank although lines or pages are given.'),
    (lambda g: g["Vocabulary"].pop(), 'Lesson 2 needs at least one row on "Vocabulary".'),
]


def test_first_violation_of_each_broken_workbook(parse):
    _, bad = parse(*[edit for edit, _ in CASES])
    got = {r.subject: r.message for r in first_violation(bad).collect()}
    wanted = {f"b{k}": message for k, (_, message) in enumerate(CASES)}
    assert got == wanted


def test_rules_on_items(spark):
    space = "struct<mode:string,lines:bigint,pages:bigint>"
    schema = f"workbook_id string, lesson_number int, section string, idx int, prompt string, quotation string, guidance array<string>, hints array<string>, teacher_guidance string, response_space {space}"
    rows = [
        ("w", 1, "readingComprehension", 0, "x" * 1500, None, ["a" * 140], None, None, None),
        ("w", 1, "paragraphWriting", 0, "p", None, ["a"], ["b"], None, None),
        ("w", 1, "paragraphWriting", 1, "가" * 500 + "\n", None, None, None, None, ("custom-lines", 70, None)),
    ]
    items = rules.normalised_items(spark.createDataFrame(rows, schema))
    got = {(r.section, r.idx): r for r in items.collect()}
    assert got[("readingComprehension", 0)].response_space.mode == "short-answer" and got[("paragraphWriting", 0)].guidance == ["a", "b"]
    lessons = spark.createDataFrame([("w", 1, "t" * 400, "r" * 301, None, None)], "workbook_id string, lesson_number int, title string, reading_range string, framing_note string, student_instructions string")
    words = spark.createDataFrame([("w", 1, 0, "t" * 1000, "m" * 401, "d", "e", "c", None)], "workbook_id string, lesson_number int, idx int, term string, meaning string, definition string, excerpt string, excerpt_context string, chapter_reference string")
    bad = rules.layout_violations(lessons, items, words)
    assert {r.path for r in bad.collect()} == {"/lesson-cover", "/sections/readingComprehension/0", "/sections/paragraphWriting/1", "/sections/vocabulary/0"}
    assert first_violation(bad).first().path == "/lesson-cover"
    assert rules.unbroken(lessons, "workbook_id", {"title": F.col("title")}, []).first().message.startswith("title: contains an unbroken text segment of 400")
    assert rules.missing_teacher_guidance(items, ["teacher"]).count() == 1 and rules.missing_teacher_guidance(items, ["student"]).count() == 0
    assert {r.path for r in rules.schema_violations(lessons, "lesson", "workbook_id", F.lit(""), [F.lit(8)]).collect()} == {"/title", "/reading_range"}
    assert without(lessons, "workbook_id", bad).count() == 0


def test_packages_and_notices(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "l").mkdir()
    (tmp_path / "m" / "workbook.json").write_text(json.dumps({"schemaVersion": 1, "id": "a", "bookTitle": "T", "author": "A", "lessonRange": "1", "lessonFiles": ["lessons/lesson-01.json"], "extra": 1}))
    (tmp_path / "l" / "1.json").write_text("{not json")
    manifests, lessons = packages.read_packages(spark, str(tmp_path / "m"), str(tmp_path / "l"))
    assert manifests.first().lessonFiles == ["lessons/lesson-01.json"]
    allowed = [x.split()[0] for x in packages.MANIFEST.split(", ")]
    assert manifests.select(rules.unknown_properties(F.to_json("doc"), allowed).alias("u")).first().u == ["extra"]
    assert packages.malformed_violations(lessons).count() == 1 and packages.malformed_violations(manifests).count() == 0
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "hello.md").write_text('---\ntitle: "Hello there"\npostedAt: 2024-05-01T00:00:00Z\nimages:\n  - public/notices/a.png\n  - b.png\n---\nBody\n')
    note = packages.read_notices(spark, str(tmp_path / "n")).first()
    assert (note.id, note.title, note.images, note.body) == ("hello", "Hello there", ["public/notices/a.png", "b.png"], "Body\n")


def test_publishing_is_staged(spark, tmp_path):
    """A failing second check leaves what was published; only changed workbooks are written; others stay."""
    path = str(tmp_path / "out")
    table = lambda rows: spark.createDataFrame(rows, "workbook_id string, n int")
    faults = lambda *books: spark.createDataFrame([(b, [1], "r", "p", "m") for b in books], "subject string, rank array<bigint>, rule string, path string, message string")
    now = lambda: sorted(tuple(r) for r in packages.read_published(spark, path).select("workbook_id", "n").collect())
    assert packages.read_published(spark, path) is None
    packages.write_packages(table([("a", 1), ("a", 2), ("b", 2), ("c", 3)]), faults("b"), path)
    assert now() == [("a", 1), ("a", 2), ("c", 3)]
    with pytest.raises(packages.NotPublished):
        packages.write_packages(table([("a", 9), ("d", 4)]), faults(), path, recheck=lambda staged: faults("d"))
    assert now() == [("a", 1), ("a", 2), ("c", 3)] and not (tmp_path / "out" / "data" / "version=2").exists()
    record = packages.write_packages(table([("a", 2), ("a", 1), ("d", 4), ("c", 5)]), faults("c"), path, recheck=lambda staged: faults())
    assert now() == [("a", 1), ("a", 2), ("c", 3), ("d", 4)]
    assert {(r.workbook_id, r.version) for r in record.collect()} == {("a", 1), ("c", 1), ("d", 2)}
    (tmp_path / "out" / "published" / "2" / "_SUCCESS").unlink()  # a record that was not written whole is no record
    assert now() == [("a", 1), ("a", 2), ("c", 3)]


def test_package_files_are_read_in_one_scan(spark, tmp_path):
    lesson = {"schemaVersion": 1, "lessonNumber": 1, "title": "t", "readingRange": "r", "sections": {"readingComprehension": [{"prompt": "p"}], "criticalThinkingAndAnalysis": [{"prompt": "p"}], "paragraphWriting": [{"prompt": "p"}], "vocabulary": [dict.fromkeys(["term", "koreanMeaning", "definition", "bookExcerpt", "excerptContext"], "w")]}}
    manifest = {"schemaVersion": 1, "id": "a", "bookTitle": "T", "author": "A", "lessonRange": "1", "lessonFiles": ["lessons/1.json", "lessons/2.json"]}
    def write(book, files):
        for name, content in files.items():
            (tmp_path / "p" / book / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "p" / book / name).write_text(content if isinstance(content, str) else json.dumps(content))
    write("sound book", {"workbook.json": manifest, "lessons/1.json": lesson, "lessons/2.json": lesson | {"lessonNumber": 2}})
    write("repeated", {"workbook.json": manifest, "lessons/1.json": lesson, "lessons/2.json": lesson | {"title": "x" * 90}})
    write("missing", {"workbook.json": manifest, "lessons/1.json": lesson | {"title": "y" * 101}})
    write("malformed", {"workbook.json": manifest, "lessons/1.json": "{no", "lessons/2.json": lesson | {"lessonNumber": 2}, "lessons/unlisted.json": "{no"})
    write("unsafe", {"workbook.json": manifest | {"lessonFiles": ["../1.json"]}})
    write("bare", {"lessons/1.json": lesson})
    write("broken", {"workbook.json": "[", "lessons/1.json": lesson})
    write("large", {"workbook.json": manifest, "lessons/1.json": lesson, "lessons/2.json": lesson | {"title": "z " * 5000}})
    bad = packages.package_violations(packages.read_package_files(spark, str(tmp_path / "p"), most_bytes=5000))
    got = {}
    for r in bad.collect():
        got.setdefault(r.subject.rsplit("/", 1)[1], []).append((list(r.rank), r.rule, r.path))
    got = {k: [x[1:] for x in sorted(v)] for k, v in got.items()}
    assert got == {
        "repeated": [("unbroken_text", "lessons/2.json/title"), ("repeated_lesson", "lessons/2.json")], "missing": [("schema", "lessons/1.json/title"), ("unbroken_text", "lessons/1.json/title"), ("missing_file", "lessons/2.json")],
        "malformed": [("malformed_json", "lessons/1.json")], "unsafe": [("schema", "/lessonFiles/0"), ("leaves_package", "../1.json")], "bare": [("missing_manifest", "workbook.json")], "broken": [("malformed_json", "workbook.json")],
        "large": [("too_large", "lessons/2.json")],
    }


def test_packed_files_read_as_loose_ones(spark, tmp_path):
    """Two hundred files lie in as many containers as tasks wrote, and read as the same files do in a folder each."""
    texts = ['{"lessonNumber": 1}', "{no", '"x"', '["' + "x" * 300 + '"]', "null", '{"a":"\u00fc\\n"}\n']
    rows = [(f"p {k % 40}", f"{k}.json", texts[k % 6]) for k in range(200)]
    files = spark.createDataFrame(rows, "package string, file string, value string").repartition(3)
    packages.write_packed_files(files, str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").glob("part-*"))) <= 3
    for package, file, value in rows:
        at = tmp_path / "loose" / f"package={package}" / f"file={file}"
        at.mkdir(parents=True)
        (at / "part").write_text(value)
    plain = lambda df: sorted(tuple(r) for r in df.withColumn("doc", F.to_json("doc")).fillna("~", ["doc"]).collect())
    for most in (None, 100):
        got = plain(packages.read_packed_files(spark, str(tmp_path / "packed"), most))
        assert got == plain(packages.read_package_files(spark, str(tmp_path / "loose"), packages.PARTITIONS, most)) and len(got) == 200
        assert sum(r[3] for r in got) == (0 if most is None else 33)


def test_replaced_tables_change_what_is_found(spark):
    cells = spark.createDataFrame([("Poster", 3, None), ("Poster", None, None), ("Poster", 3, 1), ("Atlas", None, 4), ("Atlas", None, 5), ("Short answer", None, None), (None, None, None), ("", 1, None)], "label string, lines int, pages int")
    spaces = spark.createDataFrame([("Poster", "poster", True, None), ("Atlas", "atlas", False, 5)], "label string, mode string, needs_lines boolean, least_pages int")
    got = contract.response_space(cells, F.col("label"), F.col("lines"), F.col("pages"), spaces).select("space.*").collect()
    assert [(r.mode, r.lines, r.pages, r.col) for r in got] == [("poster", 3, None, None), (None, None, None, 9), (None, None, None, 10), (None, None, None, 10), ("atlas", None, 5, None), (None, None, None, 8), (None, None, None, None), (None, None, None, 8)]
    assert got[3].problem == "is too small: this choice needs at least 5 pages."
    assert {r.mode for r in contract.response_space(cells, F.col("label"), F.col("lines"), F.col("pages")).select("space.*").collect()} == {None, "short-answer"}
    with pytest.raises(ValueError):
        shared.small(spaces, 1)


def test_replaced_sections_change_the_order_that_is_asked_for(spark):
    docs = spark.createDataFrame([("d", 1), ("e", 1)], "doc_id string, lesson_count int")
    pages = [("d", 1, "ALPHA"), ("d", 2, "OMEGA"), ("e", 1, "OMEGA"), ("e", 2, "ALPHA")]
    texts = spark.createDataFrame([(d, p, f"Page {p} of 2", c, c) for d, p, c in pages], "doc_id string, page int, text string, canonical string, header_canonical string")
    sections = spark.createDataFrame([(7, "OMEGA", "OMEGA"), (3, "ALPHA", "ALPHA")], "step int, band string, name string")
    assert [(r.doc_id, r.seen, r.wanted) for r in audit.step_order(docs, texts, sections).collect()] == [("e", [7, 3], [3, 7])]
    assert audit.marked_pages(texts).count() == 0 and audit.step_order(docs, texts).count() == 2
