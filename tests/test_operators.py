import json
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import archives, audit, inventory, parity
from tessera.plans import segments, targets
from tessera.sources import packages

RUN = "doc_id string, page int, idx int, str string, a double, b double, c double, d double, x double, y double, w double, h double"


def run(doc, page, idx, s, y=100.0, x=50.0, w=100.0, b=0.0):
    return (doc, page, idx, s, 1.0, b, 0.0, 1.0, x, y, w, 10.0)


def sound(doc, edition="student"):
    """Runs of a document of six pages that passes: cover, how-to, and four sections."""
    out = [run(doc, 1, 0, "Reading Workbook"), run(doc, 2, 0, "How to use this workbook"), run(doc, 2, 1, "Page 2 of 6")]
    for step, band, name in audit.SECTIONS:
        out += [run(doc, step + 2, 0, name, 800.0), run(doc, step + 2, 1, band), run(doc, step + 2, 2, f"Page {step + 2} of 6")]
    return out


def audited(spark, edits):
    docs, pages, runs, rules = [], [], [], []
    for doc, edit in edits.items():
        size = {p: (595.276, 841.89) for p in range(1, 7)}
        own, own_rules = sound(doc), []
        edit(own, size, own_rules)
        docs.append((doc, "student", 1))
        pages += [(doc, p, *wh) for p, wh in size.items()]
        runs += own
        rules += own_rules
    made = audit.audit(
        spark.createDataFrame(docs, "doc_id string, edition string, lesson_count int"), spark.createDataFrame(pages, "doc_id string, page int, width double, height double"),
        spark.createDataFrame(runs, RUN), spark.createDataFrame(rules, "doc_id string, page int, idx int, page_y double, width double"),
    )
    out = {doc: [] for doc in edits}
    for r in made.collect():
        out[r.subject].append(r.rule)
    return {k: sorted(v) for k, v in out.items()}


def test_audit_finds_each_fault(spark):
    swap = lambda old, new: lambda runs, size, rules: runs.__setitem__(slice(None), [(*r[:3], r[3].replace(old, new), *r[4:]) for r in runs])
    got = audited(spark, {
        "sound": lambda runs, size, rules: None,
        "size": lambda runs, size, rules: size.__setitem__(3, (600.0, 841.89)),
        "outside": lambda runs, size, rules: runs.append(run("outside", 3, 9, "far", x=590.0)),
        "rotated": lambda runs, size, rules: runs.append(run("rotated", 3, 9, "far", x=590.0, b=1.0)),
        "rule": lambda runs, size, rules: rules.append(("rule", 3, 0, -5.0, 500.0)),
        "footer": swap("Page 3 of 6", "Page 4 of 6"),
        "none": swap("Page 2 of 6", ""),
        "header": swap("VOCABULARY", "VOCAB"),
        "continued": swap("READINGCOMPREHENSION", "READINGCOMPREHENSION (continued)"),
        "how": swap("How to use", "Ways to use"),
        "order": swap("STEP3WRITE", "STEP2THINK"),
        "leak": swap("STEP4SPEAK", "STEP4SPEAK Teacher guidance"),
    })
    assert got == {
        "sound": [], "size": ["not_a4"], "outside": ["text_outside"], "rotated": [], "rule": ["rule_outside"], "footer": ["wrong_footer"], "none": ["no_footer"],
        "header": ["wrong_header"], "continued": ["continued_header"], "how": ["how_to_pages"], "order": ["step_order", "wrong_header"], "leak": ["leak"],
    }


def test_ruled_lines_and_gaps(spark):
    ops = [
        ("d", 1, 0, "save", None, None), ("d", 1, 1, "stroke", None, "#C6D0C8"), ("d", 1, 2, "transform", [1.0, 0.0, 0.0, 1.0, 0.0, 700.0], None), ("d", 1, 3, "path", [0.0, 0.0, 450.0, 0.05], None),
        ("d", 1, 4, "transform", [1.0, 0.0, 0.0, 1.0, 0.0, -audit.ROW_GAP], None), ("d", 1, 5, "path", [0.0, 0.0, 450.0, 0.0], None), ("d", 1, 6, "path", [0.0, 0.0, 300.0, 0.0], None),
        ("d", 1, 7, "restore", None, None), ("d", 1, 8, "path", [0.0, 0.0, 450.0, 0.0], None), ("d", 1, 9, "restore", None, None), ("d", 1, 10, "path", None, None),
    ]
    rules = audit.ruled_lines(spark.createDataFrame(ops, "doc_id string, page int, idx int, op string, args array<double>, color string"))
    got = rules.orderBy("idx").collect()
    assert [round(r.page_y, 3) for r in got] == [700.0, round(700 - audit.ROW_GAP, 3)] and {r.width for r in got} == {450.0}
    assert audit.wrong_gaps(rules).count() == 0 and audit.rules_per_page(rules).first().rules == 2
    assert audit.wrong_gaps(rules.withColumn("page_y", F.col("page_y") * 2)).count() == 1


def test_a_document_equals_itself_and_differs_where_it_must(spark):
    pages = spark.createDataFrame([("d", p, 1.0, 2.0) for p in (1, 2)], "doc_id string, page int, width double, height double")
    runs = spark.createDataFrame(sound("d"), RUN)
    rules = spark.createDataFrame([("d", 1, 0, 5.0, 450.0)], "doc_id string, page int, idx int, page_y double, width double")
    subjects = pages.select("doc_id").distinct()
    same, aligned = parity.document_differences(pages, pages, runs, runs, rules, rules)
    one = parity.summary(same, aligned, subjects).first()
    assert one.identical and one.differences == 0 and one.worst_offset == 0
    other = runs.withColumn("str", F.when((F.col("page") == 2) & (F.col("idx") == 0), "changed").otherwise(F.col("str"))).withColumn("x", F.col("x") + F.when(F.col("page") == 3, 0.5).otherwise(0.0005))
    diffs, aligned = parity.document_differences(pages, pages, runs, other, rules, rules)
    one = parity.summary(diffs, aligned, subjects).first()
    assert not one.identical and one.differences == 4 and one.worst_offset == pytest.approx(0.5) and one.summary == "page 2 text run 0 differs (and 3 more)"


def test_rasters(spark):
    kind = "doc_id string, page int, width int, height int, channels int, pixels binary"
    left = spark.createDataFrame([("d", 1, 2, 1, 1, bytearray([1, 250])), ("d", 2, 1, 1, 1, bytearray([0]))], kind)
    right = spark.createDataFrame([("d", 1, 2, 1, 1, bytearray([1, 3])), ("d", 2, 2, 1, 1, bytearray([0, 0]))], kind)
    got = {r.page: r for r in parity.raster_differences(left, right).collect()}
    assert (got[1].differing, got[1].worst_delta, got[2].comparable) == (1, 247, False)
    assert [r.n for r in spark.createDataFrame([("p-10.png",), ("p-9.png",)], "n string").orderBy(parity.trailing_number(F.col("n"))).collect()] == ["p-9.png", "p-10.png"]


def test_pack_examples(spark):
    rows = [("a", k, f"f{k}.pdf", 40_000) for k in range(6)] + [("b", 0, "big.pdf", 250_000), ("b", 1, "small.pdf", 10), ("c", 0, "z.pdf", 0)]
    entries = spark.createDataFrame(rows, "build_id string, seq int, name string, packed_bytes long")
    got = archives.pack(entries, 100_000)
    by = {(r.build_id, r.seq): r.archive_no for r in got.collect()}
    assert [by["a", k] for k in range(6)] == [0, 0, 1, 1, 2, 2] and (by["b", 0], by["b", 1]) == (0, 1)
    assert sorted(r.name for r in archives.first_archives(got.where("build_id = 'a'"), 1).collect()) == ["f0.pdf", "f1.pdf"]


def test_entry_metrics_and_ladder(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"abc")), ("", bytearray(b"x")), ("b", None)], "name string, content binary")
    row = archives.entry_metrics(files).collect()
    assert [(r.name, r.raw_bytes, r.crc) for r in row] == [("a.pdf", 3, zlib.crc32(b"abc"))]
    budget = spark.range(6).select(archives.laddered_budget(F.lit(2 << 20), F.col("id")).alias("b"), archives.gives_up(F.lit(2), archives.laddered_budget(F.lit(2 << 20), F.col("id"))).alias("g")).collect()
    assert [r.b >> 10 for r in budget] == [2048, 1024, 512, 256, 256, 256] and [r.g for r in budget] == [False] * 3 + [True] * 3


def test_segments(spark):
    rows = [("custom-lines", 70, None), ("custom-lines", 0, None), ("multiple-pages", None, 4), ("full-page", None, None), ("extended-answer", None, None), ("custom-lines", 49, None)]
    got = {}
    for r in segments.segments(spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, mode string, lines long, pages long")).orderBy("k", "part").collect():
        got.setdefault(r.k, []).append(r.part_lines)
    assert got == {0: [14, 35, 21], 1: [0], 2: [None] * 4, 3: [None], 4: [12], 5: [14, 35]}


def test_targets(spark):
    assert targets.editions(["Teacher", "student", "teacher"]) == ["student", "teacher"]
    with pytest.raises(ValueError):
        targets.editions(["pupil"])
    books = spark.createDataFrame([("bk", "Book")], "book_id string, title string")
    lessons = spark.createDataFrame([("bk", 0, 2), ("bk", 1, 12), ("bk", 2, 123)], "book_id string, position int, lesson_number long")
    disk = targets.disk_targets(books, lessons)
    assert [r.name for r in disk.where("edition = 'student'").orderBy("seq").collect()] == ["bk-workbook-student.pdf", "bk-lesson-02-student.pdf", "bk-lesson-12-student.pdf", "bk-lesson-123-student.pdf"]
    targets.register(spark)
    lessons.createOrReplaceTempView("book_lessons")
    named = spark.sql("select t.name from (select book_id, collect_list(lesson_number) as n from book_lessons group by 1) b, lateral expand_targets(b.book_id, b.n) t")
    assert targets.name_differences(disk, named).count() == 0
    one = packages.build_summary(disk, books).first()
    assert one.lessons_text == "3 lessons" and one.files.startswith("bk-workbook-student.pdf, bk-lesson-02-student.pdf")
    docs = packages.bundles(disk, books.select("book_id", F.struct("title").alias("manifest")), lessons.select("book_id", "lesson_number", F.struct("lesson_number").alias("lesson")))
    got = {r.name: r.bundle for r in docs.collect()}
    assert got["bk-lesson-12-teacher.pdf"] == '{"schemaVersion":1,"build":{"scope":"lesson","edition":"teacher"},"manifest":{"title":"Book"},"lessons":[{"lesson_number":12}]}'
    assert len(got) == 8


def test_text_functions(spark):
    text.register(spark)
    rows = spark.createDataFrame([("Ça va: L’été №1",), ("한글",), (" 　",), (None,)], "t string")
    got = rows.select(text.slug(F.col("t")).alias("s"), text.layout_units(F.col("t")).alias("u"), text.is_blank(F.col("t")).alias("b"), text.padded(F.length("t")).alias("p")).collect()
    assert [r.s for r in got] == ["ca-va-l-ete-no1", "", "", None] and [r.u for r in got] == [15, 4, 2, 0] and [r.b for r in got] == [False, False, True, True]
    assert [tuple(r) for r in rows.selectExpr("slug_text(t)", "layout_units(t)", "is_blank_text(t)").collect()] == [(r.s, r.u, r.b) for r in got]
    warn = spark.createDataFrame([("ok\nWarning: x",), ("no warning: y",)], "t string").select(text.has_warning(F.col("t")).alias("w")).collect()
    assert [r.w for r in warn] == [True, False]
    name = spark.range(1).select(text.safe_folder(F.lit(' a/b:c ')).alias("a"), text.safe_folder(F.lit("  ")).alias("b"), text.area_of(F.lit("project/assets/fonts/x")).alias("c")).first()
    assert tuple(name) == ("a-b-c", "Workbook", "fonts")


def test_inventory(spark):
    files = spark.createDataFrame([("/vendor/x", 26 << 20, 1), ("/project/src/y", 22_800_000, 1), ("/other", 1, 1)], "path string, bytes long, compressed_bytes long")
    assert [(r.path, r.size) for r in inventory.over_host_limit(files).collect()] == [("/vendor/x", "26.00 MiB")]
    assert [r.value for r in inventory.first_rule(files).orderBy(F.desc("bytes")).collect()] == ["public, max-age=31536000, immutable", "no-cache", "no-cache"]
    assert {(r.path, r.problem) for r in inventory.list_differences(files.limit(0), files.limit(0)).collect()} == set()


def test_pack_is_one_linear_pass_and_keeps_null_keys(spark):
    import time

    rows = spark.range(100_000).select(F.lit("a").alias("build_id"), F.col("id").alias("seq"), (F.col("id") * 7919 % 4000).alias("packed_bytes"))
    rows = rows.unionByName(spark.createDataFrame([(None, k, 60_000) for k in range(4)] + [("b", 0, None), ("b", 1, 5)], "build_id string, seq long, packed_bytes long"))
    began = time.time()
    got = archives.pack(rows, 100_000).toPandas()
    assert time.time() - began < 30 and len(got) == 100_006
    own = got[got.build_id == "a"].sort_values("seq")
    no, held, want = 0, 0, []
    for x in own.packed_bytes.astype(int):
        if held + x > 100_000:
            no, held = no + 1, 0
        held += x
        want.append(no)
    assert own.archive_no.tolist() == want
    assert got[got.build_id.isna()].sort_values("seq").archive_no.tolist() == [0, 1, 2, 3] and set(got[got.build_id == "b"].archive_no) == {0}


def test_leaks_of_any_length(spark):
    texts = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta"), (2, "concatenate"), (3, None), (4, "x alpha  beta"), (5, "")], "id long, body string")
    asked = [(1, "pha beta gamma delta epsilon ze"), (2, "cat"), (3, "ta gam"), (4, "beta gamma delta"), (5, "alpha beta"), (6, None), (7, ""), (8, "a b"), (9, "a  b")]
    got = {tuple(r) for r in audit.leaks(texts, spark.createDataFrame(asked, "pid long, words string"), "id", "body", "pid", "words").collect()}
    want = {(i, p) for i, t in [(1, "alpha beta gamma delta epsilon zeta eta"), (2, "concatenate"), (4, "x alpha  beta"), (5, "")] for p, w in asked if w and w in t}
    assert got == want and len(want) > 5


def test_passages_that_begin_alike_meet_only_their_rarest_runs(spark):
    """A thousand passages with one common beginning, which most texts hold; pairs that meet are counted."""
    common = "this text was written by the same hand and begins as all the others do"
    texts = [(k, f"{common} tail{k} goes on here for a while; {common} end") for k in range(400)] + [(400 + k, f"{common} nothing else {k}") for k in range(200)]
    asked = [(k, f"{common} tail{k} goes on here") for k in range(1000)]
    t, p = spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame(asked, "pid long, words string")
    met = audit.leak_candidates(t, p, "id", "body", "pid", "words").count()
    got = {tuple(r) for r in audit.leaks(t, p, "id", "body", "pid", "words").collect()}
    assert got == {(k, k) for k in range(400)} and met <= 2 * len(got)


def test_rules_by_table_spread_paths_by_rule_lengths_alone(spark):
    """Twenty thousand rules of three lengths, an exact one, an empty prefix and ties, against trying them one by one."""
    rules = [(k, f"/{k % 97:02d}/{k:05d}*" if k % 2 else f"/{k % 97:02d}*", f"v{k}") for k in range(20_000)] + [(20_000, "/exact", "e"), (20_001, "*", "all"), (20_002, "/exact", "late")]
    paths = [f"/{k % 97:02d}/{k:05d}/x" for k in range(0, 20_000, 499)] + ["/exact", "/exactly", "", "/x"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    made = inventory.first_rule_by_table(frame, spark.createDataFrame(rules, "rule_no int, pattern string, value string"))
    fits = lambda p, r: p.startswith(r[:-1]) if r.endswith("*") else p == r
    assert {r.path: r.value for r in made.collect()} == {p: next(v for _, r, v in rules if fits(p, r)) for p in paths}


def test_every_leaf_is_walked(spark):
    from tessera.operators import schema as rules

    docs = spark.createDataFrame([("b", '{"guidance":["fine","also fine","' + "x" * 90 + '"],"deep":{"a":[{"t":"' + "y" * 81 + '"}]},"n":5}'), ("c", '{"a":"' + "z" * 80 + '"}')], "id string, j string").select("id", F.parse_json("j").alias("doc"))
    got = {(r.subject, r.path) for r in rules.unbroken_leaves(docs, "id", "doc", [F.lit(7)]).collect()}
    assert got == {("b", "/guidance/2"), ("b", "/deep/a/0/t")}


def test_a_replaced_rule_table_decides(spark):
    from tessera.operators import rules

    rows = spark.createDataFrame([("b", "t" * 30, "r")], "workbook_id string, title string, reading_range string")
    check = lambda table: rules.schema_violations(rows, "lesson", "workbook_id", F.lit(""), [F.lit(1)], table).count()
    table = rules.rule_table(spark)
    tight = table.withColumn("bound", F.when((F.col("field") == "title") & (F.col("check") == "max_length"), 20).otherwise(F.col("bound")))
    assert check(None) == check(table) == 0 and check(tight) == 1


def test_leaves_of_any_depth_are_walked(spark):
    """Planted runs at depths 1 to 12, one at 41 (beyond what one plan opens), and runs under $schema, which are left out."""
    from tessera.operators import schema

    def deep(k, run):
        return '{"d":[' * k + '{"t":"' + run + '","$schema":"' + "s" * 99 + '","x":{"$schema":["' + "s" * 99 + '"]},"e":{},"f":[]}' + "]}" * k

    rows = [(f"n{k}", deep(k, "y" * (81 + k))) for k in range(12)] + [("far", deep(20, "z" * 99)), ("root", '"' + "r" * 90 + '"'), ("none", None), ("short", deep(3, "y" * 80)), ("$schemas", '{"$schemas":"' + "q" * 85 + '"}')]
    docs = spark.createDataFrame(rows, "id string, j string").select("id", F.try_parse_json("j").alias("doc"))
    got = {(r.subject, r.path) for r in schema.unbroken_leaves(docs, "id", "doc", [F.lit(7)]).collect()}
    assert got == {(f"n{k}", "/d/0" * k + "/t") for k in range(12)} | {("far", "/d/0" * 20 + "/t"), ("root", ""), ("$schemas", "/$schemas")}


def test_a_walk_hands_on_a_text_once(spark):
    """However deep a text lies, only its own place carries it; 900 levels are walked in one pass, without a table in between."""
    from tessera.operators import schema

    rows = [(k, '{"d":[' * k + '{"t":"' + "y" * 99 + '","n":1.50,"b":true,"z":null,"e":1E40}' + "]}" * k) for k in (0, 12, 450)]
    docs = spark.createDataFrame(rows, "id long, j string").select("id", F.parse_json("j").alias("doc"))
    places = schema.walked(docs, "id", "doc", wanted=schema.Wanted(whole=frozenset())).collect()
    assert sum(len(r.text or "") + len(r.json or "") for r in places) <= 3 * 130
    assert {r.subject: r.path for r in places if r.text} == {k: "/d/0" * k + "/t" for k, _ in rows}
    assert {(r.shape, r.kind) for r in places if r.subject == 0} == {("", "object"), ("/t", "string"), ("/n", "decimal(2,1)"), ("/b", "boolean"), ("/z", "null"), ("/e", "double")}
    assert schema.unbroken_leaves(docs, "id", "doc", []).count() == 3
    whole = {(r.subject, r.path): r.json for r in schema.walked(docs, "id", "doc").collect()}
    assert all(whole[r.id, ""] == r.j for r in docs.select("id", F.to_json("doc").alias("j")).collect())


def test_sound_texts_are_not_handed_on(spark):
    """Texts that no rule can find fault with stay in the walk; those at and over the bounds, blank ones and other kinds are judged as by the rules one by one."""
    from tessera.operators import schema

    texts = ["", "a", "ab", "abc", "abcd", " ", "\u3000\ufeff", "\x85", "\U0001f600" * 3, "\U0001f600" * 4, 5, None, True, ["abcd"], {"a": "b"}]
    docs = spark.createDataFrame([("n", json.dumps({"a": texts, "b": texts}))], "id string, j string").select("id", F.parse_json("j").alias("doc"))
    rules = [("/a/*", "type", "string"), ("/a/*", "min_length", "2"), ("/a/*", "min_length", "1"), ("/a/*", "max_length", "3"), ("/a/*", "not_blank", r"\S"), ("/b/*", "max_length", "3"), ("/b/*", "pattern", "^a")]
    table = spark.createDataFrame([("note", k, shape, None, check, bound) for k, (shape, check, bound) in enumerate(rules)], schema.RULE)
    limit = schema.RULES
    got = sorted((r.path, r.message) for r in schema.schema_violations(docs, "note", "id", "doc", [], table).collect())
    try:
        schema.RULES = 0  # a larger table is not known to the walk, which gives all places
        assert got == sorted((r.path, r.message) for r in schema.schema_violations(docs, "note", "id", "doc", [], table).collect())
    finally:
        schema.RULES = limit
    wanted = schema._wanted(table.collect())
    assert wanted.sound == {"/a/*": (2, 3)} and wanted.shapes == {"/a/*", "/b/*"}
    given = {r.path for r in schema.walked(docs, "id", "doc", wanted=wanted).collect()}
    assert "/a/2" not in given and "/a/3" not in given and "/a" not in given and {"/a/0", "/a/1", "/a/4", "/a/6", "/a/9", "/b/3"} <= given
    assert {p for p, _ in got if p.startswith("/a")} == {f"/a/{k}" for k in (0, 1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14)}


def test_typed_documents_are_judged_by_columns(spark):
    """Documents of a Spark schema break the rules that they break as VARIANTs; without open types none is handed to a walk of JSON."""
    from tessera.operators import schema

    kind = """a array<string>, b array<string>, n double, k int, t boolean, s string, w array<int>, m map<string,string>, f float, v variant,
      items array<struct<s: string, o: struct<mode: string, pages: int, lines: double, odd: variant>, v: variant, g: array<array<string>>>>, none struct<s: string>"""
    texts = ["", "a", "ab", "abc", "abcd", " ", "\u3000\ufeff", "\x85", "\x1f", "\U0001f600" * 3, "\U0001f600" * 4, "\ud55c\uad6d", "\ud55c\uad6d\uc5b4\ub9d0", "\xa0\xa0", "\xa1\xa1", "\u1680\u2003", "\u3001\u3001", "\ufeff\ufeff", "\ufe4f\ufe4f", "\x80\x80", None]
    unions = [{"mode": "one", "pages": 1}, {"mode": "two", "pages": 0}, {"mode": "two", "lines": 0.5}, {"mode": "two"}, {"mode": "poster", "pages": 3, "odd": 1}, {"lines": 2.0}, {}, None]
    items = [{"s": s, "o": o, "v": v, "g": g} for s, o, v, g in zip(["", "x", " ", None, "long text", "y", "z", "w"], unions, [1, "one", None, [1, "xxxx", None], {"p": "abcd"}, True, 1.5, []], [None, [], [["a", None, "abcd"], None], [[]], [["", " "]], None, None, None])]
    full = {"a": texts, "b": texts, "n": 0.5, "k": 7, "t": True, "s": "s", "w": [1, 2, 2, None], "m": {"p": "abcd", "q": ""}, "f": 0.1, "v": {"p": ["x", "abcd"]}, "items": [*items, None]}
    rows = [{"id": f"d{k}", "doc": d} for k, d in enumerate([full, {**full, "n": 3.0, "k": 1, "t": False, "v": "v", "s": ""}, {"n": 1e40, "items": [], "a": []}, {"n": -2.0, "none": {}}, {"none": {"s": "abcd"}}, None])]
    docs = spark.createDataFrame([(r["id"], json.dumps(r["doc"])) for r in rows], "id string, j string").select("id", F.from_json("j", kind).alias("doc"))
    docs = docs.where("id <> 'd5'").unionByName(docs.where("id = 'd5'").select("id", F.lit(None).cast(docs.schema["doc"].dataType).alias("doc")))
    text = lambda at: [(at, None, "type", "string"), (at, None, "min_length", "2"), (at, None, "max_length", "3"), (at, None, "not_blank", r"\S")]
    rules = [
        *text("/a/*"), *text("/b/*"), ("/b/*", None, "pattern", "^a"), ("/a", None, "max_items", "3"), ("/a", None, "min_items", "1"), ("/n", None, "type", "integer"), ("/n", None, "minimum", "0"), ("/n", None, "const", "3"), ("/n", None, "type", "bigint"),
        ("/k", None, "enum", '["1","x"]'), ("/k", None, "type", "string"), ("/k", None, "type", "number"), ("/t", None, "const", "true"), ("/t", None, "type", "integer"), *text("/s"), ("/s", None, "type", "array"), ("/s", None, "enum", '["s"]'), ("/s", None, "const", '"s"'),
        ("/w", None, "unique_items", None), ("/w/*", None, "minimum", "2"), ("/w/*", None, "type", "integer"), *text("/m/p"), *text("/m/q"), ("/m", None, "closed", None), ("/m", None, "property", "q"), ("/f", None, "minimum", "0.2"), *text("/v/p/*"), ("/v", None, "type", "object"),
        ("", None, "required", "s"), ("", None, "required", "other"), ("", "x", "required", "absent"), ("", None, "closed", None), *[("", None, "property", x) for x in ("a", "b", "n", "k", "t", "items", "none")], ("/none", None, "required", "s"), *text("/none/s"),
        ("/items", None, "type", "array"), ("/items/*", None, "type", "object"), ("/items/*", None, "required", "v"), *text("/items/*/s"), *text("/items/*/v/*"), ("/items/*/v", None, "type", "array"), ("/items/*/v", None, "minimum", "2"), *text("/items/*/g/*/*"), ("/items/*/g/*", None, "min_items", "1"),
        ("/items/*/o", None, "tag", "mode"), ("/items/*/o", "one", "variant", None), ("/items/*/o", "two", "variant", None), ("/items/*/o", None, "closed", None), ("/items/*/o", None, "property", "mode"), ("/items/*/o", "two", "property", "pages"), ("/items/*/o", "two", "required", "pages"),
        ("/items/*/o/pages", None, "minimum", "1"), ("/items/*/o/lines", None, "type", "integer"), ("/items/*/o/odd", None, "type", "string"),
    ]
    table = spark.createDataFrame([("note", k, *r) for k, r in enumerate(rules)], schema.RULE)
    judged = lambda df, rules=table: sorted(map(str, schema.schema_violations(df, "note", "id", "doc", [F.lit(3)], rules).collect()))
    as_json = docs.select("id", F.parse_json(F.to_json("doc")).alias("doc"))
    got = judged(docs)
    assert got == judged(as_json) and len(got) > 150
    odd = spark.createDataFrame([("x", (float("nan"),)), ("y", (float("-inf"),)), ("z", (-0.0,))], "id string, doc struct<n: double>")
    of_n = spark.createDataFrame([("note", k, "/n", None, *r) for k, r in enumerate([("type", "integer"), ("type", "string"), ("type", "number"), ("minimum", "1"), ("max_length", "2"), ("enum", '["NaN"]'), ("const", '"NaN"')])], schema.RULE)
    assert judged(odd, of_n) == judged(odd.select("id", F.parse_json(F.to_json("doc")).alias("doc")), of_n)
    limit = schema.COLUMN_RULES
    try:
        schema.COLUMN_RULES = 5
        assert got == judged(docs)
    finally:
        schema.COLUMN_RULES = limit
    plan = lambda df: schema.schema_violations(df, "note", "id", "doc", [], table)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan(docs.select("id", F.struct("doc.a", "doc.n", "doc.k", "doc.s").alias("doc"))) and "MapInArrow" in plan(as_json)
    assert plan(as_json).count("parseJson(invoke(StructsToJson") == 1  # a VARIANT is made once a row


def test_schema_rules_are_data(spark):
    """One document with a fault of every kind, and what replaced tables make of others."""
    from tessera.operators import schema

    lesson = {
        "schemaVersion": 2, "title": " ", "extra": 1, "$schema": 5, "lessonNumber": 0.5, "framingNote": "n" * 401, "studentInstructions": None,
        "sections": {
            "readingComprehension": [{"prompt": "p", "responseSpace": {"mode": "poster"}}, {"prompt": "", "responseSpace": {"mode": "custom-lines", "lines": -1, "pages": 3}, "responseGuidance": list("abcdefg")}, {"prompt": "p", "responseSpace": {"mode": "multiple-pages"}}],
            "criticalThinkingAndAnalysis": [], "paragraphWriting": "text", "vocabulary": [{"term": "t", "koreanMeaning": "k", "definition": "d", "bookExcerpt": "b", "excerptContext": "c", "odd": []}],
        },
    }
    manifest = {"schemaVersion": 1, "id": "Not An Id", "bookTitle": "t", "author": "a", "lessonRange": "1", "lessonFiles": ["lessons/a.json", "lessons/a.json", "../b.json"]}
    docs = spark.createDataFrame([("lesson", json.dumps(lesson)), ("manifest", json.dumps(manifest)), ("none", None), ("list", "[]")], "id string, j string").select("id", F.try_parse_json("j").alias("doc"))
    got = {(r.subject, r.path, r.message.split(": ", 1)[1]) for kind in ("lesson", "manifest") for r in schema.schema_violations(docs.where((F.col("id") == kind) | (F.col("id") == "none")), kind, "id", "doc", [F.lit(8)]).collect()}
    rc = "/sections/readingComprehension"
    assert got == {
        ("lesson", "/schemaVersion", "must be equal to constant"), ("lesson", "/title", 'must match pattern "\\S"'), ("lesson", "/extra", "must NOT have additional properties"), ("lesson", "/$schema", "must be string"),
        ("lesson", "/lessonNumber", "must be integer"), ("lesson", "/lessonNumber", "must be >= 1"), ("lesson", "/framingNote", "must NOT have more than 400 characters"), ("lesson", "/studentInstructions", "must be string"),
        ("lesson", "/readingRange", "must have required property 'readingRange'"), ("lesson", f"{rc}/0/responseSpace", "must match exactly one schema in oneOf"), ("lesson", f"{rc}/1/prompt", "must NOT have fewer than 1 characters"),
        ("lesson", f"{rc}/1/prompt", 'must match pattern "\\S"'), ("lesson", f"{rc}/1/responseSpace/lines", "must be >= 0"), ("lesson", f"{rc}/1/responseSpace/pages", "must NOT have additional properties"),
        ("lesson", f"{rc}/1/responseGuidance", "must NOT have more than 6 items"), ("lesson", f"{rc}/2/responseSpace/pages", "must have required property 'pages'"), ("lesson", "/sections/criticalThinkingAndAnalysis", "must NOT have fewer than 1 items"),
        ("lesson", "/sections/paragraphWriting", "must be array"), ("lesson", "/sections/vocabulary/0/odd", "must NOT have additional properties"), ("manifest", "/id", f'must match pattern "{schema.ID_PATTERN}"'),
        ("manifest", "/lessonFiles", "must NOT have duplicate items"), ("manifest", "/lessonFiles/2", f'must match pattern "{schema.FILE_PATTERN}"'),
    }
    assert schema.schema_violations(docs.where("id = 'list'"), "lesson", "id", "doc", []).first().message == "/: must be object"
    table = schema.schema_table(spark)
    looser = table.where("not (shape = '/title') and not (check = 'closed')")
    own = spark.createDataFrame([("note", 0, "/a/*", None, "enum", '["x","7"]'), ("note", 1, "/a", None, "max_items", "3")], schema.RULE)
    paths = {r.path for r in schema.schema_violations(docs.where("id = 'lesson'"), "lesson", "id", "doc", [], looser).collect()}
    assert "/title" not in paths and "/extra" not in paths and "/schemaVersion" in paths
    notes = spark.createDataFrame([("n", '{"a":["x",7,"y",8],"b":1}')], "id string, j string").select("id", F.parse_json("j").alias("doc"))
    assert sorted(r.path for r in schema.schema_violations(notes, "note", "id", "doc", [], own).collect()) == ["/a", "/a/2", "/a/3"]


def next_fit_by_hand(sizes, budget):
    out, no, held, n = [], 0, 0, 0
    for x in sizes:
        if n and held + x > budget:
            no, held, n = no + 1, 0, 0
        out.append(no)
        held, n = held + x, n + 1
    return out, held


def test_transfer_tells_what_follows_from_any_open_archive():
    rng = np.random.default_rng(3)
    for turn in range(300):
        sizes = rng.choice([0, 1, 2, 5, 9, 30], 1 + rng.integers(40), p=rng.dirichlet(np.ones(6)))
        row = SimpleNamespace(**archives.transfer(sizes, 12))
        for before in ([], [0], [3], [7, 2], [12], [30], [5, 12, 1]):
            had, held = next_fit_by_hand(before, 12)
            numbers, wanted = next_fit_by_hand([*before, *sizes.tolist()], 12)
            assert archives.carried(row, 12, held, len(before)) == (numbers[-1] - (had[-1] if had else 0), wanted), (turn, before)
    assert len(archives.transfer(rng.integers(1, 9, 10_000), 1000)["room"]) < 60  # starts flow together


def test_pack_is_the_same_over_any_segments(spark):
    rng = np.random.default_rng(5)
    rows = [(b, k, int(x)) for b, n in ((None, 300), ("", 1), ("a", 4000), ("b", 40), ("c", 900)) for k, x in enumerate(rng.choice([0, 10, 300, 900, 1500], n))]
    df = spark.createDataFrame(rows, "build_id string, seq int, packed_bytes long").repartition(7)
    found = {}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in ("1", "3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found[parts] = sorted(map(tuple, archives.pack(df, 1000).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by_build = {}
    for b, k, x in rows:
        by_build.setdefault(b, []).append(x)
    wanted = sorted(((b, k, x, no) for b, own in by_build.items() for k, (x, no) in enumerate(zip(own, next_fit_by_hand(own, 1000)[0]))), key=str)
    assert found["1"] == found["3"] == found["16"] == wanted
    assert archives.pack(df.limit(0), 1000).count() == 0


def test_sizes_round_as_their_sql(spark):
    """Ties (bytes in multiples of 16,384 of thousandfold size) go to even, as printf has it, and so do their neighbours' last digits."""
    import duckdb

    sizes = [1000 * n for k in range(1, 40) for n in (16384 * k - 1, 16384 * k, 16384 * k + 1)] + [0, 1, 5 << 20, 123_456_789_012_345, (1 << 53) - 1]
    rows = spark.createDataFrame([(str(x), x) for x in sizes], "path string, bytes long")
    got = {r.bytes: (r.size, r.mb) for r in inventory.over_host_limit(rows, -1).withColumn("mb", text.megabytes(F.col("bytes"))).collect()}
    text.register(spark)
    assert {r.bytes: r.mb for r in rows.selectExpr("bytes", "megabytes_text(bytes) as mb").collect()} == {k: mb for k, (_, mb) in got.items()}
    con = duckdb.connect()
    assert got == {x: con.execute("select printf('%.2f MiB', $1::bigint / 1048576.0), printf('%.2f MB', $1::bigint / 1048576.0)", [x]).fetchone() for x in sizes}
    assert got[16_384_000] == ("15.62 MiB", "15.62 MB")
