"""Queries of whole audits, replays, document comparisons and the checks around packages, on planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators import archives, assembly, audit, contract, essays, inventory, parity, rules, schema
from tessera.operators.violations import first_violation
from tessera.plans import targets
from tessera.queries.base import query
from tessera.queries.importing import _cells
from tessera.sources import packages

_STEPS = [("Step 1: Read", "Reading Comprehension"), ("Step 2: Think", "Critical Thinking & Analysis"), ("Step 3: Write", "Paragraph Writing"), ("Step 4: Speak", "Vocabulary")]


def _documents(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs, pages, runs and rules of the conversations, a turn a page, with the fault ``conv_id % 12`` on each second page."""
    rows = t("conversations").select(F.col("conv_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    rows = rows.withColumns({"page": F.row_number().over(Window.partitionBy("doc_id").orderBy("turn")), "n": F.count("*").over(Window.partitionBy("doc_id"))})
    page, fault = F.col("page"), F.when(F.col("page") == 2, F.col("doc_id") % 12).otherwise(0)
    lessons = F.floor((F.col("n") - 1) / 4)
    step = F.when((page > 1) & (page <= 1 + 4 * lessons), F.when(fault == 9, 2).otherwise((page - 2) % 4 + 1))
    rows = rows.withColumns({"fault": fault, "step": step, "lesson_count": lessons})
    name = lambda k: F.get(F.array(*[F.lit(x[k]) for x in _STEPS]), F.col("step").cast("int") - 1)
    how = F.when(F.col("doc_id") % 12 == 8, "Reading Workbook").otherwise("Reading Workbook: how to use this workbook")
    header = F.concat(F.when((F.col("fault") == 6) | F.col("step").isNull(), "").otherwise(name(1)), F.when(F.col("fault") == 7, " (continued)").otherwise(""))
    band = F.when(page == 1, how).otherwise(F.coalesce(name(0), F.lit("")))
    mark = F.when(F.col("fault") == 10, " Teacher guidance").otherwise("")
    foot = F.when((page > 1) & (F.col("fault") != 4), F.format_string("Page %d of %d", F.when(F.col("fault") == 5, 99).otherwise(page), F.col("n") + F.when(F.col("fault") == 11, 1).otherwise(0)))
    run = lambda idx, text, x, y: F.struct(F.lit(idx).alias("idx"), text.alias("str"), x.alias("x"), F.lit(y).alias("y"))
    at = F.lit(50.0)
    parts = F.array(run(0, header, at, 821.89), run(1, F.concat(band, mark), at, 700.0), run(2, F.col("text"), F.when(F.col("fault") == 2, -5.0).otherwise(at), 400.0), run(3, F.coalesce(foot, F.lit("")), at, 20.0))
    number = lambda x, c: F.lit(x).alias(c)
    pages = rows.select("doc_id", "page", (F.lit(595.276) + F.when(F.col("fault") == 1, 10.0).otherwise(0.0)).alias("width"), number(841.89, "height"))
    runs = rows.select("doc_id", "page", F.explode(parts).alias("r")).select("doc_id", "page", "r.*", number(1.0, "a"), number(0.0, "b"), number(0.0, "c"), number(1.0, "d"), number(10.0, "w"), number(10.0, "h"))
    lines = rows.select("doc_id", "page", number(0, "idx"), F.when(F.col("fault") == 3, 1000.0).otherwise(100.0 + page).alias("page_y"))
    docs = rows.where("page = 1").select("doc_id", F.when(F.col("doc_id") % 8 < 4, "student").otherwise("teacher").alias("edition"), "lesson_count")
    return docs, pages, runs, lines


_PLANTED = """
with r as (select conv_id, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn) as page, count(*) over (partition by conv_id) as n from conversations),
f as (select *, case when page = 2 then conv_id % 12 else 0 end as fault, (n - 1) // 4 as lessons from r),
p as (select *, case when page > 1 and page <= 1 + 4 * lessons then case when fault = 9 then 2 else (page - 2) % 4 + 1 end end as step, page > 1 and fault <> 4 as footed from f),
d as (select conv_id, any_value(n) as n, any_value(lessons) as lessons, coalesce(string_agg(step::varchar, ', ' order by page) filter (where step is not null and footed), '') as seen from p group by 1),
w as (select *, rtrim(repeat('1, 2, 3, 4, ', lessons::int), ', ') as wanted from d),
v as (
  select conv_id, page as place, 1 as kind, 'not_a4' as rule, 'page ' || page as path, 'page ' || page || ' is 605.28 x 841.89 points, not A4' as message from p where fault = 1 union all
  select conv_id, page, 2, 'text_outside', 'page ' || page, 'text leaves the page: ' || substr(text, 1, 40) from p where fault = 2 and length(text) > 0 union all
  select conv_id, page, 3, 'rule_outside', 'page ' || page, 'a response rule leaves the page' from p where fault = 3 union all
  select conv_id, page, 4, 'no_footer', 'page ' || page, 'expected a page-number footer' from p where fault = 4 union all
  select conv_id, page, 5, 'wrong_footer', 'page ' || page, 'printed Page ' || case when fault = 5 then 99 else page end || ' of ' || case when fault = 11 then n + 1 else n end || ', expected Page ' || page || ' of ' || n from p where fault in (5, 11) union all
  select conv_id, page, 6, 'wrong_header', 'page ' || page, 'step ' || step || ' does not have the expected running header' from p where fault = 6 and step is not null union all
  select conv_id, page, 7, 'continued_header', 'page ' || page, 'running headers must use the section name alone' from p where fault = 7 union all
  select conv_id, 1099511627776, 1, 'how_to_pages', 'document', 'expected exactly one how-to page; found 0' from d where conv_id % 12 = 8 union all
  select conv_id, 1099511627776, 2, 'step_order', 'document', 'observed ' || seen || '; expected ' || wanted from w where seen <> wanted union all
  select conv_id, 1099511627776, 3, 'leak', 'document', 'teacher-only guidance in a student document' from p where fault = 10 and conv_id % 8 < 4
)
"""


def _audited(t):
    docs, pages, runs, lines = _documents(t)
    return docs, pages, audit.audit(docs, pages, runs, lines)


@query(_PLANTED + "select conv_id, rule, path, message from v")
def q_audit_findings(t):
    """Everything that an audit finds in documents with one fault each."""
    return _audited(t)[2].select(F.col("subject").cast("long").alias("conv_id"), "rule", "path", "message")


@query(_PLANTED + "select d.conv_id, d.n::bigint as pages, count(v.rule) = 0 as passed, count(v.rule)::bigint as violations, arg_min(v.rule, v.place * 10 + v.kind) as first_rule from d left join v using (conv_id) group by 1, 2")
def q_audit_verdicts(t):
    """Each document's pages, verdict and first finding."""
    docs, pages, bad = _audited(t)
    first = first_violation(bad).select(F.col("subject").cast("long").alias("doc_id"), F.col("rule").alias("first_rule"))
    return audit.audit_report(docs, pages, bad).join(first, "doc_id", "left").withColumnRenamed("doc_id", "conv_id")


@query("select l_orderkey as doc_id, l_linenumber::int as page, count(*)::bigint as rules from lineitem group by 1, 2")
def q_rules_per_page(t):
    return audit.rules_per_page(t("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")))


_COMPARED = """
with r as (select conv_id, text, role, row_number() over (partition by conv_id order by turn) as page, count(*) over (partition by conv_id) as n from conversations),
g as (select *, case when page = 2 then conv_id % 7 else 0 end as fault from r),
d as (
  select conv_id, 0 as place, 0 as kind, n || ' pages versus ' || (n - 1) as message from g where page = 1 and conv_id % 14 = 7 union all
  select conv_id, page, 1, 'page ' || page || ' differs in size' from g where fault = 1 union all
  select conv_id, page, 2, 'page ' || page || ' has 2 text runs versus 1' from g where fault = 2 union all
  select conv_id, page, 3, 'page ' || page || ' text run 1 differs' from g where fault = 3 union all
  select conv_id, page, 4, 'page ' || page || ' moves text run 2 by 0.500 points' from g where fault = 4 union all
  select conv_id, page, 5, 'page ' || page || ' has 1 response rules versus 0' from g where fault = 5 union all
  select conv_id, page, 6, 'page ' || page || ' moves a response rule by 0.250 points' from g where fault = 6
)
"""


def _versions(t):
    """pages, runs and rules of the conversations twice, the second with the fault ``conv_id % 7`` on each second page."""
    rows = t("conversations").select(F.col("conv_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("role"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("page"))
    fault = F.when(F.col("page") == 2, F.col("doc_id") % 7).otherwise(0)

    def side(changed: bool):
        own = rows.withColumn("fault", fault if changed else F.lit(0).cast("long"))
        k = F.col("fault")
        pages = own.select("doc_id", "page", F.when(k == 1, 601.0).otherwise(600.0).alias("width"), F.lit(800.0).alias("height"))
        if changed:
            pages = pages.where("not (page = 1 and doc_id % 14 = 7)")
        x = F.col("page") * 10.0 + F.when(k == 6, 0.0005).otherwise(0.0)
        both = F.array(
            F.struct(F.lit(1).alias("idx"), F.concat("text", F.when(k == 3, "!").otherwise("")).alias("str"), x.alias("x")),
            F.struct(F.lit(2).alias("idx"), F.col("role").alias("str"), (x + F.when(k == 4, 0.5).otherwise(0.0)).alias("x")),
        )
        runs = own.select("doc_id", "page", F.explode(F.when(k == 2, F.slice(both, 1, 1)).otherwise(both)).alias("r")).select("doc_id", "page", "r.*", F.lit(50.0).alias("y"), F.lit(10.0).alias("w"))
        lines = own.where("fault <> 5").select("doc_id", "page", F.lit(1).alias("idx"), (100.0 + F.col("page") + F.when(k == 6, 0.25).otherwise(0.0)).alias("page_y"), F.lit(450.0).alias("width"))
        return pages, runs, lines

    left, right = side(False), side(True)
    made = [x for pair in zip(left, right, strict=True) for x in pair]
    return rows.select("doc_id").distinct(), *parity.document_differences(*made)


@query(_COMPARED + "select conv_id, message from d")
def v_document_differences(t):
    """All that differs between two versions of each document: pages, sizes, runs and rules."""
    return _versions(t)[1].select(F.col("doc_id").alias("conv_id"), "message")


@query(_COMPARED + """, c as (select conv_id, any_value(n) * 3 - case when conv_id % 7 in (2, 5) then 1 else 0 end as compared from r group by 1)
select c.conv_id, d.message is null as identical, c.compared::bigint as compared, case c.conv_id % 7 when 4 then 0.5 when 6 then 0.25 else 0 end::double as worst_offset, d.message as summary from c left join d using (conv_id)
""")
def v_document_verdicts(t):
    """Verdict, worst offset and first difference of each pair of versions."""
    docs, bad, aligned = _versions(t)
    made = parity.summary(bad, aligned, docs)
    return made.select(F.col("doc_id").alias("conv_id"), "identical", "compared", F.round("worst_offset", 6).alias("worst_offset"), "summary")


@query("""
with b as (select distinct conv_id, conv_id % 8 as fault from conversations)
select conv_id, 1::bigint as lesson, null as section, null::int as idx, 'Lessons' as sheet, 5 as row from b union all
select conv_id, case when fault <> 4 then 1 end, 'readingComprehension', 0, 'Comprehension', 5 from b union all
select conv_id, case when fault = 5 then 9 else 1 end, 'criticalThinkingAndAnalysis', 0, 'Analysis', 5 from b union all
select conv_id, 1, 'paragraphWriting', 0, 'Writing', 5 from b union all
select conv_id, 1, 'vocabulary', 0, 'Vocabulary', 5 from b where fault <> 2
""")
def a_lineage(t):
    """Which sheet and row each imported lesson and item came from."""
    made = assembly.lineage(contract.parse(_cells(t))[0])
    return made.select(F.col("workbook_id").cast("long").alias("conv_id"), F.col("lesson_number").alias("lesson"), "section", "idx", "sheet", F.col("row").cast("int").alias("row"))


@query("""
select distinct conv_id, '"Lessons" must contain at least one lesson.' as message from conversations where conv_id % 3 = 0
""")
def c_no_lessons(t):
    """Imports whose Lessons tab has lost its rows."""
    book = F.col("workbook_id").cast("long")
    bad = contract.parse(_cells(t).where((F.col("sheet") != "Lessons") | (F.col("row") < contract.FIRST_DATA_ROW) | (book % 3 != 0)))[1]
    return bad.where("rule = 'no_lessons'").select(F.col("subject").cast("long").alias("conv_id"), "message")


@query("""
with r as (select conv_id, turn, turn // 2 as lesson, 'lessons/part-' || turn || '.json' as file from conversations),
e as (select conv_id, lesson, min(turn) as first from r group by 1, 2)
select conv_id, r.file as path, r.file || ': has Lesson ' || lesson || ', as lessons/part-' || first || '.json has' as message from r join e using (conv_id, lesson) where turn > first
""")
def c_repeated_across_files(t):
    """Lessons that two files of one package claim, both named."""
    rows = t("conversations").select(F.col("conv_id").alias("workbook_id"), F.col("turn").alias("position"), F.concat(F.lit("lessons/part-"), F.col("turn").cast("string"), F.lit(".json")).alias("file"), F.floor(F.col("turn") / 2).alias("lesson_number"))
    return packages.repeated_lessons(rows).select(F.col("subject").cast("long").alias("conv_id"), "path", "message")


@query("""
with f as (select conv_id, string_agg('lessons/lesson-' || lpad((turn + 1)::varchar, greatest(2, length((turn + 1)::varchar))::int, '0') || '.json', ',' order by turn) as files from conversations group by 1)
select conv_id, case conv_id % 3 when 0 then 'kept-' || conv_id when 1 then 'Kept ' || conv_id else 'book-' || conv_id end as id, conv_id % 3 = 1 as bad, files from f
""")
def a_reused_ids(t):
    """Re-imported books keep the ids by which they are known, good or bad; new ones are named by title."""
    lessons = t("conversations").select(F.col("conv_id").alias("workbook_id"), F.col("turn").alias("position"), (F.col("turn") + 1).alias("lesson_number"))
    books = lessons.select("workbook_id").distinct()
    known = F.when(F.col("workbook_id") % 3 == 0, F.concat(F.lit("kept-"), F.col("workbook_id").cast("string"))).otherwise(F.concat(F.lit("Kept "), F.col("workbook_id").cast("string")))
    ids = books.where("workbook_id % 3 < 2").select("workbook_id", known.alias("id"))
    empty = [F.lit(None).cast("string").alias(c) for c in ("author", "series_title", "lesson_range", "cover_subtitle")]
    made = assembly.manifests(books.select("workbook_id", F.concat(F.lit("Book "), F.col("workbook_id").cast("string")).alias("book_title"), *empty), lessons, ids)
    return made.select(F.col("workbook_id").alias("conv_id"), "id", assembly.bad_id(F.col("id")).alias("bad"), F.array_join("lesson_files", ",").alias("files"))


@query("""
select conv_id, turn, case role when 'user' then 'short-answer' when 'assistant' then 'full-page' end as mode,
  case when role = 'assistant' and turn % 3 = 0 then case when turn % 2 = 1 then 'own,' else '' end || 'h' || turn when turn % 2 = 1 then 'own' end as guidance from conversations
""")
def r_normalised_items(t):
    """Defaults filled in and old hints folded into the guidance of writing prompts alone."""
    section = F.when(F.col("role") == "user", "readingComprehension").when(F.col("role") == "assistant", "paragraphWriting").otherwise("vocabulary")
    turn = F.col("turn")
    items = t("conversations").select(
        "conv_id", "turn", section.alias("section"), F.lit(None).cast("struct<mode:string,lines:bigint,pages:bigint>").alias("response_space"),
        F.when(turn % 2 == 1, F.array(F.lit("own"))).alias("guidance"), F.when(turn % 3 == 0, F.array(F.concat(F.lit("h"), turn.cast("string")))).alias("hints"),
    )
    return rules.normalised_items(items).select("conv_id", "turn", F.col("response_space.mode").alias("mode"), F.array_join("guidance", ",").alias("guidance"))


@query("select doc_id, case when doc_id % 2 = 0 then source else 'The Series' end as series_title from documents")
def r_series_titles(t):
    books = t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("series_title"))
    return rules.normalised_manifests(books, "The Series")


@query("""
select doc_id, '/manifest/book_title' as path, case when doc_id % 5 = 0 then '/manifest/book_title: must have required property' else '/manifest/book_title: must contain a character that is not blank' end as message from documents where doc_id % 5 < 2 union all
select doc_id, '/manifest/lesson_range', '/manifest/lesson_range: must have required property' from documents where doc_id % 7 = 0
""")
def r_schema_paths(t):
    """Required and blank fields, each named by its parent's path and its own name."""
    book = F.when(F.col("doc_id") % 5 == 1, "  ").when(F.col("doc_id") % 5 > 1, "Title")
    rows = t("documents").select("doc_id", book.alias("book_title"), F.lit("A. Writer").alias("author"), F.when(F.col("doc_id") % 7 != 0, "1").alias("lesson_range"))
    return rules.schema_violations(rows, "manifest", "doc_id", F.lit("/manifest"), [F.lit(0)]).select(F.col("subject").cast("long").alias("doc_id"), "path", "message")


@query("""
select item_id, case when item_id % 2 = 0 and item_id % 3 <> 0 then item_id end as panel_comment, case when item_id % 3 <> 0 then 'comment' when item_id % 5 = 0 then 'italic' else 'text' end as kind from benchmark
""")
def e_panels(t):
    """After which segment each chosen comment's panel stands; comments not chosen have none."""
    rows = t("benchmark").select("item_id", "text", F.floor(F.col("item_id") / 12).alias("essay_id"))
    segments = rows.select("item_id", "essay_id", F.col("item_id").alias("comment_id"), "text", (F.col("item_id") % 5 == 0).alias("italic"), F.when(F.col("item_id") % 2 == 0, F.col("item_id")).alias("comment_after"))
    chosen = rows.where("item_id % 3 <> 0").select("essay_id", F.col("item_id").alias("comment_id"), F.lit("01").alias("number"), F.lit("note").alias("text"))
    return essays.annotated(segments, chosen).select("item_id", "panel_comment", "kind")


@query("""
with p as (select doc_id, 'doc-' || doc_id as path from documents)
select path, 'missing' as problem from p where doc_id % 3 <> 0 and doc_id % 4 = 0 union all
select path, 'unexpected' from p where doc_id % 3 = 0 and doc_id % 4 <> 0 union all
select path, 'repeated' from p where doc_id % 5 = 0 and doc_id % 4 <> 0
""")
def b_list_differences(t):
    """Files of a list against those that are there, some twice."""
    names = t("documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"))
    present = names.where("doc_id % 4 <> 0")
    return inventory.list_differences(names.where("doc_id % 3 <> 0"), present.unionByName(present.where("doc_id % 5 = 0")))


@query("select doc_id::varchar as id, 'Doc ' || doc_id as title, case when doc_id % 2 = 0 then '2024-05-01 10:00' end as posted_at, case when doc_id % 3 = 0 then '/a/' || doc_id || '.png,/b.png' else '' end as images, md5(coalesce(text, '')) as body_md5 from documents")
def s_notice_files(t):
    """Front matter and body of the documents written as notices."""
    ident = F.col("doc_id").cast("string")
    front = F.concat(
        F.lit('---\ntitle: "Doc '), ident, F.lit('"\n'), F.when(F.col("doc_id") % 2 == 0, "postedAt: 2024-05-01 10:00\n").otherwise("draft: true\n"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("images:\n  - '/a/"), ident, F.lit(".png'\n  - /b.png\n"))).otherwise(F.lit("")), F.lit("---\n"),
    )
    made = packages.notices_of(t("documents").select(ident.alias("id"), F.concat(front, F.coalesce("text", F.lit(""))).alias("value")))
    return made.select("id", "title", "posted_at", F.array_join("images", ",").alias("images"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("""
select doc_id, text is null or not regexp_matches(text, '\\S') as blank, md5(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]+', '', 'g')) as canonical_md5,
  printf('%.2f MB', n_chars * 1000 / 1048576.0) as size, case when doc_id % 3 = 0 then 'fonts' when doc_id % 3 = 1 then 'compiler' else 'preview page' end as area from documents
""")
def u_sql_functions(t):
    """The scalar functions called by their SQL names."""
    docs = t("documents")
    text.register(docs.sparkSession)
    path = "case doc_id % 3 when 0 then 'project/assets/fonts/a' when 1 then 'vendor/b' else 'index' end"
    return docs.selectExpr("doc_id", "is_blank_text(text) as blank", "md5(canonical_text(text)) as canonical_md5", "megabytes_text(n_chars * 1000) as size", f"area_of_path({path}) as area")


@query("""
with g as (select doc_id, list_filter(string_split_regex(text, '\\r?\\n'), lambda x: regexp_matches(x, '[^\\t\\n\\x0B\\f\\r \\x{A0}\\x{3000}]')) as items from documents)
select doc_id, len(items)::bigint as items, md5(array_to_string(items, '|')) as joined_md5 from g where len(items) > 0
""")
def u_guidance_function(t):
    """The lines of each text that aren't blank, by the SQL function."""
    docs = t("documents")
    text.register(docs.sparkSession)
    return docs.selectExpr("doc_id", "guidance_items(text) as g").where("g is not null").selectExpr("doc_id", "cast(size(g) as bigint) as items", "md5(array_join(g, '|')) as joined_md5")


@query("""
select conv_id, turn, (length(text) - length(replace(text, chr(10), '')))::bigint as rules from conversations where role = 'user' and text is not null
""")
def q_section_rules(t):
    """Rules on each page of the first section: user turns are its pages, and each line break draws one."""
    rows = t("conversations").where("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role", "text")
    rules = rows.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("idx", "line")).where("idx > 0")
    texts = rows.select("doc_id", "page", F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" of 9")).alias("text"), F.when(F.col("role") == "user", "STEP1READ").otherwise("").alias("canonical"), F.lit("").alias("header_canonical"))
    found = audit.rules_of_section(rules, texts, 1)
    return found.select(F.col("doc_id").alias("conv_id"), F.col("page").alias("turn"), F.col("rules").cast("long").alias("rules"))


@query("""
with e as (select unnest(['student', 'teacher']) as edition),
n as (select conv_id, turn + 1 as l, turn + 1 + case when length(text) % 3 = 0 then 100 else 0 end as r from conversations where text is not null),
d as (select conv_id, l as number, 'left' as side from n where l <> r union all select conv_id, r, 'right' from n where l <> r)
select conv_id || '-lesson-' || lpad(number::varchar, greatest(2, length(number::varchar))::int, '0') || '-' || edition || '.pdf' as name, side from d cross join e
""")
def t_planted_names(t):
    """Two plans of each conversation's files, one of which numbers some lessons otherwise."""
    rows = t("conversations").where("text is not null").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("position"), (F.col("turn") + 1).alias("lesson_number"), F.length("text").alias("n"))
    books = rows.select("book_id").distinct()
    other = rows.withColumn("lesson_number", F.col("lesson_number") + F.when(F.col("n") % 3 == 0, 100).otherwise(0))
    return targets.name_differences(targets.disk_targets(books, rows), targets.preview_targets(books, other)).select("name", "side")


@query("""
with b as (select conv_id::varchar as book, list(turn + 1) as n from conversations group by 1), e as (select unnest(['student', 'teacher']) as edition)
select book, 'workbook' as scope, edition, null::bigint as lesson_number, book || '-workbook-' || edition || '.pdf' as name from b cross join e union all
select book, 'lesson', edition, k, book || '-lesson-' || lpad(k::varchar, greatest(2, length(k::varchar))::int, '0') || '-' || edition || '.pdf' from (select book, unnest(n) as k from b) cross join e
""")
def u_expand_targets(t):
    """The table function over each conversation's turns as lessons."""
    rows = t("conversations")
    targets.register(rows.sparkSession)
    books = rows.groupBy(F.col("conv_id").cast("string").alias("book")).agg(F.collect_list(F.col("turn") + 1).alias("n"))
    return rows.sparkSession.sql("select b.book, t.scope, t.edition, t.lesson_number, t.name from {books} b, lateral expand_targets(b.book, b.n) t", books=books)


def _turns(t) -> tuple[DataFrame, DataFrame]:
    """Conversations as books, their turns as lessons."""
    lessons = t("conversations").select(F.col("conv_id").cast("string").alias("book_id"), F.col("turn").alias("position"), (F.col("turn") + 1).alias("lesson_number"), "role")
    return lessons.select("book_id").distinct().withColumn("title", F.concat(F.lit("Book "), "book_id")), lessons


@query("""
with l as (select conv_id::varchar as book, turn, turn + 1 as n, '{"number":' || (turn + 1) || case when role = 'user' then ',"note":"user"}' else '}' end as body from conversations),
s as (select book, 'lesson' as scope, '-lesson-' || lpad(n::varchar, greatest(2, length(n::varchar))::int, '0') as part, body from l union all select book, 'workbook', '-workbook', string_agg(body, ',' order by turn) from l group by 1)
select book || part || '-' || edition || '.pdf' as name,
  md5('{"schemaVersion":1,"build":{"scope":"' || scope || '","edition":"' || edition || '"},"manifest":{"title":"Book ' || book || '"' || case when book::bigint % 2 = 1 then ',"subtitle":"Odd"' else '' end || '},"lessons":[' || body || ']}') as bundle_md5
from s cross join (select unnest(['student', 'teacher']) as edition)
""")
def s_target_bundles(t):
    """Bundles of all targets, single lessons too; fields that are null are left out."""
    books, lessons = _turns(t)
    subtitle = F.when(F.col("book_id").cast("long") % 2 == 1, "Odd").alias("subtitle")
    lesson = F.struct(F.col("lesson_number").alias("number"), F.when(F.col("role") == "user", "user").alias("note")).alias("lesson")
    made = packages.bundles(targets.disk_targets(books, lessons), books.select("book_id", F.struct("title", subtitle).alias("manifest")), lessons.select("book_id", "lesson_number", lesson))
    return made.select("name", F.md5(F.col("bundle").cast("binary")).alias("bundle_md5"))


@query("select conv_id::varchar as book_id, case when count(*) < 6 then 'Lessons 1–6' else 'All of ' || conv_id end as lesson_range from conversations group by conv_id")
def t_cover_ranges(t):
    """Cover lines of books lengthened to six lessons."""
    books, lessons = _turns(t)
    return targets.cover_ranges(books.select("book_id", F.concat(F.lit("All of "), "book_id").alias("lesson_range")), lessons, 6)


@query("select conv_id from conversations group by 1 having count(*) filter (where turn = 3) = 0")
def x_nothing_delivered(t):
    """Books none of whose files is a PDF."""
    name = F.concat(F.lit("file-"), F.col("turn").cast("string"), F.when(F.col("turn") == 3, ".Pdf").otherwise(".pdf.txt"))
    return archives.without_pdfs(t("conversations").select("conv_id", name.alias("name")), ["conv_id"])


@query("""
with l as (select doc_id, '/guidance/1' as path, 70 + doc_id % 20 as n from documents union all select doc_id, '/deep/b/0/c', 60 + doc_id % 30 from documents)
select doc_id, path, path || ': contains an unbroken text segment of ' || n || ' characters; the maximum is 80' as message from l where n > 80
""")
def r_unbroken_leaves(t):
    """Over-long runs in every text of nested documents, those in arrays too."""
    run = lambda letter, n: F.repeat(F.lit(letter), n.cast("int"))
    ident = F.col("doc_id")
    nested = F.struct(F.col("source").alias("a"), F.array(F.col("lang"), run("x", 70 + ident % 20)).alias("guidance"), F.struct(F.array(F.struct(run("y", 60 + ident % 30).alias("c"))).alias("b")).alias("deep"))
    docs = t("documents").select("doc_id", F.parse_json(F.to_json(nested)).alias("doc"))
    return schema.unbroken_leaves(docs, "doc_id", "doc", [F.lit(0)]).select(F.col("subject").cast("long").alias("doc_id"), "path", "message")
