"""Queries of packages, bundles, verdicts and boards that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import has_warning
from tessera.operators import archives, assembly, audit, contract, essays, notices, parity
from tessera.plans import segments, targets
from tessera.queries.base import query
from tessera.queries.structure import _LESSONS, _books
from tessera.sources import packages


@query("select conv_id, turn, role as sheet from conversations where role in ('system', 'assistant')")
def s_select_tabs(t):
    cells = t("conversations").select("conv_id", "turn", F.col("role").alias("sheet"))
    return contract.select_tabs(cells, ["system", "assistant"])


@query(f"""
with {_LESSONS}, w as (select book_id, string_agg('{{"number":' || number || ',"name":"' || n_name || '"}}', ',' order by position) as body from lessons group by 1),
m as (select 'book-' || r_regionkey as book_id, r_name from region)
select w.book_id || '-workbook-' || edition || '.pdf' as name, md5('{{"schemaVersion":1,"build":{{"scope":"workbook","edition":"' || edition || '"}},"manifest":{{"title":"' || r_name || '"}},"lessons":[' || body || ']}}') as bundle_md5
from w join m using (book_id) cross join (select unnest(['student', 'teacher']) as edition)
""")
def s_bundles(t):
    books, lessons = _books(t)
    whole = targets.disk_targets(books, lessons).where("scope = 'workbook'")
    made = packages.bundles(whole, books.select("book_id", F.struct("title").alias("manifest")), lessons.select("book_id", "lesson_number", F.struct(F.col("lesson_number").alias("number"), F.col("n_name").alias("name")).alias("lesson")))
    return made.select("name", F.md5(F.col("bundle").cast("binary")).alias("bundle_md5"))


@query(f"""
with {_LESSONS}, s as (select book_id, 'lesson' as scope, position, number from lessons union all select 'book-' || r_regionkey, 'workbook', 0, null from region),
e as (select *, case edition when 'student' then 0 else 1 end as edition_no from s cross join (select unnest(['student', 'teacher']) as edition)),
f as (select book_id, string_agg(case when scope = 'lesson' then book_id || '-lesson-' || lpad(number::varchar, greatest(2, length(number::varchar))::int, '0') || '-' || edition || '.pdf' else book_id || '-workbook-' || edition || '.pdf' end, ', ' order by edition_no, scope desc, position) as files from e group by 1),
n as (select book_id, count(*) as lessons from lessons group by 1)
select f.book_id, r_name as title, lessons::bigint as lessons, lessons || case when lessons = 1 then ' lesson' else ' lessons' end as lessons_text, files from f join n using (book_id) join region on 'book-' || r_regionkey = f.book_id
""")
def s_build_summary(t):
    books, lessons = _books(t)
    return packages.build_summary(targets.disk_targets(books, lessons), books).withColumn("lessons", F.col("lessons").cast("long"))


@query(f"with {_LESSONS} select book_id, string_agg('lessons/lesson-' || lpad(number::varchar, greatest(2, length(number::varchar))::int, '0') || '.json', ',' order by position) as files, 'book-of-' || lower(replace(r_name, ' ', '-')) as id from lessons join region on 'book-' || r_regionkey = book_id group by 1, 3")
def a_manifests(t):
    books, lessons = _books(t)
    text = lambda c: F.lit(None).cast("string").alias(c)
    metadata = books.select(F.col("book_id").alias("workbook_id"), F.concat(F.lit("Book of "), "title").alias("book_title"), *[text(c) for c in ("author", "series_title", "lesson_range", "cover_subtitle")])
    made = assembly.manifests(metadata, lessons.withColumnRenamed("book_id", "workbook_id"))
    return made.select(F.col("workbook_id").alias("book_id"), F.array_join("lesson_files", ",").alias("files"), "id")


@query("""
with f as (select conv_id, list(case when turn % 5 = 4 then 'Lessons/' || turn else 'lessons/' || (turn % 6) || '.json' end) as files from conversations group by 1)
select conv_id, case when len(list_distinct(files)) < len(files) then 'must not repeat a file' when len(list_filter(files, lambda x: not regexp_full_match(x, 'lessons/[a-z0-9][a-z0-9._-]*\\.json'))) > 0 then 'must name lesson files' else 'fine' end as problem from f
""")
def c_file_lists(t):
    name = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("Lessons/"), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("lessons/"), (F.col("turn") % 6).cast("string"), F.lit(".json")))
    lists = t("conversations").groupBy("conv_id").agg(F.collect_list(name).alias("files"))
    return lists.select("conv_id", F.coalesce(contract.file_list_problem(F.col("files")), F.lit("fine")).alias("problem"))


@query("select n_nationkey::bigint as n_nationkey, case when n_regionkey % 2 = 0 then case when n_regionkey = 0 then 'Teacher guide' else n_name || ' · Teacher guide' end else n_name end as label, (n_nationkey * 10 // 7)::bigint as fill_rows from nation")
def l_footer_labels(t):
    teacher = F.when(F.col("n_regionkey") % 2 == 0, "teacher").otherwise("student")
    return t("nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), segments.footer_label(teacher, F.when(F.col("n_regionkey") != 0, F.col("n_name"))).alias("label"), segments.fill_rows(F.col("n_nationkey") * 10).cast("long").alias("fill_rows"))


@query("select conv_id as doc_id, 4::bigint as pages, count(*)::bigint as found from conversations group by 1 having count(*) <> 4")
def q_page_counts(t):
    rows = t("conversations").withColumnRenamed("conv_id", "doc_id")
    expected = rows.select("doc_id").distinct().withColumn("pages", F.lit(4).cast("long"))
    return audit.unexpected_page_counts(rows, expected).select("doc_id", "pages", "found")


@query("select source as doc_id, sum(len(regexp_extract_all(text, '(?i)continued')))::bigint as labels from documents group by 1")
def q_continuation_labels(t):
    return audit.continuation_labels(t("documents").select(F.col("source").alias("doc_id"), "text"))


@query("select user_id, count(*) filter (where event_type = 'error')::bigint as warned, count(*)::bigint as logs from events group by 1")
def q_warnings(t):
    log = F.concat(F.lit("compiled\n"), F.when(F.col("event_type") == "error", "Warning: font").otherwise("no warning: font"))
    return t("events").groupBy("user_id").agg(F.count_if(has_warning(log)).alias("warned"), F.count("*").alias("logs"))


@query("select d.doc_id, d.lang <> 'fr' and d.n_chars > 100 and coalesce(l.quality = 1, true) as verdict from documents d left join labels l using (doc_id)")
def v_verdicts(t):
    joined = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.select("doc_id", parity.verdict(F.col("lang") != "fr", F.col("n_chars") > 100, F.col("quality") == 1).alias("verdict"))


@query("select l.vec_id, l.label::bigint as l_label, r.label::bigint as r_label from embeddings l join embeddings r on r.vec_id = l.vec_id + 1 where l.label <> r.label")
def v_size_differences(t):
    one = lambda shift: t("embeddings").select((F.col("vec_id") - shift).alias("doc_id"), F.lit(1).alias("page"), F.col("label").cast("double").alias("width"), F.lit(1.0).alias("height"))
    return parity.size_differences(one(0), one(1)).select(F.col("doc_id").alias("vec_id"), F.col("l_width").cast("long").alias("l_label"), F.col("r_width").cast("long").alias("r_label"))


@query("""
with u as (select conv_id, row_number() over (partition by conv_id order by turn) as pos, text from conversations where role = 'user'), a as (select conv_id, row_number() over (partition by conv_id order by turn) as pos, text from conversations where role = 'assistant'),
d as (select u.conv_id, count(*) filter (where u.text <> a.text) as n, arg_min('run ' || u.pos, u.pos) filter (where u.text <> a.text) as first, count(*) as compared from u join a using (conv_id, pos) group by 1)
select c.conv_id, coalesce(n, 0) = 0 as identical, coalesce(n, 0)::bigint as differences, coalesce(compared, 0)::bigint as compared, case when n > 1 then first || ' (and ' || (n - 1) || ' more)' else first end as summary from (select distinct conv_id from conversations) c left join d using (conv_id)
""")
def v_parity_summary(t):
    own = Window.partitionBy("doc_id").orderBy("turn")
    one = lambda role: t("conversations").withColumnRenamed("conv_id", "doc_id").where(F.col("role") == role).withColumn("pos", F.row_number().over(own)).select("doc_id", "pos", F.col("text").alias("str"), F.lit(0.0).alias("x"))
    rows = parity.compared(one("user"), one("assistant"), ["doc_id", "pos"], "str", ["x"])
    bad = rows.where("kind is not null").select("doc_id", F.array(F.col("pos").cast("long")).alias("rank"), F.concat(F.lit("run "), F.col("pos").cast("string")).alias("message"))
    made = parity.summary(bad, rows.select("doc_id", "offset"), t("conversations").select(F.col("conv_id").alias("doc_id")).distinct())
    return made.select(F.col("doc_id").alias("conv_id"), "identical", "differences", "compared", "summary")


@query("select page_id, 'Notice ' || page_id as title, 0::bigint as images from pages where page_id % 3 <> 0 and page_id % 7 <> 0")
def n_valid(t):
    title = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("Notice "), F.col("page_id").cast("string"))).otherwise("  ")
    rows = t("pages").select("page_id", title.alias("title"), F.when(F.col("page_id") % 7 != 0, "2024-05-01 10:00:00").otherwise("soon").alias("posted_at"), F.lit(None).cast("array<string>").alias("images"))
    return notices.valid(rows).select("page_id", "title", F.size("images").cast("long").alias("images"))


@query("select page_id, url, case when page_id % 2 = 0 then url end as lead_image from pages where url = (select min(url) from pages)")
def n_detail(t):
    rows = t("pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, F.array("url")).otherwise(F.array().cast("array<string>")).alias("images"))
    rows = rows.join(F.broadcast(rows.agg(F.min("url").alias("asked"))))  # one row
    return notices.detail(rows, F.col("asked"), "url").select("page_id", "url", "lead_image")


@query("with c as (select item_id, row_number() over (partition by item_id // 12 order by item_id desc) as n from benchmark) select c.item_id as comment_id, case when n < 10 then '0' || n else n::varchar end as number, b.text from c join benchmark b using (item_id)")
def e_selected(t):
    """Essays of twelve comments each, all chosen, last ones first."""
    comments = t("benchmark").select(F.col("item_id").alias("comment_id"), "text")
    chosen = comments.select(F.floor(F.col("comment_id") / 12).alias("essay_id"), "comment_id")
    chosen = chosen.withColumn("position", F.row_number().over(Window.partitionBy("essay_id").orderBy(F.col("comment_id").desc())) - 1)
    return essays.selected(chosen, comments).select("comment_id", "number", "text")


@query("select doc_id, 'doc-' || doc_id || case when doc_id % 2 = 0 then '.PDF' else '.pdf' end as name from documents where doc_id % 3 <> 0")
def x_pdf_names(t):
    ending = F.when(F.col("doc_id") % 3 == 0, ".txt").when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".pdf")
    return archives.pdf_names(t("documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), ending).alias("name")))


@query("select doc_id, n_chars % 4 <= 1 or greatest(262144, (n_chars * 1000) // (1 << (doc_id % 8)::int)) <= 262144 as gives_up from documents")
def x_gives_up(t):
    budget = archives.laddered_budget(F.col("n_chars") * 1000, F.col("doc_id") % 8)
    return t("documents").select("doc_id", archives.gives_up(F.col("n_chars") % 4, budget).alias("gives_up"))
