"""Queries of constraints, assembly, targets, segments, audits and parity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import assembly, audit, contract, parity
from tessera.plans import segments, targets
from tessera.queries.base import query


@query("select conv_id, n::bigint as n from (select c.conv_id, count(*) filter (where role = 'system') as n from conversations c group by 1) where n <> 1")
def c_exactly_one(t):
    rows = t("conversations")
    return contract.not_exactly_one(rows, "conv_id", rows.where("role = 'system'")).select("conv_id", F.col("n").cast("long").alias("n"))


@query("""
with k as (select l_orderkey, l_linenumber, count(*) as n, min(l_partkey) as first_part from lineitem group by 1, 2 having count(*) > 1)
select l.l_orderkey, l.l_linenumber, count(*)::bigint as later, min(k.first_part) as first_part from lineitem l join k using (l_orderkey, l_linenumber) where l.l_partkey > k.first_part group by 1, 2
""")
def c_duplicate_keys(t):
    keys = ["l_orderkey", "l_linenumber"]
    found = contract.duplicates(t("lineitem").select(*keys, "l_partkey"), keys, ["l_partkey"])
    return found.groupBy(*keys).agg(F.count("*").alias("later"), F.min("earlier.l_partkey").alias("first_part"))


@query("select l_orderkey as o_orderkey, count(*)::bigint as lines from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and o.o_orderstatus = 'F') group by 1")
def c_unknown_parent(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return contract.orphans(lines, t("orders").where("o_orderstatus = 'F'"), ["o_orderkey"]).groupBy("o_orderkey").agg(F.count("*").alias("lines"))


@query("select p.conv_id, r.role from (select distinct conv_id from conversations) p cross join (select unnest(['system', 'user', 'assistant']) as role) r where not exists (select 1 from conversations c where c.conv_id = p.conv_id and c.role = r.role)")
def c_section_coverage(t):
    rows = t("conversations")
    roles = rows.sparkSession.createDataFrame([("system",), ("user",), ("assistant",)], "role string")
    return contract.uncovered(rows, ["conv_id"], roles, rows)


@query("select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def c_missing_files(t):
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("""
with recursive p as (select page_id, string_split((case page_id % 5 when 0 then '../' when 1 then 'a/../../' when 2 then './b/../' else '' end) || regexp_replace(url, '^https?://', ''), '/') as parts from pages),
w as (select page_id, 0 as i, 0 as now, 0 as low, parts from p union all
  select page_id, i + 1, now + case when parts[i + 1] = '..' then -1 when parts[i + 1] in ('', '.') then 0 else 1 end,
    least(low, now + case when parts[i + 1] = '..' then -1 when parts[i + 1] in ('', '.') then 0 else 1 end), parts from w where i < len(parts))
select page_id, min(low) < 0 as leaves from w group by 1
""")
def c_path_escape(t):
    lead = F.when(F.col("page_id") % 5 == 0, "../").when(F.col("page_id") % 5 == 1, "a/../../").when(F.col("page_id") % 5 == 2, "./b/../").otherwise("")
    path = F.concat(lead, F.regexp_replace("url", "^https?://", ""))
    return t("pages").select("page_id", contract.leaves_directory(path).alias("leaves"))


@query("select conv_id, role as section, count(*)::bigint as items, string_agg(turn::varchar, ',' order by turn) as turns, md5(string_agg(text, '|' order by turn)) as text_md5 from conversations group by 1, 2")
def a_ordered_sections(t):
    made = assembly.ordered_section(t("conversations"), ["conv_id", "role"], ["turn", "text"], ["turn"])
    return made.select("conv_id", F.col("role").alias("section"), F.size("items").cast("long").alias("items"), F.array_join(F.transform("items", lambda x: x["turn"].cast("string")), ",").alias("turns"), F.md5(F.array_join(F.transform("items", lambda x: x["text"]), "|").cast("binary")).alias("text_md5"))


@query("""
with i as (select conv_id, role, turn, row_number() over (partition by conv_id, role order by turn) - 1 as idx from conversations),
v as (select distinct conv_id, idx from i where idx % 2 = 1)
select v.conv_id, '/sections/user/' || v.idx as path, coalesce(i.role, 'lesson') as sheet, coalesce(i.turn, 0)::bigint as row
from v left join i on i.conv_id = v.conv_id and i.idx = v.idx and i.role = 'user'
""")
def a_locate_cells(t):
    own = Window.partitionBy("conv_id", "role").orderBy("turn")
    items = t("conversations").select(F.lit("b").alias("workbook_id"), F.col("conv_id").alias("lesson_number"), F.col("role").alias("section"), (F.row_number().over(own) - 1).alias("idx"), F.col("role").alias("sheet"), F.col("turn").alias("row"))
    lessons = items.select("workbook_id", "lesson_number").distinct().select("*", F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("idx"), F.lit("lesson").alias("sheet"), F.lit(0).cast("long").alias("row"))
    violations = items.where("idx % 2 = 1").select("workbook_id", "lesson_number", F.concat(F.lit("/sections/user/"), F.col("idx").cast("string")).alias("path")).distinct()
    return assembly.locate(violations, lessons.unionByName(items)).select(F.col("lesson_number").alias("conv_id"), "path", "sheet", "row")


def _books(t):
    """Regions as books, their nations as lessons numbered in order of key."""
    own = Window.partitionBy("book_id").orderBy("n_nationkey")
    lessons = t("nation").withColumn("book_id", F.concat(F.lit("book-"), F.col("n_regionkey").cast("string"))).withColumn("position", F.row_number().over(own) - 1)
    lessons = lessons.select("book_id", "position", (F.col("position") * 7 + 3).alias("lesson_number"), "n_name")
    return t("region").select(F.concat(F.lit("book-"), F.col("r_regionkey").cast("string")).alias("book_id"), F.col("r_name").alias("title")), lessons


_LESSONS = "lessons as (select 'book-' || n_regionkey as book_id, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as position, (row_number() over (partition by n_regionkey order by n_nationkey) - 1) * 7 + 3 as number, n_name from nation)"
_NAME = "case when scope = 'lesson' then book_id || '-lesson-' || lpad(number::varchar, greatest(2, length(number::varchar))::int, '0') || '-' || edition || '.pdf' else book_id || '-workbook-' || edition || '.pdf' end"


@query(f"""
with {_LESSONS}, s as (select book_id, 'lesson' as scope, position, number from lessons union all select 'book-' || r_regionkey, 'workbook', 0, null from region),
e as (select *, case edition when 'student' then 0 else 1 end as edition_no from s cross join (select unnest(['student', 'teacher']) as edition))
select book_id, scope, edition, {_NAME} as name, case when scope = 'lesson' then 'Lesson ' || number else 'Complete workbook' end || ' · ' || edition as label,
  row_number() over (partition by book_id order by edition_no, scope desc, position)::bigint as seq from e
""")
def t_disk_targets(t):
    made = targets.disk_targets(*_books(t))
    return made.select("book_id", "scope", "edition", "name", "label", F.row_number().over(Window.partitionBy("book_id").orderBy("seq")).cast("long").alias("seq"))


@query(f"""
with {_LESSONS}, s as (select book_id, 'lesson' as scope, position, number from lessons union all select 'book-' || r_regionkey, 'workbook', 0, null from region),
e as (select *, case edition when 'student' then 0 else 1 end as edition_no from s cross join (select unnest(['student', 'teacher']) as edition))
select book_id, {_NAME} as name, row_number() over (partition by book_id order by scope, position, edition_no)::bigint as seq from e
""")
def t_preview_targets(t):
    made = targets.preview_targets(*_books(t))
    return made.select("book_id", "name", F.row_number().over(Window.partitionBy("book_id").orderBy("seq")).cast("long").alias("seq"))


@query("select 0::bigint as differences")
def t_name_parity(t):
    """Both planners name the same files: a single count over their differences."""
    books, lessons = _books(t)
    return targets.name_differences(targets.disk_targets(books, lessons), targets.preview_targets(books, lessons)).agg(F.count("*").alias("differences"))


@query(f"""
with {_LESSONS}, w as (select book_id, string_agg(n_name, ',' order by position) as lessons, count(*)::bigint as n from lessons group by 1)
select w.book_id || '-workbook-' || edition || '.pdf' as name, n, lessons from w cross join (select unnest(['student', 'teacher']) as edition)
""")
def t_target_lessons(t):
    books, lessons = _books(t)
    whole = targets.disk_targets(books, lessons).where("scope = 'workbook'")
    rows = targets.target_lessons(whole, lessons)
    return audit.joined_text(rows, ["name"], "n_name", "at", ",").join(rows.groupBy("name").agg(F.count("*").alias("n")), "name").select("name", "n", F.col("text").alias("lessons"))


@query(f"""
with {_LESSONS}, c as (select book_id, count(*) as have from lessons group by 1)
select l.book_id, g.i::bigint as lesson_number, l.position::bigint as source_position, l.n_name from c, generate_series(1, 12) g(i), lessons l where l.book_id = c.book_id and l.position = (g.i - 1) % c.have
""")
def t_cyclic_extend(t):
    return targets.extended(_books(t)[1], 12).select("book_id", "lesson_number", F.col("source_position").cast("long").alias("source_position"), "n_name")


@query(f"""
with {_LESSONS}, c as (select book_id, arg_min(number, position) as first, greatest(count(*), 12) as whole from lessons group by 1)
select book_id, 'lesson-' || edition as id, 'Standalone lesson ' || first || ' · ' || edition as label, 1::bigint as lesson_count from c cross join (select unnest(['student', 'teacher']) as edition)
union all select book_id, 'workbook-' || edition, 'Complete workbook (' || whole || ' lessons) · ' || edition, whole::bigint from c cross join (select unnest(['student', 'teacher']) as edition)
""")
def t_fixture_plan(t):
    return targets.fixture_plan(_books(t)[1], 12).select("book_id", "id", "label", "lesson_count")


@query("""
select c.conv_id, c.turn, e.edition, case when edition = 'student' then null when role = 'assistant' then 'guided' when turn % 4 = 0 then null else case when role = 'system' then null else 'No additional guidance was provided for this prompt.' end end as teacher_guidance,
  case when edition = 'teacher' then case when role = 'system' or turn % 4 = 0 then 'rubric' end end as rubric, case when edition = 'student' then role end as response_space
from conversations c cross join (select unnest(['student', 'teacher']) as edition) e
""")
def t_redaction(t):
    items = t("conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "guided").alias("teacher_guidance"), F.when((F.col("role") == "system") | (F.col("turn") % 4 == 0), "rubric").alias("rubric"), F.col("role").alias("response_space"))
    return targets.redacted(targets.edition_rows(items, targets.EDITIONS)).drop("edition_no")


@query("""
with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint as lines from lineitem),
p as (select *, unnest(generate_series(0, case when lines > 14 then ceil((lines - 14) / 35.0)::int else 0 end)) as part from l)
select part::bigint as part, count(*)::bigint as segments, sum(case when part = 0 then least(lines, 14) else least(lines - 14 - (part - 1) * 35, 35) end)::bigint as lines from p group by 1
""")
def l_response_segments(t):
    items = t("lineitem").select(F.lit("custom-lines").alias("mode"), F.col("l_quantity").cast("long").alias("lines"), F.lit(None).cast("long").alias("pages"))
    return segments.segments(items).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("segments"), F.sum("part_lines").alias("lines"))


@query("select part::bigint as part, count(*)::bigint as pages from (select unnest(range(0, l_quantity::bigint % 5 + 1)) as part from lineitem) group by 1")
def l_response_pages(t):
    items = t("lineitem").select(F.lit("multiple-pages").alias("mode"), F.lit(None).cast("long").alias("lines"), (F.col("l_quantity").cast("long") % 5 + 1).alias("pages"))
    return segments.segments(items).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("pages"))


@query("""
with i as (select conv_id, role, turn, row_number() over (partition by conv_id, role order by turn) as n from conversations)
select conv_id, turn, 'L' || conv_id || '-' || case role when 'user' then 'C' when 'assistant' then 'A' end || n as code, case when n < 10 then '0' || n else n::varchar end as number,
  max(n) over (partition by conv_id, role) || case when max(n) over (partition by conv_id, role) = 1 then ' question' else ' questions' end as summary from i
""")
def l_answer_codes(t):
    own = Window.partitionBy("conv_id", "role")
    section = F.create_map(*[F.lit(x) for x in ("user", "readingComprehension", "assistant", "criticalThinkingAndAnalysis", "system", "vocabulary")])[F.col("role")]
    rows = t("conversations").withColumns({"idx": F.row_number().over(own.orderBy("turn")) - 1, "n": F.count("*").over(own)})
    return rows.select("conv_id", "turn", segments.answer_code(section, F.col("conv_id"), F.col("idx")).alias("code"), segments.vocabulary_number(F.col("idx")).alias("number"), segments.section_summary(F.col("n"), "question", "questions").alias("summary"))


@query("select conv_id, md5(string_agg(text, ' ' order by turn)) as text_md5, md5(regexp_replace(upper(replace(string_agg(text, ' ' order by turn), 'ß', 'SS')), '[^A-Z0-9]+', '', 'g')) as canonical_md5 from conversations group by 1")
def q_page_text(t):
    from tessera.functions.text import canonical

    made = audit.joined_text(t("conversations"), ["conv_id"], "text", "turn")
    return made.select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.md5(canonical(F.col("text")).cast("binary")).alias("canonical_md5"))


@query("""
with p as (select page_id, try_cast(regexp_extract(url, 'page=([0-9]+)', 1) as bigint) as printed, row_number() over (partition by regexp_extract(url, '^https?://([^/]+)', 1) order by page_id) as page, regexp_extract(url, '^https?://([^/]+)', 1) as host from pages)
select page_id, host, page::bigint as page, printed, case when printed is null then 'missing' else 'wrong' end as problem from p where printed is null or printed <> page
""")
def q_footers(t):
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    rows = t("pages").withColumn("host", host)
    rows = rows.withColumns({"page": F.row_number().over(Window.partitionBy("host").orderBy("page_id")).cast("long"), "foot": audit.footer_numbers(F.when(F.col("url").rlike(r"page=\d+"), F.concat(F.lit("Page "), F.regexp_extract("url", r"page=(\d+)", 1), F.lit(" of 1"))))})
    wrong = rows.where(F.col("foot").isNull() | (F.col("foot.current") != F.col("page")))
    return wrong.select("page_id", "host", "page", F.col("foot.current").alias("printed"), F.when(F.col("foot").isNull(), "missing").otherwise("wrong").alias("problem"))


@query("""
with r as (select conv_id, count(*) as n, string_agg(case role when 'user' then '1' when 'assistant' then '2' else '' end, '' order by turn) as seen from conversations group by 1)
select conv_id, seen, repeat('12', ((n + 1) // 2)::int) as wanted from r where seen <> repeat('12', ((n + 1) // 2)::int)
""")
def q_section_sequence(t):
    rows = t("conversations")
    docs = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(F.floor((F.count("*") + 1) / 2).alias("lesson_count"))
    texts = rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.concat(F.lit("Page "), F.col("turn").cast("string"), F.lit(" of 9")).alias("text"), F.when(F.col("role") == "user", "STEP1READ").when(F.col("role") == "assistant", "STEP2THINK").otherwise("").alias("canonical"), F.lit("").alias("header_canonical"))
    found = audit.step_order(docs, texts, audit.markers(rows.sparkSession).where("step <= 2"))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "")
    return found.select(F.col("doc_id").alias("conv_id"), joined("seen").alias("seen"), joined("wanted").alias("wanted"))


@query("select d.doc_id, b.item_id from documents d, benchmark b where contains(d.text, b.text)")
def q_leaks(t):
    return audit.leaks(t("documents"), t("benchmark"), "doc_id", "text", "item_id", "text")


@query("select vec_id, round(embedding[1]::double * 100 + 595.276, 6) as width, round(embedding[2]::double * 100 + 841.89, 6) as height from embeddings where abs(embedding[1]::double * 100) > 1 or abs(embedding[2]::double * 100) > 1")
def q_page_bounds(t):
    e = lambda k: F.col("embedding")[k].cast("double") * 100
    pages = t("embeddings").select("vec_id", (e(0) + audit.A4[0]).alias("width"), (e(1) + audit.A4[1]).alias("height"))
    return pages.where(audit.not_a4(F.col("width"), F.col("height"))).select("vec_id", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"))


@query("""
with l as (select l_orderkey, l_shipdate::date as d, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem),
g as (select l_orderkey, date_diff('day', d, lag(d) over (partition by l_orderkey order by d desc, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) as gap from l)
select gap::bigint as gap, count(*)::bigint as lines from g where gap is not null group by 1
""")
def q_line_gaps(t):
    rows = t("lineitem").withColumn("day", F.unix_date(F.col("l_shipdate").cast("date")))
    gaps = audit.rule_gaps(rows, ["l_orderkey"], "day", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return gaps.where("gap is not null").groupBy(F.col("gap").cast("long").alias("gap")).agg(F.count("*").alias("lines"))


@query("""
with recursive o as (select user_id, row_number() over (partition by user_id order by event_id) as k, event_type as kind, coalesce(value, 0) as v from events),
s as (
  select distinct user_id, 0::bigint as k, 0::double as y, '' as color, []::struct(y double, color varchar)[] as stack, null::double as page_y, null::double as width from events
  union all
  select o.user_id, o.k,
    case when kind = 'error' and len(stack) > 0 then stack[-1].y when kind = 'click' then s.y + v else s.y end,
    case when kind = 'error' and len(stack) > 0 then stack[-1].color when kind = 'purchase' then '#c6d0c8' else s.color end,
    case when kind = 'signup' then list_append(stack, {'y': s.y, 'color': s.color}) when kind = 'error' and len(stack) > 0 then stack[:-2] else stack end,
    case when kind = 'view' and s.color = '#c6d0c8' and abs(v * 10 + 350) >= 400 then s.y end, abs(v * 10 + 350)
  from s join o on o.user_id = s.user_id and o.k = s.k + 1
)
select user_id as doc_id, 1 as page, (row_number() over (partition by user_id order by page_y desc, width desc) - 1)::int as idx, round(page_y, 6) as page_y, round(width, 6) as width from s where page_y is not null
""")
def q_op_replay(t):
    """Rules found by replaying each user's events as drawing operations."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", "save").when(kind == "error", "restore").when(kind == "click", "transform").when(kind == "purchase", "stroke").otherwise("path")
    v = F.coalesce(F.col("value"), F.lit(0.0))
    zero, one = F.lit(0.0), F.lit(1.0)
    args = F.when(kind == "click", F.array(one, zero, zero, one, zero, v)).when(kind == "view", F.array(zero, zero, v * 10 + 350, zero))
    ops = t("events").select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page"), F.col("event_id").alias("idx"), op.alias("op"), args.alias("args"), F.when(kind == "purchase", audit.RULE_COLOR.upper()).alias("color"))
    return audit.ruled_lines(ops).select("doc_id", "page", "idx", F.round("page_y", 6).alias("page_y"), F.round("width", 6).alias("width"))


_SIDES = "u as (select conv_id, row_number() over (partition by conv_id order by turn) as pos, text from conversations where role = 'user'), a as (select conv_id, row_number() over (partition by conv_id order by turn) as pos, text from conversations where role = 'assistant')"


def _sides(t):
    own = Window.partitionBy("conv_id").orderBy("turn")
    one = lambda role: t("conversations").where(F.col("role") == role).withColumn("pos", F.row_number().over(own)).select("conv_id", "pos", F.col("text").alias("str"), F.length("text").cast("double").alias("w"))
    return one("user"), one("assistant")


@query(f"with {_SIDES}, j as (select coalesce(u.conv_id, a.conv_id) as conv_id, u.text as l, a.text as r from u full join a on u.conv_id = a.conv_id and u.pos = a.pos) select conv_id, count(*) filter (where l is not null and r is not null and l <> r)::bigint as differing, count(*) filter (where l is null or r is null)::bigint as unpaired, coalesce(max(case when l = r then 0 end), -1)::bigint as worst from j group by 1")
def v_parity_text(t):
    left, right = _sides(t)
    both = parity.sides(left, right, ["conv_id", "pos"], ["str"])
    pair = F.col("l_here") & F.col("r_here")
    return both.groupBy("conv_id").agg(F.count_if(pair & (F.col("l_str") != F.col("r_str"))).alias("differing"), F.count_if(~pair).alias("unpaired"), F.coalesce(F.max(F.when(pair & (F.col("l_str") == F.col("r_str")), 0)), F.lit(-1)).cast("long").alias("worst"))


@query(f"with {_SIDES}, n as (select coalesce(x.conv_id, y.conv_id) as conv_id, coalesce(x.n, 0) as l_rows, coalesce(y.n, 0) as r_rows from (select conv_id, count(*) as n from u group by 1) x full join (select conv_id, count(*) as n from a group by 1) y on x.conv_id = y.conv_id) select conv_id, l_rows::bigint as l_rows, r_rows::bigint as r_rows from n where l_rows <> r_rows")
def v_count_differences(t):
    return parity.count_differences(*_sides(t), ["conv_id"])


_PAIR = "embeddings l join embeddings r on r.vec_id = l.vec_id + 1"


def _vectors(t):
    cut = lambda df, shift: df.select((F.col("vec_id") - shift).alias("vec_id"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(("x", "y", "w"))])
    return cut(t("embeddings"), 0), cut(t("embeddings"), 1)


@query(f"select l.vec_id, round(greatest(abs(l.embedding[1]::double - r.embedding[1]::double), abs(l.embedding[2]::double - r.embedding[2]::double), abs(l.embedding[3]::double - r.embedding[3]::double)), 6) as moved from {_PAIR} where greatest(abs(l.embedding[1]::double - r.embedding[1]::double), abs(l.embedding[2]::double - r.embedding[2]::double), abs(l.embedding[3]::double - r.embedding[3]::double)) > 0.1")
def v_parity_offsets(t):
    found = parity.compared(*_vectors(t), ["vec_id"], None, ["x", "y", "w"], 0.1)
    return found.where("kind = 'moved'").select("vec_id", F.round("offset", 6).alias("moved"))


@query(f"with c as (select l.vec_id, list_transform(generate_series(1, len(l.embedding)), lambda i: abs((floor(l.embedding[i]::double * 100 + 128)::bigint & 255) - (floor(r.embedding[i]::double * 100 + 128)::bigint & 255))) as g from {_PAIR}) select vec_id, len(g)::bigint as channels, len(list_filter(g, lambda x: x > 0))::bigint as differing, list_max(g)::bigint as worst_delta from c")
def v_channel_diff(t):
    pixel = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor(x.cast("double") * 100 + 128).bitwiseAND(255)), 2, "0"))
    made = t("embeddings").select("vec_id", F.lit(1).alias("page"), F.lit(1).alias("width"), F.size("embedding").alias("height"), F.lit(1).alias("channels"), F.unhex(F.array_join(pixel, "")).alias("pixels"))
    found = parity.raster_differences(made.withColumnRenamed("vec_id", "doc_id"), made.withColumn("doc_id", F.col("vec_id") - 1).drop("vec_id"))
    return found.select(F.col("doc_id").alias("vec_id"), "channels", "differing", F.col("worst_delta").cast("long").alias("worst_delta"))


@query("select c_custkey, regexp_extract(c_name, '([0-9]+)$', 1)::bigint as n, row_number() over (partition by c_nationkey order by regexp_extract(c_name, '([0-9]+)$', 1)::bigint desc, c_custkey)::bigint as place from customer")
def v_numeric_suffix(t):
    n = parity.trailing_number(F.col("c_name"), "")
    return t("customer").select("c_custkey", n.cast("long").alias("n"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(n.desc(), "c_custkey")).cast("long").alias("place"))
