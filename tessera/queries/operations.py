"""Queries of archives, inventories, logs, boards, feedback and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import base64_size, megabytes, milliseconds
from tessera.operators import archives, essays, inventory, logs, notices
from tessera.queries.base import query
from tessera.streaming import state

_FILES = "f as (select source, doc_id, 'doc-' || doc_id || '.pdf' as name, octet_length(encode(text)) as bytes, n_chars from documents)"


def _files(t):
    return t("documents").select("source", "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), F.octet_length("text").cast("long").alias("bytes"), "n_chars")


_PACKED = f"""recursive {_FILES},
o as (select source, doc_id, name, bytes, row_number() over (partition by source order by doc_id) as rn from f),
p as (select source, doc_id, name, bytes, rn, 0 as archive_no, bytes as held from o where rn = 1 union all
  select o.source, o.doc_id, o.name, o.bytes, o.rn, case when p.held + o.bytes > 20000 then p.archive_no + 1 else p.archive_no end, case when p.held + o.bytes > 20000 then o.bytes else p.held + o.bytes end
  from p join o on o.source = p.source and o.rn = p.rn + 1)"""


@query(f"with {_PACKED} select source, doc_id, archive_no::bigint as archive_no from p")
def x_pack(t):
    return archives.pack(_files(t), 20_000, ["source"], ["doc_id"], "bytes").select("source", "doc_id", F.col("archive_no").cast("long").alias("archive_no"))


@query(f"with {_PACKED} select source, count(distinct archive_no)::bigint as archives, count(*)::bigint as files from p where archive_no < 2 group by 1")
def x_first_archives(t):
    packed = archives.pack(_files(t), 20_000, ["source"], ["doc_id"], "bytes")
    return archives.first_archives(packed, 2).groupBy("source").agg(F.max("archive_no").cast("long").alias("m"), F.count("*").alias("files")).select("source", (F.col("m") + 1).alias("archives"), "files")


@query(f"""
with {_PACKED}, w as (select *, sum(30 + length(name) + bytes) over (partition by source, archive_no order by doc_id) - (30 + length(name) + bytes) as "offset",
  sum(30 + length(name) + bytes) over (partition by source, archive_no) as directory_start, sum(46 + length(name)) over (partition by source, archive_no) as directory from p)
select source, doc_id, "offset"::bigint as "offset", directory_start::bigint as directory_start, (directory_start + directory + 22)::bigint as archive_bytes from w
""")
def x_archive_offsets(t):
    packed = archives.pack(_files(t), 20_000, ["source"], ["doc_id"], "bytes")
    return archives.archive_offsets(packed, ["source", "archive_no"], ["doc_id"], "name", "bytes").select("source", "doc_id", "offset", "directory_start", "archive_bytes")


@query(f"with {_FILES} select source, count(*)::bigint as files, sum(bytes)::bigint as raw_bytes, sum(n_chars)::bigint as packed_bytes, sum(ceil(n_chars / 3.0) * 4)::bigint as wire_bytes, round(sum(n_chars) / sum(bytes), 6) as share from f group by 1")
def x_byte_totals(t):
    rows = _files(t).select("source", F.col("bytes").alias("raw_bytes"), F.col("n_chars").alias("packed_bytes"))
    return archives.byte_totals(rows, ["source"]).withColumn("share", F.round("share", 6))


@query(f"""
with {_FILES}, e as (select name, bytes, n_chars as digest from f where doc_id % 7 <> 0), g as (select name, case when doc_id % 11 = 0 then bytes + 1 else bytes end as bytes, n_chars as digest from f where doc_id % 5 <> 0)
select coalesce(e.name, g.name) as name, case when g.name is null then 'missing' when e.name is null then 'unexpected' else 'different' end as problem
from e full join g on e.name = g.name where g.name is null or e.name is null or e.bytes <> g.bytes or e.digest <> g.digest
""")
def x_delivered(t):
    files = _files(t).withColumnRenamed("n_chars", "digest")
    got = files.where("doc_id % 5 <> 0").withColumn("bytes", F.col("bytes") + (F.col("doc_id") % 11 == 0).cast("int"))
    return archives.delivery_differences(files.where("doc_id % 7 <> 0"), got)


@query(f"with {_FILES} select doc_id, bytes::bigint as bytes from f where bytes > 4000 and name ilike '%.pdf'")
def x_over_limit(t):
    return archives.over_limit(archives.pdf_names(_files(t)), F.col("bytes"), F.lit(4000)).select("doc_id", "bytes")


@query("select doc_id, sha256(text) as digest, octet_length(encode(text))::bigint as raw_bytes from documents")
def x_entry_digests(t):
    """Sizes and digests of entries; checksums (CRC-32) are tested on fixtures."""
    made = archives.entry_metrics(t("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.sha2("text", 256)).alias("name"), F.col("text").cast("binary").alias("content")))
    part = F.split("name", r"\|")
    return made.select(part[0].cast("long").alias("doc_id"), part[1].alias("digest"), "raw_bytes")


@query("select doc_id, greatest(262144, (n_chars * 1000) // (1 << (doc_id % 8)::int))::bigint as budget from documents")
def x_budget_ladder(t):
    return t("documents").select("doc_id", archives.laddered_budget(F.col("n_chars") * 1000, F.col("doc_id") % 8).alias("budget"))


@query("""
select p_partkey, 'builds/' || coalesce(nullif(substr(trim(regexp_replace(p_type, '[\\\\/:*?"<>|]', '-', 'g')), 1, 90), ''), 'Workbook') || '/' || strftime(timestamp '2024-01-01 00:00:00' + to_minutes((p_partkey % 100000)::int) + interval 9 hour, '%Y-%m-%d %H-%M-%S') as path from part
""")
def x_build_path(t):
    at = F.timestamp_add("MINUTE", (F.col("p_partkey") % 100000).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return t("part").select("p_partkey", archives.build_path("builds", F.col("p_type"), F.lit("sheet"), at, "Asia/Seoul").alias("path"))


_AREA = "case when source in ('src0', 'src1') then 'compiler' when source in ('src2', 'src3') then 'fonts' when source in ('src4', 'src5', 'src6') then 'templates and logos' when source = 'src7' then 'workbook content' else 'preview page' end"


@query(f"with f as (select {_AREA} as area, octet_length(encode(text)) as bytes, n_chars from documents) select coalesce(area, 'total') as area, count(*)::bigint as files, sum(bytes)::bigint as bytes, sum(n_chars)::bigint as compressed_bytes from f group by rollup (area)")
def b_area_totals(t):
    folder = F.create_map(*[F.lit(x) for s, p in (("src0", "vendor/"), ("src1", "vendor/"), ("src2", "project/assets/fonts/"), ("src3", "project/assets/fonts/"), ("src4", "project/"), ("src5", "project/"), ("src6", "project/"), ("src7", "fixtures/")) for x in (s, p)])
    path = F.concat(F.coalesce(folder[F.col("source")], F.lit("")), F.col("doc_id").cast("string"))
    return inventory.area_totals(t("documents").select(path.alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.col("n_chars").alias("compressed_bytes")))


@query("select doc_id, printf('%.2f MiB', octet_length(encode(text)) * 1000 / 1048576.0) as size from documents where octet_length(encode(text)) * 1000 > 4194304")
def b_over_host_limit(t):
    rows = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), (F.octet_length("text").cast("long") * 1000).alias("bytes"))
    return inventory.over_host_limit(rows, 4 << 20).select(F.col("path").cast("long").alias("doc_id"), "size")


_RULES = [("https://www.*", "site"), ("https://*", "secure"), ("http://*", "plain")]


@query("select page_id, case when starts_with(url, 'https://www.') then 'site' when starts_with(url, 'https://') then 'secure' when starts_with(url, 'http://') then 'plain' else 'other' end as value from pages")
def b_first_rule(t):
    return inventory.first_rule(t("pages").select("page_id", F.col("url").alias("path")), _RULES, "other").select("page_id", "value")


@query("select page_id, case when starts_with(url, 'https://www.') then 'site' when starts_with(url, 'https://') then 'secure' when starts_with(url, 'http://') then 'plain' else 'other' end as value from pages")
def b_first_rule_by_table(t):
    pages = t("pages").select("page_id", F.col("url").alias("path"))
    rules = pages.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(_RULES)], "rule_no int, pattern string, value string")
    return inventory.first_rule_by_table(pages, rules, "other").select("page_id", "value")


@query("select user_id, event_type, arg_max(coalesce(value, 0), event_id) as last_value, min(event_id) as first_seen from events group by 1, 2")
def g_latest_values(t):
    log = t("events").select("user_id", "event_type", "event_id", F.coalesce("value", F.lit(0.0)).alias("value"))
    return logs.latest(log, ["user_id", "event_type"], "value", "event_id")


@query("select user_id, string_agg(event_type, '; ' order by event_id) as answers from events group by 1")
def g_answers(t):
    return logs.joined_answers(t("events"), ["user_id"], "event_type", "event_id")


@query("with r as (select user_id, event_type, lag(event_type) over (partition by user_id order by event_id) as before from events) select user_id, count(*) filter (where before = event_type)::bigint as refreshed, count(*) filter (where before is null or before <> event_type)::bigint as firsts from r group by 1")
def g_refresh_or_first(t):
    runs = logs.refresh_or_first(t("events"), "event_type", "user_id", "event_id")
    return runs.groupBy("user_id").agg(F.count_if(F.col("run") == "refresh").alias("refreshed"), F.count_if(F.col("run") == "first").alias("firsts"))


@query("select o_custkey, o_orderkey as largest, o_totalprice as largest_size from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n = 1")
def g_largest(t):
    return logs.largest(t("orders"), ["o_custkey"], "o_orderkey", "o_totalprice", "o_orderkey")


@query("select o_custkey, count(*) filter (where o_orderstatus = 'F')::bigint as passed, count(*)::bigint as checks, count(*) filter (where o_orderstatus = 'F') || ' of ' || count(*) as tally from orders group by 1")
def g_tally(t):
    return logs.tally(t("orders"), ["o_custkey"], F.col("o_orderstatus") == "F")


@query("select event_type, count(*)::bigint as calls, sum(user_id)::bigint as remote_ms, sum(user_id + event_id % 97)::bigint as wall_ms, sum(event_id % 97)::bigint as channel_ms, sum(length(props))::bigint as bytes from events group by 1")
def g_time_split(t):
    calls = t("events").select("event_type", F.col("user_id").alias("remote_ms"), (F.col("user_id") + F.col("event_id") % 97).alias("wall_ms"), F.length("props").cast("long").alias("bytes"))
    return logs.split_time(calls, ["event_type"])


@query("select doc_id, case when n_chars >= 1000 then printf('%d.%02d s', (n_chars + 5) // 1000, (n_chars + 5) // 10 % 100) else n_chars || ' ms' end as took, printf('%.2f MB', n_chars * 1000 / 1048576.0) as size, (ceil(n_chars / 3.0) * 4)::bigint as wire, case when source = 'src0' then 5 when lang = 'en' then 3 else 4 end::bigint as check_no from documents")
def g_humanised(t):
    scope = F.when(F.col("source") == "src0", "workbook").otherwise("lesson")
    edition = F.when(F.col("lang") == "en", "student").otherwise("teacher")
    n = F.col("n_chars")
    return t("documents").select("doc_id", milliseconds(n).alias("took"), megabytes(n * 1000).alias("size"), base64_size(n).alias("wire"), logs.check_of(scope, edition).cast("long").alias("check_no"))


@query("select user_id, count(*)::bigint as runs, min(event_id) as fastest, max(event_id) as slowest, round((max(event_id) - min(event_id)) / nullif(min(event_id), 0), 6) as spread from events group by 1")
def g_run_spread(t):
    return logs.run_spread(t("events"), ["user_id"], "event_id").withColumn("spread", F.round("spread", 6))


@query("with c as (select user_id, event_type, max(event_id % 50) + 1 as r, max(event_id % 7) + 1 as k from events group by 1, 2) select user_id, count(*)::bigint as tabs, sum(r * k)::bigint as cells from c group by 1")
def g_read_cost(t):
    cells = t("events").select(F.col("user_id").alias("workbook_id"), F.col("event_type").alias("sheet"), (F.col("event_id") % 50 + 1).alias("row"), (F.col("event_id") % 7 + 1).alias("col"))
    reads = cells.select("workbook_id").distinct().withColumn("milliseconds", F.lit(100.0))
    return logs.read_cost(cells, reads).select(F.col("workbook_id").alias("user_id"), "tabs", "cells")


@query("select 'code-' || (user_id % 5) as reason, (400 + user_id % 3)::bigint as status, count(*)::bigint as failures from events where event_type = 'error' group by 1, 2")
def g_failures(t):
    told = F.to_json(F.struct(F.lit("auth_failed").alias("event"), F.concat(F.lit("code-"), (F.col("user_id") % 5).cast("string")).alias("reason"), (400 + F.col("user_id") % 3).alias("status")))
    return logs.failures(t("events").where("event_type = 'error'").select(told.alias("m")), "m").withColumn("status", F.col("status").cast("long"))


_BOARD = "n as (select o_orderkey, o_custkey % 10 as board, row_number() over (partition by o_custkey % 10 order by o_orderdate desc, o_orderkey) as position, count(*) over (partition by o_custkey % 10) as total from orders)"


@query(f"with {_BOARD} select o_orderkey, board, position::bigint as position, (total - position + 1)::bigint as number, ((position - 1) // 8 + 1)::bigint as page, ceil(total / 8.0)::bigint as pages from n")
def n_board(t):
    rows = t("orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("board"), "o_orderdate")
    made = notices.numbered(rows, "board", "o_orderdate", "o_orderkey")
    return made.select("o_orderkey", "board", *[F.col(c).cast("long").alias(c) for c in ("position", "number", "page", "pages")])


@query("select event_id, strftime(ts + interval 9 hour, '%Y-%m-%d') as day, strftime(ts + interval 9 hour, '%Y') || '년 ' || month(ts + interval 9 hour) || '월 ' || day(ts + interval 9 hour) || '일' as long_day, strftime(ts + interval 9 hour, '%Y-%m-%d') || '-' || event_type as file_id from events")
def n_local_dates(t):
    at = F.col("ts")
    return t("events").select("event_id", notices.iso_day(at).alias("day"), notices.long_day(at).alias("long_day"), notices.file_id(at, F.col("event_type")).alias("file_id"))


@query("""
with u as (select source, doc_id, n_chars from documents)
select source, count(*)::bigint as images, count(*) filter (where n_chars > 3000)::bigint as too_large, arg_min(doc_id, doc_id) filter (where n_chars > 3000) as first_large from u group by 1 having count(*) > 12 or count(*) filter (where n_chars > 3000) > 0
""")
def n_media_limits(t):
    return notices.media_problems(t("documents"), ["source"], "doc_id", "n_chars", "doc_id", 12, 3000)


@query("select page_id, case when starts_with(url, 'https://') then '/notices/' || substr(url, 9) else url end || '|' || 'Title ' || page_id || ' 안내 이미지 1' as image from pages")
def n_images(t):
    rows = t("pages").select("page_id", F.array("url").alias("images"), F.concat(F.lit("Title "), F.col("page_id").cast("string")).alias("title"))
    one = lambda c: F.element_at(c, 1)
    return rows.select("page_id", F.concat(one(notices.rooted(F.col("images"), "https://")), F.lit("|"), one(notices.image_alts(F.col("title"), F.col("images")))).alias("image"))


_CHOSEN = "c as (select item_id, item_id // 12 as essay, row_number() over (partition by item_id // 12 order by item_id) - 1 as position from benchmark)"


@query(f"""
with {_CHOSEN}, s as (select conv_id, turn, role, text, conv_id % 17 + turn as item from conversations)
select s.conv_id, s.turn, case when c.position is not null then 'comment' when role = 'system' then 'italic' else 'text' end as kind,
  case when c.position + 1 < 10 then '0' || (c.position + 1) else (c.position + 1)::varchar end as number, case when c.position is not null then string_split(s.text, ' ')[-1] end as tail, p.item_id as panel_comment
from s left join c on c.item_id = s.item left join c p on p.item_id = s.item + 5 and p.essay = s.item // 12 and s.turn % 2 = 0
""")
def e_annotated(t):
    """Essays of twelve comments each; every second segment is followed by a comment's panel."""
    item = F.col("conv_id") % 17 + F.col("turn")
    essay = lambda c: F.floor(c / 12)
    rows = t("conversations").select(essay(item).alias("essay_id"), "conv_id", "turn", "text", item.alias("comment_id"), F.when(F.col("turn") % 2 == 0, item + 5).alias("comment_after"), (F.col("role") == "system").alias("italic"))
    comments = t("benchmark").select(F.col("item_id").alias("comment_id"), "text")
    wanted = comments.select(essay(F.col("comment_id")).alias("essay_id"), "comment_id")
    wanted = wanted.withColumn("position", F.row_number().over(Window.partitionBy("essay_id").orderBy("comment_id")) - 1)
    return essays.annotated(rows, essays.selected(wanted, comments)).select("conv_id", "turn", "kind", "number", "tail", "panel_comment")


@query("select conv_id, md5(string_agg(text, '' order by turn)) as text_md5 from conversations group by 1")
def e_paragraphs(t):
    rows = t("conversations").select(F.col("conv_id").alias("essay_id"), F.lit(1).alias("para_seq"), F.col("turn").alias("seg_seq"), "text")
    return essays.paragraphs(rows).select(F.col("essay_id").alias("conv_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("select distinct d.doc_id as comment_id from documents d where not exists (select 1 from benchmark b where b.item_id = d.doc_id)")
def e_missing_comments(t):
    return essays.missing(t("documents").select(F.col("doc_id").alias("comment_id")), t("benchmark").select(F.col("item_id").alias("comment_id"), "text"))


@query("""
with b as (select user_id, ts, event_id, event_type = 'purchase' as reply from events where event_type in ('view', 'purchase')),
n as (select *, lead(reply) over w as next_reply, lead(ts) over w as next_ts from b window w as (partition by user_id order by ts, reply, event_id))
select event_id, case when next_reply and next_ts <= ts + interval 3600 second then 'replied' else 'timeout' end as outcome from n where not reply
""")
def k_request_reply(t):
    rows = t("events").withColumn("kind", F.lit("view"))
    made = logs.request_reply(rows.where("event_type = 'view'").select("user_id", "kind", "ts", "event_id"), rows.where("event_type = 'purchase'").select("user_id", "kind", "ts"), "user_id", "kind", "ts", 3600)
    return made.select("event_id", "outcome")


@query("""
with r as (select *, sum((event_type = 'signup')::int) over (partition by user_id order by event_id) as part from events)
select event_id, sum((event_type = 'error')::int) over (partition by user_id, part order by event_id)::bigint as refusals from r
""")
def k_open_budget(t):
    made = logs.open_budget(t("events"), "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "error")
    return made.select("event_id", "refusals")


@query("""
with r as (select user_id, event_id, case when event_type = 'error' then 'cell-' || event_id end as cell, lag(case when event_type = 'error' then 'cell-' || event_id end) over (partition by user_id order by event_id) as before from events)
select user_id, event_id as seq, 'clear' as action, before as cell from r where before is not null union all select user_id, event_id, 'set', cell from r where cell is not null
""")
def k_marks(t):
    cell = F.when(F.col("event_type") == "error", F.concat(F.lit("cell-"), F.col("event_id").cast("string")))
    rows = t("events").select(F.col("user_id").alias("workbook_id"), F.col("event_id").alias("seq"), cell.alias("cell"))
    return state.marks(rows).select(F.col("workbook_id").alias("user_id"), "seq", "action", "cell")


@query("select user_id, max_by.event_id as event_id, max_by.event_type as event_type from (select user_id, arg_max(struct_pack(event_id, event_type), event_id) as max_by from events group by 1)")
def k_newest_snapshots(t):
    return state.newest(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("""
with p as (select user_id, floor(value)::bigint as batch, max(epoch_us(ts))::bigint as read_us from events group by 1, 2),
b as (select *, max(read_us) over (partition by user_id order by batch rows between unbounded preceding and 1 preceding) as before from p)
select user_id, batch, read_us from b where before is null or read_us > before
""")
def k_accepted_snapshots(t):
    """Events arrive by their measured value, each batch a unit of it; a key's batch passes if it brings a newer time than all before."""
    rows = t("events").select("user_id", F.floor("value").cast("long").alias("batch"), F.unix_micros(F.col("ts").cast("timestamp")).alias("read_us"))
    return state.accepted(rows, "batch", "user_id", "read_us")
