"""Chat formatting: tool calls linked to results, ordered, checked and serialised.

Calls and results meet in a hash join by conversation and identifier.  Calls are
put in topological order of what they use by removing, round by round, the calls
all of whose needs are done.  Arguments are validated against schemas, and every
message becomes canonical JSON: keys in order, no spaces, nulls left out.
Everything is DataFrame work; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, settle

#: Tools by name; fields with their kind and whether they must be there.
SCHEMAS = {"reply": {"chars": ("integer", True), "prompt": ("string", True), "uses": ("array", False)}}
#: Copies of one row that are given out at a time.
COPIES_AT_ONCE = 1 << 12
_KINDS = {"integer": "BIGINT|INT|SMALLINT|TINYINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "string": "STRING", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def problems(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """What is wrong with a call's arguments, as sorted texts; empty if nothing is."""
    value = F.try_parse_json(arguments)
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        checks = [F.when(~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), F.lit("not an object"))]
        for field, (kind, needed) in fields.items():
            found = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            gone = found.isNull() | (found == "VOID")
            checks.append(F.when(gone, F.lit(f"missing {field}") if needed else F.lit(None)).when(~found.rlike(f"^({_KINDS[kind]})"), F.lit(f"{field} is not {kind}")))
        strange = F.transform(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*map(F.lit, fields))), lambda x: F.concat(F.lit("unknown "), x))
        out = F.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*checks)), strange))).otherwise(out)
    return out


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level of each call: 0 without needs, else over all that it uses.

    Needs that name no call of the conversation count as met.  Calls on a cycle,
    or above one, get no row.  In each round the calls all of whose needs are done
    get their level, and edges to a call with a single need jump over it, so a
    chain of n calls takes about log2(n) rounds.
    """
    key = ["conv_id", "call_id"]
    ids = settle(calls.select(*key).distinct(), "call-ids")
    used = calls.select(*key, F.explode(F.coalesce(F.from_json(F.get_json_object("arguments", "$.uses"), "array<string>"), F.array().cast("array<string>"))).alias("need")).distinct()
    edges = settle(used.join(ids.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"]).select(*key, "need", F.lit(1).cast("long").alias("steps")), "call-needs")
    done = settle(ids.join(edges, key, "left_anti").withColumn("level", F.lit(0).cast("long")), "call-levels")
    while True:  # each round settles a call, or is the last
        by_node = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("need").alias("next"), F.min("steps").alias("more"))
        over = by_node.where("n = 1").select("conv_id", F.col("call_id").alias("need"), "next", "more")
        met = done.select("conv_id", F.col("call_id").alias("need"), "level")
        looked = settle(edges.join(met, ["conv_id", "need"], "left").join(over, ["conv_id", "need"], "left"), "call-looked")
        ready = looked.groupBy(*key).agg(F.count("*").alias("n"), F.count("level").alias("met"), F.max(F.col("level") + F.col("steps")).alias("level"))
        ready = settle(ready.where("n = met").select(*key, "level"), "call-ready")
        if ready.isEmpty():
            break
        jump = F.col("level").isNull() & F.col("next").isNotNull()
        old = edges, looked, done
        moved = looked.select(*key, F.when(jump, F.col("next")).otherwise(F.col("need")).alias("need"), F.when(jump, F.least(F.col("steps") + F.col("more"), F.lit(1 << 40))).otherwise(F.col("steps")).alias("steps"))
        edges = settle(moved.join(ready.select(*key), key, "left_anti").groupBy(*key, "need").agg(F.max("steps").alias("steps")), "call-needs")
        done = settle(done.unionByName(ready), "call-levels")
        for x in (*old, ready):
            discard(x)
        if edges.isEmpty():
            break
    return done.select(*key, F.col("level").cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row a call and one an orphan result, with canonical JSON.

    Takes calls (conv_id, turn, call_id, name, arguments) and results (conv_id,
    turn, call_id, content).  Status: ``linked``, ``pending`` (no result),
    ``orphan`` (a result without a call), ``duplicate`` (a later call or result
    of a taken identifier; the first by turn and a hash of its content stays) or
    ``cycle``.  Null identifiers never link.  Arguments that are no JSON, or repeat
    a key, are kept as a JSON text.
    """
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()

    def counted(rows: DataFrame, *by: str) -> DataFrame:
        """rows with ``nth``: 1 for the first of an identifier and for rows without one, else 2."""
        order = F.struct("turn", F.xxhash64(*by).alias("h"))
        named = rows.where(known).withColumn("_at", order)
        # written first, so that its size is known: where few identifiers repeat, it is broadcast and no text moves
        first = settle(named.groupBy("conv_id", "call_id").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1"), "repeated-ids")
        found = named.join(first, ["conv_id", "call_id"], "left")
        once = found.where("_n is null").withColumn("nth", F.lit(1)).select(*rows.columns, "nth")
        again = found.where("_n is not null and _at <> _first").withColumn("nth", F.lit(2)).select(*rows.columns, "nth")
        # copies of the first row itself: one of them is the first
        same = found.where("_n is not null and _at = _first").groupBy(*rows.columns).agg(F.count("*").alias("_n"))
        # given out in parts, however many there are
        parts = same.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES_AT_ONCE))).alias("_k"))
        many = parts.withColumn("_more", F.least(F.col("_n") - F.col("_k") * COPIES_AT_ONCE, F.lit(COPIES_AT_ONCE)).cast("int"))
        same = many.select(*rows.columns, "_k", F.explode(F.sequence(F.lit(1), F.col("_more"))).alias("_j")).select(*rows.columns, F.when((F.col("_k") == 0) & (F.col("_j") == 1), 1).otherwise(2).alias("nth"))
        return once.unionByName(again).unionByName(same).unionByName(rows.where(~known).withColumn("nth", F.lit(1)))

    calls, results = counted(calls, "name", "arguments"), counted(results, "content")
    left = calls.where("nth = 1").join(levels(calls.where(known & (F.col("nth") == 1))), ["conv_id", "call_id"], "left")
    right = results.where("nth = 1").select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content", F.lit(True).alias("answered"))
    joined = left.hint("shuffle_hash").join(right, ["conv_id", "call_id"], "left")
    status = F.when(known & F.col("level").isNull(), "cycle").when(F.col("answered"), "linked").otherwise("pending")
    wrong = problems(F.col("name"), F.col("arguments"), schemas)
    one = joined.withColumn("status", status).withColumn("problems", wrong)
    again = calls.where("nth > 1").withColumn("status", F.lit("duplicate")).withColumn("problems", wrong)

    def call_json(df: DataFrame) -> Column:
        rest = F.to_json(F.struct(F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result")))
        as_text = F.to_json(F.struct(F.col("arguments").alias("a")))  # {"a":"..."}: what does not parse stays, as a text
        as_text = F.when(F.col("arguments").isNotNull(), F.substring(as_text, F.lit(6), F.length(as_text) - 6))
        return F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json(F.try_parse_json("arguments")), as_text, F.lit("null")), F.when(rest == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(rest, 2, 2_000_000_000))))

    columns = ["conv_id", "turn", "kind", "call_id", "level", "status", "problems", "json"]
    again = again.withColumns({"level": F.lit(None).cast("int"), "content": F.lit(None).cast("string")})
    told = [x.withColumn("kind", F.lit("call")).withColumn("json", call_json(x)).select(columns) for x in (one, again)]
    orphan = results.where("nth = 1").join(calls.where(known).select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("status", F.lit("orphan"))
    spare = results.where("nth > 1").withColumn("status", F.lit("duplicate"))
    for x in (orphan, spare):
        told.append(
            x.withColumn("kind", F.lit("result")).withColumn("level", F.lit(None).cast("int")).withColumn("problems", F.array().cast("array<string>"))
            .withColumn("json", F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")))).select(columns)
        )
    out = told[0]
    for x in told[1:]:
        out = out.unionByName(x)
    return out


def call_id(turn: Column) -> Column:
    return F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))


def as_calls(turns: DataFrame) -> DataFrame:
    """User turns as calls of ``reply``; each uses the one two turns before it."""
    uses = F.when(F.col("turn") >= 2, F.array(call_id(F.col("turn") - 2)))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.length("text").alias("chars"), uses.alias("uses")))
    return turns.where("role = 'user'").select("conv_id", "turn", call_id(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"))


def as_results(turns: DataFrame) -> DataFrame:
    """Assistant turns as results of the call one turn before."""
    return turns.where("role = 'assistant'").select("conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Every turn as canonical JSON, user turns linked to the replies to them.

    A linked result stands in its call's row.  Other turns (system, unknown and
    null roles) are rows of kind ``message``.  Null texts leave a call without
    its prompt, which is a problem of the call; null ids or turns never link.
    Repeated turns are duplicates.  Extra columns are not read; an empty table
    gives no rows.
    """
    turns = settle(turns.select("conv_id", "turn", "role", "text"), "turns")
    linked = link(as_calls(turns), as_results(turns))
    plain = turns.where("role is null or role not in ('user', 'assistant')").select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"),
        F.lit("plain").alias("status"), F.array().cast("array<string>").alias("problems"), F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )
    return linked.unionByName(plain)


def report(turns: DataFrame) -> DataFrame:
    """conv_id, turn, kind, call_id, level, status, problems and json_md5 of each row."""
    rows = format_conversations(turns)
    return rows.select("conv_id", "turn", "kind", "call_id", "level", "status", F.array_join("problems", "; ").alias("problems"), F.md5(F.col("json").cast("binary")).alias("json_md5"))


ORACLE = """
with recursive calls as (
  select conv_id, turn, 'call-' || conv_id || '-' || turn as call_id, text from conversations where role = 'user'
), levels(conv_id, turn, level) as (
  select conv_id, turn, 0 from calls c where not exists (select 1 from calls p where p.conv_id = c.conv_id and p.turn = c.turn - 2)
  union all
  select c.conv_id, c.turn, l.level + 1 from levels l join calls c on c.conv_id = l.conv_id and c.turn = l.turn + 2
), results as (
  select conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) as call_id, text from conversations where role = 'assistant'
), told as (
  select c.conv_id, c.turn, 'call' as kind, c.call_id, l.level::int as level, case when r.call_id is null then 'pending' else 'linked' end as status,
    '{"arguments":{"chars":' || length(c.text) || ',"prompt":' || to_json(c.text)::varchar
      || case when c.turn >= 2 then ',"uses":["call-' || c.conv_id || '-' || (c.turn - 2) || '"]' else '' end
      || '},"id":"' || c.call_id || '","level":' || l.level || ',"name":"reply"' || coalesce(',"result":' || to_json(r.text)::varchar, '') || '}' as json
  from calls c join levels l using (conv_id, turn) left join results r on r.conv_id = c.conv_id and r.call_id = c.call_id
  union all
  select r.conv_id, r.turn, 'result', r.call_id, null, 'orphan', '{"id":"' || r.call_id || '","result":' || to_json(r.text)::varchar || '}'
  from results r where not exists (select 1 from calls c where c.conv_id = r.conv_id and c.call_id = r.call_id)
  union all
  select conv_id, turn, 'message', null, null, 'plain', '{"content":' || to_json(text)::varchar || ',"role":"' || role || '"}' from conversations where role not in ('user', 'assistant')
)
select conv_id, turn, kind, call_id, level, status, '' as problems, md5(json) as json_md5 from told
"""
