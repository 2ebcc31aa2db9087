"""Roll-ups of measurement, verdict and call logs.

log (session, seq, ts, kind, key, value); calls (session, seq, request_type,
reply_type, sent_ts, reply_ts, remote_ms, wall_ms, bytes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds to wait for a reply, and how long an export may take.
REPLY_SECONDS, EXPORT_SECONDS = 60, 300


def latest(log: DataFrame, keys: list[str], value: str = "value", order: str = "seq") -> DataFrame:
    """Last value of each key and ``first_seen``, by which the keys are listed."""
    return log.groupBy(*keys).agg(F.max_by(value, order).alias("last_value"), F.min(order).alias("first_seen"))


def joined_answers(log: DataFrame, keys: list[str], value: str = "value", order: str = "seq", by: str = "; ") -> DataFrame:
    """All answers of each check in order, as one text; a check is asked a few times a session."""
    gathered = log.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("g"))
    return gathered.select(*keys, F.array_join(F.transform("g", lambda x: x[value]), by).alias("answers"))


def refresh_or_first(log: DataFrame, item: str, session: str = "session", order: str = "seq") -> DataFrame:
    """log with ``run``: ``refresh`` where the session's row before is of the same item, else ``first``."""
    before = F.lag(item).over(Window.partitionBy(session).orderBy(order))
    return log.withColumn("run", F.when(before.eqNullSafe(F.col(item)) & before.isNotNull(), "refresh").otherwise("first"))


def largest(items: DataFrame, keys: list[str], item: str, size: str, order: str) -> DataFrame:
    """The largest item of each key; of equals the earliest."""
    return items.groupBy(*keys).agg(F.max_by(item, F.struct(F.col(size), -F.col(order))).alias("largest"), F.max(size).alias("largest_size"))


def tally(rows: DataFrame, keys: list[str], passed: Column) -> DataFrame:
    """passed, all and the text "n of m" of each key."""
    return rows.groupBy(*keys).agg(F.count_if(passed).alias("passed"), F.count("*").alias("checks")).withColumn("tally", F.concat(F.col("passed").cast("string"), F.lit(" of "), F.col("checks").cast("string")))


def split_time(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Remote time, and channel time (wall less remote), summed over the calls of each key."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("remote_ms").alias("remote_ms"), F.sum("wall_ms").alias("wall_ms"), F.sum(F.col("wall_ms") - F.col("remote_ms")).alias("channel_ms"), F.sum("bytes").alias("bytes"))


def check_of(scope: Column, edition: Column) -> Column:
    return F.when(scope == "workbook", 5).when(edition == "student", 3).otherwise(4)


def read_cost(cells: DataFrame, reads: DataFrame) -> DataFrame:
    """tabs, cells and milliseconds a tab of each read (workbook_id, milliseconds)."""
    sizes = cells.groupBy("workbook_id", "sheet").agg((F.max("row").cast("long") * F.max("col")).alias("cells")).groupBy("workbook_id").agg(F.count("*").alias("tabs"), F.sum("cells").alias("cells"))
    return reads.join(sizes, "workbook_id").withColumn("ms_per_tab", F.col("milliseconds") / F.col("tabs"))


def run_spread(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Spread of repeated runs: how far the slowest is above the fastest."""
    low, high = F.min(value), F.max(value)
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), low.alias("fastest"), high.alias("slowest"), F.when(low != 0, (high - low) / low).alias("spread"))


def failures(log: DataFrame, message: str) -> DataFrame:
    """Counts of JSON failure records by reason and status."""
    parsed = F.from_json(message, "event string, reason string, status int, ray string")
    return log.select(parsed.alias("f")).groupBy(F.col("f.reason").alias("reason"), F.col("f.status").alias("status")).agg(F.count("*").alias("failures"))


def request_reply(requests: DataFrame, replies: DataFrame, session: str, kind: str, at: str, seconds: int = REPLY_SECONDS) -> DataFrame:
    """requests with the first reply of their kind in time, and what became of them.

    A request waits for ``seconds`` or until the next request of its kind and
    session; a reply counts for the last request before it.  ``outcome`` is
    ``replied`` or ``timeout``; late replies count for nothing.  One sorted pass
    over each session's rows, no join of all pairs.
    """
    both = requests.select(session, kind, F.col(at).alias("t"), F.lit(0).alias("reply"), F.struct(*requests.columns).alias("request")).unionByName(
        replies.select(session, kind, F.col(at).alias("t"), F.lit(1).alias("reply"), F.lit(None).cast(requests.select(F.struct(*requests.columns)).schema[0].dataType).alias("request"))
    )
    after = Window.partitionBy(session, kind).orderBy("t", "reply")
    nxt = F.lead(F.struct("t", "reply")).over(after)
    # the next row of the session is the reply, unless another request came first
    answered = (nxt["reply"] == 1) & (nxt["t"] <= F.col("t") + F.expr(f"interval {seconds} seconds"))
    return both.withColumn("answered", answered).withColumn("reply_at", F.when(answered, nxt["t"])).where("reply = 0").select("request.*", "reply_at", F.when(F.col("answered"), "replied").otherwise("timeout").alias("outcome"))


def open_budget(events: DataFrame, session: str, order: str, reset: Column, refusal: Column) -> DataFrame:
    """events with ``refusals``: how many refusals since the session's last reset, this row included."""
    run = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    part = events.withColumn("reset_no", F.sum(reset.cast("int")).over(run))
    inside = Window.partitionBy(session, "reset_no").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return part.withColumn("refusals", F.sum(refusal.cast("int")).over(inside))
