"""Streaming forms: re-validation of newer snapshots, marks and budgets with state, and replies with timeouts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.window import Window

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def newest(snapshots: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key; rows that tie go by their own values."""
    value = F.struct(order, *[c for c in snapshots.columns if c != order])
    return snapshots.groupBy(key).agg(F.max(value).alias("s")).select(*[F.col("s")[c].alias(c) for c in snapshots.columns])


class _Newer(StatefulProcessor):
    """Keeps the order of a key's newest snapshot so far, and passes on the newest one of those that come after it."""

    def __init__(self, order: str, columns: list[str]) -> None:
        self.order, self.columns = order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:  # one row is held, however many come
            pdf = pdf[pdf[self.order].notna()]
            if len(pdf):
                top = pdf[pdf[self.order] == pdf[self.order].max()].sort_values(self.columns, na_position="first").iloc[-1:]
                if best is None or _place(top, self.order, self.columns) > _place(best, self.order, self.columns):
                    best = top
        if best is not None and not (self.seen.exists() and self.seen.get()[0] >= int(best[self.order].iloc[0])):
            self.seen.update((int(best[self.order].iloc[0]),))
            yield best[self.columns]

    def close(self) -> None:
        pass


def _place(row: pd.DataFrame, order: str, columns: list[str]) -> tuple:
    return (int(row[order].iloc[0]), [(pd.notna(x), str(x)) for x in row[columns].iloc[0]])


def newer_snapshots(snapshots: DataFrame, key: str = "workbook_id", order: str = "read_ts") -> DataFrame:
    """A stream of the snapshots that are newer than any that came in an earlier batch, one a key and batch.

    ``order`` is a whole number.  Snapshots that are as old or older, rows without
    order and all others of a key and batch are left out.  The session must use the
    RocksDB state store provider.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in snapshots.schema)
    return snapshots.groupBy(key).transformWithStateInPandas(_Newer(order, snapshots.columns), schema, "Append", "None")


def accepted(snapshots: DataFrame, batch: str, key: str = "workbook_id", order: str = "read_ts") -> DataFrame:
    """The batch twin of ``newer_snapshots``: key, batch and order of what each batch passes on.

    Each batch and key is pre-aggregated to its newest; of those a row stays if it is
    beyond the largest of its key's earlier batches.
    """
    per = snapshots.where(F.col(order).isNotNull()).groupBy(key, batch).agg(F.max(order).alias(order))
    before = F.max(order).over(Window.partitionBy(key).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(order) > F.col("_before"))).drop("_before")


def validate_stream(snapshots: DataFrame, check: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "workbook_id", order: str = "read_ts") -> StreamingQuery:
    """Check each key's snapshot afresh with a batch function whenever a newer one comes.

    Of each batch ``path`` gets the snapshots that were checked and what was found, in
    folders of the batch, and then a record that the batch is whole.  A batch that is
    run again writes the same folders again.  ``latest_results`` reads what holds now.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        at = lambda name: f"{path}/{name}/batch={number}"
        check(batch).write.mode("overwrite").parquet(at("results"))
        batch.select(key, order).write.mode("overwrite").parquet(at("checked"))
        batch.sparkSession.createDataFrame([(number,)], "batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/whole/{number}")
        batch.unpersist()

    return newer_snapshots(snapshots, key, order).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_results(spark: SparkSession, path: str, key: str = "workbook_id") -> DataFrame:
    """What was found about the newest snapshot of each key, of batches that were written whole.

    A key whose newest snapshot has no faults has no rows, whatever older ones had.
    """
    whole = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/whole").distinct()
    checked = spark.read.parquet(f"{path}/checked").join(whole, "batch", "left_semi")
    last = checked.groupBy(key).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/results").join(last, [key, "batch"], "left_semi").drop("batch")


class _InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, and takes them in order of time.

    Rows lie in a map by millisecond, with a timer each, so that a key's rows are read
    once however many wait.  Timers come in order; one that is set while others run may
    come a batch later, so all are set when a row arrives: for its time, and if ``wait``
    microseconds are given for its end of waiting.  ``take`` handles the rows of one
    millisecond, ``due`` what else is due by then; both give output rows.
    """

    names: list[str]
    types: dict[str, str] = {}
    wait = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list] = {}
        for pdf in rows:
            for us, *row in pdf[["us", *self.fields]].itertuples(index=False):
                new.setdefault(int(us) // 1000, []).append([int(us), *[None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in row]])
                if self.wait:
                    self.handle.registerTimer((int(us) + self.wait) // 1000 + 1)
        for ms, own in new.items():
            if self.waiting.containsKey((ms,)):
                own = json.loads(self.waiting.getValue((ms,))[0]) + own
            self.waiting.updateValue((ms,), (json.dumps(own),))
            self.handle.registerTimer(ms + 1)
        yield pd.DataFrame([], columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs() - 1
        out = []
        if self.waiting.containsKey((ms,)):
            out += self.take(key, sorted(json.loads(self.waiting.getValue((ms,))[0]), key=lambda r: [(x is not None, x) for x in r]))
            self.waiting.removeKey((ms,))
        out += self.due(key, ms)
        yield pd.DataFrame(out, columns=self.names).astype(self.types)

    def due(self, key, ms: int) -> list[tuple]:
        return []

    def close(self) -> None:
        pass


MARKS = "workbook_id string, seq long, action string, cell string"


class _Marks(_InOrder):
    """Keeps the marked cell of a workbook: a result clears it and may set another."""

    fields = ["seq", "cell"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.names = _names(MARKS)
        self.mark = handle.getValueState("mark", "cell string")

    def take(self, key, rows: list) -> list[tuple]:
        out = []
        for _, seq, cell in rows:
            if self.mark.exists():
                out.append((key[0], seq, "clear", self.mark.get()[0]))
                self.mark.clear()
            if cell is not None:
                out.append((key[0], seq, "set", cell))
                self.mark.update((cell,))
        return out


def marks_stream(results: DataFrame, late: str = "1 minute") -> DataFrame:
    """clear and set actions for results (workbook_id, ts, seq, cell; null cell: no problem).

    Rows wait until the watermark has passed them, so rows that come up to ``late``
    out of order, in whatever batches, give the actions of ``marks``.  The session must
    use the RocksDB state store provider.
    """
    rows = results.select("workbook_id", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long"), "cell").withWatermark("ts", late)
    return rows.groupBy("workbook_id").transformWithStateInPandas(_Marks(), MARKS, "Append", "EventTime")


def marks(results: DataFrame) -> DataFrame:
    """The batch twin of ``marks_stream``: a mark is cleared by its workbook's next result, in order of ts and seq."""
    order = [c for c in ("ts", "seq") if c in results.columns]
    before = F.lag("cell").over(Window.partitionBy("workbook_id").orderBy(*order))
    rows = results.withColumn("before", before)
    clear = rows.where("before is not null").select("workbook_id", "seq", F.lit("clear").alias("action"), F.col("before").alias("cell"))
    return clear.unionByName(rows.where("cell is not null").select("workbook_id", "seq", F.lit("set").alias("action"), "cell"))


REPLIES = "session string, kind string, sent_us long, reply_us long, outcome string"


class _Replies(_InOrder):
    """Keeps the one open request of a session and kind."""

    fields = ["reply"]
    types = {"sent_us": "Int64", "reply_us": "Int64"}

    def __init__(self, seconds: int) -> None:
        self.wait = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.names = _names(REPLIES)
        self.open = handle.getValueState("open", "us long")

    def take(self, key, rows: list) -> list[tuple]:
        out = []
        for us, reply in rows:
            if self.open.exists():
                sent = self.open.get()[0]
                met = bool(reply) and us <= sent + self.wait
                out.append((*key, sent, us if met else None, "replied" if met else "timeout"))
            if reply:
                self.open.clear()
            else:
                self.open.update((us,))
        return out

    def due(self, key, ms: int) -> list[tuple]:
        if not self.open.exists() or (self.open.get()[0] + self.wait) // 1000 > ms:
            return []
        sent = self.open.get()[0]
        self.open.clear()
        return [(*key, sent, None, "timeout")]


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def request_reply_stream(requests: DataFrame, replies: DataFrame, seconds: int, late: str = "1 minute") -> DataFrame:
    """The streaming twin of ``logs.request_reply``: one open request a session and kind.

    requests (session, kind, sent_ts) and replies (session, kind, reply_ts).  Rows
    wait until the watermark has passed them and are then taken in order of time, so
    a request is answered by the next row of its kind if that is a reply in time; a
    newer request or the end of the wait makes it a timeout, and a reply without an
    open request counts for nothing.  The session must use the RocksDB state store
    provider.
    """
    one = lambda df, at, reply: df.select("session", "kind", F.col(at).alias("ts"), F.unix_micros(at).alias("us"), F.lit(reply).alias("reply"))
    both = one(requests, "sent_ts", 0).unionByName(one(replies, "reply_ts", 1)).withWatermark("ts", late)
    made = both.groupBy("session", "kind").transformWithStateInPandas(_Replies(seconds), REPLIES, "Append", "EventTime")
    return made.select("session", "kind", F.timestamp_micros("sent_us").alias("sent_ts"), F.timestamp_micros("reply_us").alias("reply_ts"), "outcome")


class _Budget(StatefulProcessor):
    """Keeps a session's refusals since its last reset."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.refusals = handle.getValueState("refusals", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.refusals.get()[0] if self.refusals.exists() else 0
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            n = 0 if row.kind == "reset" else n + (row.kind == "refusal")
            out.append((key[0], row.seq, n))
        self.refusals.update((n,))
        yield pd.DataFrame(out, columns=["session", "seq", "refusals"])

    def close(self) -> None:
        pass


def budget_stream(events: DataFrame) -> DataFrame:
    """refusals since the last reset for events (session, seq, kind: reset, refusal or other)."""
    return events.groupBy("session").transformWithStateInPandas(_Budget(), "session string, seq long, refusals int", "Append", "None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
