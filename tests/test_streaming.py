import datetime
import json
import os
import random

from pyspark.sql import functions as F

from tessera.operators import contract, logs
from tessera.sources import grids
from tessera.streaming import state


def drained(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def in_batches(df, batches, path):
    """The rows of each batch as a file of its own, and a stream that reads one file a batch."""
    path.mkdir()
    for k, rows in enumerate(batches):
        one = df.sparkSession.createDataFrame(rows, df.schema).coalesce(1)
        one.write.mode("append").parquet(str(path))
        for f in path.glob("part-*.parquet"):
            f.rename(path / f"{k:03d}.parquet")
            os.utime(path / f"{k:03d}.parquet", (1_000_000 + k, 1_000_000 + k))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "*.parquet"))


def test_marks_stream_equals_batch_whatever_the_batches(spark, tmp_path):
    """Rows of a workbook come out of order and in different batches, two of one time among them; the last batch lets the watermark pass."""
    state.use_rocksdb(spark)
    rnd = random.Random(3)
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", at(1), 1, "c1"), ("a", at(2), 2, "c2"), ("a", at(2), 3, None), ("b", at(4), 4, None), ("b", at(5), 5, "c3")]
    rows += [(f"w{k % 3}", at(rnd.randrange(40)), k, rnd.choice([None, "x", "y", "z"])) for k in range(10, 90)]
    table = spark.createDataFrame(rows, "workbook_id string, ts timestamp, seq long, cell string")
    dealt = rows[:]
    rnd.shuffle(dealt)
    batches = [dealt[k::4] for k in range(4)] + [[("end", at(9999), 0, None)]]
    stream = state.marks_stream(in_batches(table, batches, tmp_path / "in"))
    got = sorted(map(tuple, drained(stream, "marks", tmp_path).collect()))
    assert got == sorted(map(tuple, state.marks(table).collect())) and len(got) > 80


def test_budget_stream_equals_batch(spark, tmp_path):
    state.use_rocksdb(spark)
    kinds = ["reset", "refusal", "refusal", "other", "reset", "refusal"]
    rows = spark.createDataFrame([("s", k, x) for k, x in enumerate(kinds)], "session string, seq long, kind string")
    rows.write.parquet(str(tmp_path / "in"))
    got = drained(state.budget_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "budget", tmp_path).orderBy("seq").collect()
    batch = logs.open_budget(rows, "session", "seq", F.col("kind") == "reset", F.col("kind") == "refusal").orderBy("seq").collect()
    assert [r.refusals for r in got] == [r.refusals for r in batch] == [0, 1, 2, 2, 0, 1]


def test_replies_stream_equals_batch(spark, tmp_path):
    """The worked cases, two requests before two replies among them, and random rows; last ones of another session let the watermark pass."""
    state.use_rocksdb(spark)
    rnd = random.Random(5)
    asks = [("s", "k", 0), ("s", "k", 600), ("s", "k", 7200), ("two", "k", 10), ("two", "k", 20), ("two", "other", 20)] + [("r", f"k{k % 3}", rnd.randrange(9000)) for k in range(80)]
    replies = [("s", "k", 30), ("s", "k", 720), ("s", "k", 10800), ("two", "k", 30), ("two", "k", 40), ("none", "k", 5)] + [("r", f"k{k % 3}", rnd.randrange(9000)) for k in range(80)]
    at = lambda name: F.timestamp_seconds(F.col("t") + 1_700_000_000).alias(name)
    table = lambda rows, name: spark.createDataFrame(sorted(set(rows)), "session string, kind string, t long").select("session", "kind", at(name))
    asked, replied = table(asks, "sent_ts"), table(replies, "reply_ts")
    batch = logs.request_reply(asked, replied.withColumnRenamed("reply_ts", "sent_ts"), "session", "kind", "sent_ts", 60)
    assert [r.outcome for r in batch.where("session = 's'").orderBy("sent_ts").collect()] == ["replied", "timeout", "timeout"]
    asked.write.parquet(str(tmp_path / "a"))
    replied.unionByName(table([("end", "k", 99_999)], "reply_ts")).write.parquet(str(tmp_path / "b"))
    read = lambda n, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / n))
    got = drained(state.request_reply_stream(read("a", asked), read("b", replied), 60), "replies", tmp_path)
    rows = lambda df, reply: sorted((r.session, r.kind, str(r.sent_ts), str(r[reply]), r.outcome) for r in df.collect())
    assert rows(got, "reply_ts") == rows(batch, "reply_at") and got.count() > 60


def missing(newest):
    cells = grids.cells_of(newest.select(F.parse_json("doc").alias("doc")))
    bad = contract.missing_tabs(cells, contract.contract_table(newest.sparkSession))
    return bad.select(F.col("subject").alias("workbook_id"), "rule", "path", "message")


def snapshot(book, read_ts, sheets):
    doc = {"spreadsheetName": book, "grids": {s: [[], [], [], contract.HEADERS[s]] for s in sheets}}
    return book, read_ts, json.dumps(doc)


SNAPSHOTS = [
    [snapshot("b", 20, ["Workbook", "Lessons"]), snapshot("b", 5, ["Workbook"]), snapshot("c", 7, list(contract.HEADERS)[:1]), snapshot("d", None, ["Workbook"])],
    [snapshot("b", 10, ["Workbook"]), snapshot("c", 8, list(contract.HEADERS))],  # an older one, and one without faults
    [snapshot("b", 20, ["Lessons"]), snapshot("c", 3, ["Workbook"])],  # as old, and older
    [snapshot("b", 30, list(contract.HEADERS)[:5])],
]


def test_an_older_snapshot_changes_nothing(spark, tmp_path):
    state.use_rocksdb(spark)
    frame = spark.createDataFrame([], "workbook_id string, read_ts long, doc string")
    after = []
    for n in (3, 4):
        stream = in_batches(frame, SNAPSHOTS[:n], tmp_path / f"in{n}")
        state.validate_stream(stream, missing, str(tmp_path / f"out{n}"), str(tmp_path / f"cp{n}")).awaitTermination(200)
        after.append({(r.workbook_id, r.path) for r in state.latest_results(spark, str(tmp_path / f"out{n}")).collect()})
    tabs = list(contract.HEADERS)
    assert after == [{("b", t) for t in tabs if t not in ("Workbook", "Lessons")}, {("b", tabs[5])}]
    rows = spark.createDataFrame([(*s, k) for k, b in enumerate(SNAPSHOTS) for s in b], "workbook_id string, read_ts long, doc string, batch long")
    passed = {(r.workbook_id, r.batch, r.read_ts) for r in state.accepted(rows, "batch").collect()}
    assert passed == {("b", 0, 20), ("c", 0, 7), ("c", 1, 8), ("b", 3, 30)}
    written = {(r.workbook_id, r.batch, r.read_ts) for r in spark.read.parquet(str(tmp_path / "out4" / "checked")).collect()}
    assert written == passed


def test_a_batch_run_again_leaves_the_same_files(spark, tmp_path):
    """The last batch's commit is taken away, as if the driver had been lost after writing; it runs again with the same number."""
    state.use_rocksdb(spark)
    frame = spark.createDataFrame([], "workbook_id string, read_ts long, doc string")
    stream = in_batches(frame, SNAPSHOTS, tmp_path / "in")
    out, cp = tmp_path / "out", tmp_path / "cp"
    state.validate_stream(stream, missing, str(out), str(cp)).awaitTermination(200)
    rows = lambda: sorted(map(str, spark.read.parquet(str(out / "results")).collect()))
    before, folders = rows(), sorted(p.name for p in (out / "results").glob("batch=*"))
    last = max(int(p.name) for p in (cp / "commits").iterdir() if p.name.isdigit())
    (cp / "commits" / str(last)).unlink()
    (cp / "commits" / f".{last}.crc").unlink(missing_ok=True)
    state.validate_stream(stream, missing, str(out), str(cp)).awaitTermination(200)
    assert rows() == before and sorted(p.name for p in (out / "results").glob("batch=*")) == folders


def test_a_stream_of_grids_feeds_the_validation(spark, tmp_path):
    state.use_rocksdb(spark)
    (tmp_path / "in").mkdir()
    for k, sheets in enumerate((["Workbook", "Lessons"], ["Workbook"])):
        book, read_ts, doc = snapshot("b", 9 - k, sheets)
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(json.loads(doc) | {"readAt": read_ts}))
        os.utime(tmp_path / "in" / f"{k}.json", (1_000_000 + k, 1_000_000 + k))
    stream = grids.read_snapshot_stream(spark, str(tmp_path / "in"), files_a_batch=1)
    state.validate_stream(stream, missing, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(200)
    got = {r.path for r in state.latest_results(spark, str(tmp_path / "out")).collect()}
    assert got == set(list(contract.HEADERS)[2:])
