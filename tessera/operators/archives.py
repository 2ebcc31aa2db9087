"""Packing of named files into size-bounded archives, and what archives measure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import base64_size, safe_folder
from tessera.sources.shared import settle

#: Bytes of an archive's headers, and the budget's floor.
ENTRY_HEADER, DIRECTORY_HEADER, ARCHIVE_END = 30, 46, 22
FLOOR_BYTES = 256 * 1024
SHEET_LIMIT, PDF_LIMIT = 20 * 1024 * 1024, 32 * 1024 * 1024


def entry_metrics(files: DataFrame) -> DataFrame:
    """name, raw_bytes and crc of files (name, content BINARY); nameless rows are rejected."""
    return files.where(F.col("name").isNotNull() & (F.col("name") != "") & F.col("content").isNotNull()).select("name", F.octet_length("content").cast("long").alias("raw_bytes"), F.crc32("content").alias("crc"))


def next_fit(sizes: np.ndarray, budget: int, held: int, n: int) -> tuple[np.ndarray, int, int]:
    """How many archives were closed before each entry, and what the open one then holds; one jump an archive."""
    no = np.zeros(len(sizes), np.int64)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    at, closed = 0, 0
    while at < len(sizes):
        # entries at .. end - 1 go into the open archive; an entry always fits an empty one
        end = int(np.searchsorted(sums, sums[at] + budget - held, "right")) - 1
        end = max(end, at + (n == 0))
        end = min(end, len(sizes))
        no[at:end] = closed
        held, n = held + int(sums[end] - sums[at]), n + end - at
        at = end
        if at < len(sizes):
            closed, held, n = closed + 1, 0, 0
    return no, held, n


def transfer(sizes: np.ndarray, budget: int) -> dict:
    """What a stretch of entries makes of the archive that is open before it.

    ``alone_*``: archives closed and bytes then held if the stretch starts an archive.
    Otherwise the open archive takes the entries that fit its room; ``room`` holds the
    least rooms, rising, from which on ``closed`` and ``held`` follow for the rest.
    Starts from which the same follows are one, so the arrays are short unless sizes
    are all alike, and never longer than the entries of one archive.
    """
    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    every = np.arange(n)
    after = np.maximum(np.searchsorted(sums, sums[:-1] + budget, "right") - 1, every + 1)
    closed = (after < n).astype(np.int64)
    to = np.where(after < n, after, every)  # the start of the next archive; the last one stays
    while (to[to] != to).any():
        closed, to = closed + closed[to], to[to]
    held = sums[-1] - sums[to]
    starts = every[: np.searchsorted(sums[:-1], budget, "right")]
    starts = starts[np.append(sums[starts[1:]] != sums[starts[:-1]], True)]  # of equal rooms the last entry that fits counts
    other = np.append(True, (closed[starts[1:]] != closed[starts[:-1]]) | (held[starts[1:]] != held[starts[:-1]]))
    starts = starts[other]
    return {"total": int(sums[-1]), "alone_closed": int(closed[0]), "alone_held": int(held[0]), "room": sums[starts], "closed": closed[starts], "held": held[starts]}


def carried(row, budget: int, held: int, n: int) -> tuple[int, int]:
    """Archives closed in a stretch (a row of ``transfer``) that is entered with so many bytes and entries held, and what is held after it."""
    if n == 0:
        return row.alone_closed, row.alone_held
    room = budget - held
    if row.total <= room:
        return 0, held + row.total
    if room < 0:
        return 1 + row.alone_closed, row.alone_held
    k = int(np.searchsorted(row.room, room, "right")) - 1
    return 1 + int(row.closed[k]), int(row.held[k])


def _runs(pdf: pd.DataFrame) -> Iterator[tuple[str, int, int]]:
    """Each build of a batch with its first row and the row after its last."""
    build = pdf["_build"].to_numpy()
    cuts = [0, *(np.flatnonzero(build[1:] != build[:-1]) + 1).tolist(), len(pdf)]
    return ((build[a], a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def pack(entries: DataFrame, budget: int, keys: list[str] = ("build_id",), order: list[str] = ("seq",), size: str = "packed_bytes") -> DataFrame:
    """entries with ``archive_no`` (from 0): next-fit in the order given.

    An archive is closed when it holds an entry and the next would exceed the
    budget; an entry over the budget stands alone.  Null keys are a build of their
    own; a null size counts as 0.

    Entries are dealt by ranges of (keys, order), so a large build is cut into
    segments.  Each segment's ``transfer`` is computed by itself; one short pass over
    those, in order, gives what each segment is entered with; then all segments are
    packed side by side.  No task holds a whole build.
    """
    keys, order, columns = list(keys), list(order), entries.columns
    build = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = settle(entries.repartitionByRange(*keys, *order).withColumn("_segment", F.spark_partition_id()), "pack-segments")
    parts = 1 + (rows.agg(F.max("_segment")).first()[0] or 0)
    amount = F.coalesce(F.col(size).cast("long"), F.lit(0))

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumns({"_build": build, "_size": amount}).repartitionById(parts, F.col("_segment")).sortWithinPartitions("_segment", *keys, *order)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row: the first build's transfer, and how the last one ends if it is another."""
        segment, first, last, own, state = None, None, None, [], (0, 0, 0)
        for pdf in frames:
            for name, a, b in _runs(pdf):
                segment, first = int(pdf["_segment"].iloc[a]), name if segment is None else first
                sizes = pdf["_size"].to_numpy(np.int64)[a:b]
                if name == first:
                    own.append(sizes)
                else:
                    no, held, n = state if name == last else (0, 0, 0)
                    closed, held, n = next_fit(sizes, budget, held, n)
                    state = no + int(closed[-1]), held, n
                last = name
        if segment is not None:
            yield pd.DataFrame([{"_segment": segment, "first": first, "last": last, **transfer(np.concatenate(own), budget), "last_no": state[0], "last_held": state[1]}])

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        build, no, held, n = None, 0, 0, 0
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                if row.first != build:
                    no, held, n = 0, 0, 0
                out.append((row[0], no, held, n))
                build = row.last
                if row.last != row.first:
                    no, held, n = row.last_no, row.last_held, 1
                else:
                    closed, held = carried(row, budget, held, n)
                    no, n = no + closed, 1
            yield pd.DataFrame(out, columns=["_segment", "_no", "_held", "_n"])

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, no, held, n = None, 0, 0, 0
        for pdf in frames:
            out = np.zeros(len(pdf), np.int64)
            for name, a, b in _runs(pdf):
                if last is None:
                    no, held, n = (int(pdf[c].iloc[a]) for c in ("_no", "_held", "_n"))
                elif name != last:
                    no, held, n = 0, 0, 0
                own, held, n = next_fit(pdf["_size"].to_numpy(np.int64)[a:b], budget, held, n)
                out[a:b] = no + own
                no, last = int(out[b - 1]), name
            yield pdf[columns].assign(archive_no=out.astype(np.int32))

    measured = dealt(rows.select("_segment", *dict.fromkeys([*keys, *order, size]))).mapInPandas(measure, "_segment int, first string, last string, total long, alone_closed long, alone_held long, room array<long>, closed array<long>, held array<long>, last_no long, last_held long")
    entered = measured.repartition(1).sortWithinPartitions("_segment").mapInPandas(chain, "_segment int, _no long, _held long, _n int")
    kinds = dict(entries.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in entries.columns) + ", archive_no int"
    # one row a segment: as many as there are shuffle partitions
    return dealt(rows.join(F.broadcast(entered), "_segment")).mapInPandas(number, schema)


def first_archives(packed: DataFrame, limit: int) -> DataFrame:
    return packed.where(F.col("archive_no") < limit)


def laddered_budget(budget: Column, refusals: Column, floor: int = FLOOR_BYTES) -> Column:
    """The budget after so many refusals: halved each time, never under the floor."""
    return F.greatest(F.lit(floor).cast("long"), F.floor(budget / F.pow(F.lit(2), refusals)).cast("long"))


def gives_up(files_in_archive: Column, budget: Column, floor: int = FLOOR_BYTES) -> Column:
    """A refusal can't be answered by a smaller budget: one file, or the floor."""
    return (files_in_archive <= 1) | (budget <= floor)


def archive_offsets(packed: DataFrame, keys: list[str], order: list[str], name: str = "name", size: str = "packed_bytes") -> DataFrame:
    """Byte offset of each entry in its archive, start of the directory, and total size."""
    own = F.octet_length(name) + ENTRY_HEADER + F.col(size)
    by = Window.partitionBy(*keys)
    start = F.col("directory_start")
    return packed.withColumns({
        "offset": F.coalesce(F.sum(own).over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
        "directory_start": F.sum(own).over(by).cast("long"),
    }).withColumn("archive_bytes", (start + F.sum(F.octet_length(name) + DIRECTORY_HEADER).over(by) + ARCHIVE_END).cast("long"))


def byte_totals(entries: DataFrame, keys: list[str]) -> DataFrame:
    """files, raw, packed and wire bytes of each key, and the packed share of the raw bytes."""
    return entries.groupBy(*keys).agg(
        F.count("*").alias("files"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("packed_bytes").alias("packed_bytes"), F.sum(base64_size(F.col("packed_bytes"))).alias("wire_bytes"),
        (F.sum("packed_bytes") / F.sum("raw_bytes")).alias("share"),
    )


def pdf_names(files: DataFrame) -> DataFrame:
    return files.where(F.col("name").rlike(r"(?i)\.pdf$"))


def without_pdfs(files: DataFrame, keys: list[str]) -> DataFrame:
    """Keys none of whose files is a PDF: nothing could be delivered for them."""
    return files.groupBy(*keys).agg(F.count_if(F.col("name").rlike(r"(?i)\.pdf$")).alias("pdfs")).where("pdfs = 0").select(*keys)


def delivery_differences(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Names that are missing, unexpected or of other bytes; both sides have name, bytes and digest."""
    both = expected.select("name", F.col("bytes").alias("e_bytes"), F.col("digest").alias("e_digest"), F.lit(True).alias("e")).join(got.select("name", F.col("bytes").alias("g_bytes"), F.col("digest").alias("g_digest"), F.lit(True).alias("g")), "name", "full")
    problem = F.when(F.col("g").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(~(F.col("e_bytes").eqNullSafe(F.col("g_bytes")) & F.col("e_digest").eqNullSafe(F.col("g_digest"))), "different")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def over_limit(files: DataFrame, size: Column, limit: Column) -> DataFrame:
    """Files larger than what their kind may be; the limit itself is accepted."""
    return files.where(size > limit)


def build_path(root: str, title: Column, sheet: Column, at: Column, zone: str) -> Column:
    """root / book title (or sheet name) / local time stamp."""
    named = F.coalesce(F.nullif(F.trim(title), F.lit("")), sheet)
    return F.concat_ws("/", F.lit(root), safe_folder(named), F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH-mm-ss"))
