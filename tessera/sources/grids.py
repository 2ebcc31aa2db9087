"""Sheet grids: JSON snapshots to one row a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unwrap(value: Column, depth: int = 2) -> Column:
    """The plain value of a cell: a formula's result, rich text joined, a link's text.

    Null becomes the empty text; other objects (dates) stay objects and are no text.
    Results may nest, to ``depth``.
    """
    out = value
    for _ in range(depth):
        out = F.coalesce(F.try_variant_get(out, "$.result", "variant"), out)
    runs = F.try_variant_get(out, "$.richText", "array<struct<text:string>>")
    joined = F.array_join(F.transform(runs, lambda x: F.coalesce(x["text"], F.lit(""))), "")
    text = F.coalesce(joined, F.when(F.schema_of_variant(out).startswith("OBJECT"), F.try_variant_get(out, "$.text", "string")))
    as_text = F.try_variant_get(F.parse_json(F.to_json(F.struct(text.alias("t")))), "$.t", "variant")
    blank = out.isNull() | F.is_variant_null(out)
    return F.when(blank, F.parse_json(F.lit('""'))).when(text.isNotNull(), as_text).otherwise(out)


def cells_of(snapshots: DataFrame, workbook: str = "$.spreadsheetName", grids: str = "$.grids") -> DataFrame:
    """cells (workbook_id, sheet, row, col, value VARIANT) of snapshots with a VARIANT column ``doc``."""
    spark = snapshots.sparkSession
    named = snapshots.select(F.try_variant_get("doc", workbook, "string").alias("workbook_id"), F.try_variant_get("doc", grids, "variant").alias("grids"))
    tabs = named.lateralJoin(spark.tvf.variant_explode(F.col("grids").outer())).select("workbook_id", F.col("key").alias("sheet"), F.col("value").alias("rows"))
    rows = tabs.lateralJoin(spark.tvf.variant_explode(F.col("rows").outer())).select("workbook_id", "sheet", (F.col("pos") + 1).alias("row"), F.col("value").alias("line"))
    cells = rows.lateralJoin(spark.tvf.variant_explode(F.col("line").outer())).select("workbook_id", "sheet", "row", (F.col("pos") + 1).alias("col"), F.col("value").alias("value"))
    return cells.withColumn("value", unwrap(F.col("value")))


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all JSON snapshots under a path, one document a file or a line."""
    return cells_of(spark.read.format("json").option("singleVariantColumn", "doc").option("multiLine", True).load(path))


def read_snapshot_stream(spark: SparkSession, path: str, order: str = "$.readAt", workbook: str = "$.spreadsheetName", files_a_batch: int | None = None) -> DataFrame:
    """A stream of workbook_id, read_ts and doc (JSON text) of snapshots as they arrive under a path, for ``validate_stream``."""
    reader = spark.readStream.schema("doc variant").format("json").option("singleVariantColumn", "doc").option("multiLine", True)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    doc = F.col("doc")
    return reader.load(path).select(F.try_variant_get(doc, workbook, "string").alias("workbook_id"), F.try_variant_get(doc, order, "long").alias("read_ts"), F.to_json(doc).alias("doc"))


def write_cells(cells: DataFrame, path: str) -> None:
    """Partitioned by tab, so that a reader of some tabs prunes the others."""
    cells.withColumn("value", F.to_json("value")).write.mode("overwrite").partitionBy("sheet").parquet(path)
