"""Tables written once to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only on a local master, where that may be unset, a temporary folder is made and
    set for the session; elsewhere that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie; ``clear`` deletes it."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage like ``checkpoint()``, survives lost executors, and
    keeps the columnar form, so that later reads prune columns.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


#: Rows that a user's rule table may have where each task holds it whole.
MOST_RULES = 10_000


def small(table: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """``table``, or an error if it has more than ``most`` rows: tasks are given it whole."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"a rule table may have {most} rows")
    return table


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this application wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(settled: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    discard_path(settled.sparkSession, settled.settled_at)


def clear(spark: SparkSession) -> None:
    """Delete all settled tables of this application; results that read them must have been written."""
    discard_path(spark, session_dir(spark))
