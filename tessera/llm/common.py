"""Helpers that several operators share: cutting lineage and text measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import clear, discard, session_dir, settle, shared_dir  # noqa: F401

#: A key of more than one in so many rows, and of so many rows at least, is split.
HOT_SHARE, HOT_ROWS = 1000, 10_000


def split_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, salt: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """``left`` joined on ``keys`` to ``right``, which has a row a key and in ``n`` its number of left rows.

    The rows of a hot key are dealt over several tasks by a hash of ``salt``, and
    its right row goes to each.  At most HOT_SHARE keys can be hot, so their list is
    bounded and broadcast.  Null keys never match.
    """
    if total is None:
        total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    most = max(total // HOT_SHARE, HOT_ROWS)
    copies = F.when(F.col(n) > most, F.ceil(F.col(n) / most)).otherwise(1).cast("int")
    hot = F.broadcast(right.where(F.col(n) > most).select(*keys, copies.alias("_copies")))
    dealt = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_copies").isNotNull(), F.pmod(F.xxhash64(*salt), F.col("_copies")).cast("int")).otherwise(0)).drop("_copies")
    met = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return dealt.join(met, [*keys, "_salt"], how).drop("_salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(text_bytes(text))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
