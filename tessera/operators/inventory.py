"""Inventory of published files: areas, totals, limits and first-match rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import area_of, two_decimals

HOST_LIMIT = 25 * 1024 * 1024
#: Cache rules of a published bundle, in order; the first that fits holds.
CACHE_RULES = [
    ("/vendor/*", "public, max-age=31536000, immutable"),
    ("/project/assets/*", "public, max-age=31536000, immutable"),
    ("/project/system/*", "no-cache"),
    ("/project/src/*", "no-cache"),
    ("/fixtures/*", "no-cache"),
]


def area_totals(files: DataFrame, area: Column | None = None) -> DataFrame:
    """files, bytes and compressed bytes of each area, and of all (area ``total``)."""
    named = files.withColumn("area", area_of(F.col("path")) if area is None else area)
    return named.rollup("area").agg(F.grouping("area").alias("all"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("compressed_bytes").alias("compressed_bytes")).select(
        F.when(F.col("all") == 1, "total").otherwise(F.col("area")).alias("area"), "files", "bytes", "compressed_bytes"
    )


def mebibytes(size: Column) -> Column:
    return F.concat(two_decimals(size / (1024 * 1024)), F.lit(" MiB"))


def over_host_limit(files: DataFrame, limit: int = HOST_LIMIT) -> DataFrame:
    return files.where(F.col("bytes") > limit).select("path", "bytes", mebibytes(F.col("bytes")).alias("size"))


def first_rule(paths: DataFrame, rules: list[tuple[str, str]] = CACHE_RULES, otherwise: str | None = "no-cache", path: str = "path", name: str = "value") -> DataFrame:
    """paths with the value of the first rule that fits: a prefix ending in ``*``, or the whole path.

    The rules are a short list given by the caller; they become one expression.
    """
    out = F.lit(otherwise)
    for pattern, value in reversed(rules):
        fits = F.col(path).startswith(pattern[:-1]) if pattern.endswith("*") else F.col(path) == pattern
        out = F.when(fits, value).otherwise(out)
    return paths.withColumn(name, out)


def first_rule_by_table(paths: DataFrame, rules: DataFrame, otherwise: str | None = None, path: str = "path") -> DataFrame:
    """The same with rules (rule_no, pattern, value) in a table of any size.

    A path is looked up by an equi join, whole and by its beginnings of the lengths
    that rules have, so rules aren't tried one by one and a path is spread over at
    most as many rows as there are lengths; the lowest rule number of the matches wins.
    """
    body = F.when(F.col("pattern").endswith("*"), F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(F.col("pattern"))
    keyed = rules.select(body.alias("key"), F.col("pattern").endswith("*").alias("prefix"), "rule_no", "value")
    lengths = sorted(r[0] for r in keyed.where("prefix").select(F.length("key")).distinct().collect())  # bounded by the longest rule
    fitting = F.filter(F.lit(lengths) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(path))
    beginnings = F.transform(fitting, lambda n: F.struct(F.substring(F.col(path), F.lit(1), n).alias("key"), F.lit(True).alias("prefix")))
    keys = F.concat(F.array(F.struct(F.col(path).alias("key"), F.lit(False).alias("prefix"))), beginnings)
    hit = paths.select(path).distinct().select(path, F.explode(keys).alias("k")).select(path, "k.*").join(keyed, ["key", "prefix"])
    best = hit.groupBy(path).agg(F.min_by("value", "rule_no").alias("value"))
    return paths.join(best, path, "left").withColumn("value", F.coalesce("value", F.lit(otherwise)))


def list_differences(expected: DataFrame, present: DataFrame, name: str = "path") -> DataFrame:
    """Names missing from or unexpected in what is present, and names present more than once."""
    e, p = expected.select(name).distinct(), present.select(name).distinct()
    again = present.groupBy(name).count().where("count > 1").select(name, F.lit("repeated").alias("problem"))
    return e.join(p, name, "left_anti").withColumn("problem", F.lit("missing")).unionByName(p.join(e, name, "left_anti").withColumn("problem", F.lit("unexpected"))).unionByName(again)
