"""One schema for everything that a check can find, and how findings are ranked.

Every check gives rows (subject, rank, rule, path, message).  ``rank`` orders the
findings of a subject as an inspector reading from the start would meet them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["subject", "rank", "rule", "path", "message"]


def found(df: DataFrame, subject: Column, where: Column, rank: list[Column], rule: str, path: Column, message: Column) -> DataFrame:
    """Violation rows of ``df`` for the rows where a check fails.

    ``rank`` parts are long numbers, compared from the left; missing parts count as 0.
    """
    parts = [x.cast("long") for x in rank] + [F.lit(0).cast("long")] * (6 - len(rank))
    return df.where(where).select(subject.cast("string").alias("subject"), F.array(*parts).alias("rank"), F.lit(rule).alias("rule"), path.alias("path"), message.alias("message"))


def together(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def first_violation(violations: DataFrame) -> DataFrame:
    """What a reader who stops at the first problem would report, for each subject.

    A pre-aggregated minimum, so a subject with very many findings costs one row a task.
    """
    best = F.min(F.struct("rank", "rule", "path", "message"))
    return violations.groupBy("subject").agg(best.alias("v"), F.count("*").alias("violations")).select("subject", "v.*", "violations")


def without(df: DataFrame, key: str, violations: DataFrame) -> DataFrame:
    """Rows of subjects that no check found anything about."""
    bad = violations.select(F.col("subject").alias("bad")).distinct()
    return df.join(bad, df[key].cast("string") == bad["bad"], "left_anti")
