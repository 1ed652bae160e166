"""Data-quality checks: each yields one verdict row; a check that fails to run is a failure."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions import any_of, hours_between

SCHEMA = "check_name string, dimension string, passed boolean, observed string, expected string"


def verdict(violations: DataFrame, name: str, dimension: str) -> DataFrame:
    """One row from a one-row count of violations, still lazy."""
    n = F.col(violations.columns[0])
    return violations.select(F.lit(name).alias("check_name"), F.lit(dimension).alias("dimension"), (n == 0).alias("passed"), n.cast("string").alias("observed"), F.lit("0").alias("expected"))


def equal(left: DataFrame, right: DataFrame, name: str, dimension: str) -> DataFrame:
    """Two one-row counts must agree."""
    a, b = left.toDF("_a"), right.toDF("_b")
    return a.join(F.broadcast(b)).select(F.lit(name).alias("check_name"), F.lit(dimension).alias("dimension"), F.col("_a").eqNullSafe(F.col("_b")).alias("passed"), F.col("_a").cast("string").alias("observed"), F.col("_b").cast("string").alias("expected"))


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return _count(df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))


def resolves(df: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no match."""
    return _count(df.join(table.select(F.col(key).alias(column)), column, "left_anti"))


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a null in one of the columns."""
    return _count(df.where(any_of(F.col(c).isNull() for c in columns)))


def within(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows outside a range; nulls are not outside."""
    return _count(df.where(~F.col(column).between(low, high)))


def censored_right(df: DataFrame, value: str, sentinel, flag: str | None = None) -> DataFrame:
    """Rows that are flagged and have a value, or hold the sentinel."""
    return _count(df.where((F.col(flag or f"{value}_is_topcoded") & F.col(value).isNotNull()) | (F.col(value) == sentinel)))


def disjoint(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of one table whose key the other has too."""
    return _count(left.join(right.select(key), key, "left_semi"))


def groups_start_at_one(df: DataFrame, group: str, seq: str) -> DataFrame:
    return _count(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(seq).alias("lo")).where("lo <> 1"))


def fresh(runs: DataFrame, finished: str, now, limit_hours: float = 168) -> DataFrame:
    """1 where the last run is older than the limit, or there is none."""
    age = hours_between(now, F.max(F.col(finished)))
    return runs.agg(F.when(age <= limit_hours, 0).otherwise(1).alias("n"))


class Suite:
    """Checks in order; each may raise without stopping the rest."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def expect_zero(self, name: str, dimension: str, violations: Callable[[], DataFrame]) -> None:
        self._run(name, dimension, lambda: verdict(violations(), name, dimension))

    def expect_equal(self, name: str, dimension: str, left: Callable[[], DataFrame], right: Callable[[], DataFrame]) -> None:
        self._run(name, dimension, lambda: equal(left(), right(), name, dimension))

    def _run(self, name: str, dimension: str, make: Callable[[], DataFrame]) -> None:
        try:
            self.rows.append(tuple(make().first()))
        except Exception as e:
            self.rows.append((name, dimension, False, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}", "0"))

    def result(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, SCHEMA)

    @property
    def passed(self) -> bool:
        return all(r[2] for r in self.rows)


def together(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def summary(verdicts: DataFrame) -> DataFrame:
    """dimension, n_checks, n_passed, pass_ratio."""
    out = verdicts.groupBy("dimension").agg(F.count("*").alias("n_checks"), F.count_if("passed").alias("n_passed"))
    return out.withColumn("pass_ratio", F.round(F.col("n_passed") / F.col("n_checks"), 4))
