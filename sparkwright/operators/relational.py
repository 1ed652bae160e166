"""Small relational operators: top-k, comparison, replication, profiling of values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nulls_last(*columns: str) -> list[Column]:
    """Ascending order with nulls last; a leading minus means descending."""
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in columns]


def top(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of a total order (one pass, n rows a task)."""
    return df.orderBy(*nulls_last(*order)).limit(n)


def differences(left: DataFrame, right: DataFrame, places: int = 4) -> DataFrame:
    """Rows of one side that the other lacks, with multiplicity; doubles rounded.
    Empty when both hold the same rows in any order."""
    tidy = lambda df: df.select(*(F.round(f.name, places).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema))
    a, b = tidy(left), tidy(right.select(*left.columns))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def replicate(df: DataFrame, times: int, changes: dict[str, str] | None = None, name: str = "copy") -> DataFrame:
    """Each row ``times`` times with its copy number, some columns replaced by
    expressions that may use it; a generator, so no join and no shuffle."""
    out = df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return out.withColumns({c: F.expr(e) for c, e in (changes or {}).items()})


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), list(on), "left_anti")


def labelled_counts(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """measure, records: one row a labelled relation."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("records")).select(F.lit(label).alias("measure"), "records") for label, df in parts))


def counted(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """measure, records: the rows of each condition, all in one pass."""
    counts = df.agg(*(F.count_if(c).alias(f"n{i}") for i, c in enumerate(measures.values())))
    stack = ", ".join(f"'{label}', n{i}" for i, label in enumerate(measures))
    return counts.selectExpr(f"stack({len(measures)}, {stack}) as (measure, records)")


def marker_counts(df: DataFrame, marker: str, columns: Sequence[str]) -> DataFrame:
    """column_name, marked, missing: cells equal to a marker and null cells, in one pass."""
    both = df.agg(*(F.count_if(F.col(c) == marker).alias(f"m{i}") for i, c in enumerate(columns)), *(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)))
    stack = ", ".join(f"'{c}', m{i}, n{i}" for i, c in enumerate(columns))
    return both.selectExpr(f"stack({len(columns)}, {stack}) as (column_name, marked, missing)")


def co_missing(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """both, only_a, only_b, neither: counts of two conditions together."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return df.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


def describe(df: DataFrame, columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """column_name, n, mean, std, min, q25, q50, q75, max, in one pass. Exact quartiles
    hold the distinct values of a column in one task; with ``accuracy`` they are
    approximate (rank error 1 / accuracy) and take bounded memory at any size."""
    cuts = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    quartiles = lambda x: F.percentile(x, cuts) if accuracy is None else F.percentile_approx(x, cuts, accuracy)
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [F.count(c).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"), quartiles(x).alias(f"q{i}"), F.max(x).alias(f"max{i}")]
    stack = ", ".join(f"'{c}', n{i}, mean{i}, std{i}, min{i}, q{i}[0], q{i}[1], q{i}[2], max{i}" for i, c in enumerate(columns))
    return df.agg(*aggs).selectExpr(f"stack({len(columns)}, {stack}) as (column_name, n, mean, std, min, q25, q50, q75, max)")


def gap_below(df: DataFrame, column: str, sentinel: float) -> DataFrame:
    """The largest value below a sentinel and its distance to it."""
    below = F.max(F.when(F.col(column) < sentinel, F.col(column)))
    return df.agg(below.alias("largest_below")).withColumn("gap", F.lit(sentinel) - F.col("largest_below"))


def mode_ties(df: DataFrame, column: str) -> DataFrame:
    """All values of the highest count."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("n"))
    return counts.join(F.broadcast(most), "n").select(column, "n")
