"""Feature rows: group norms, bands, ratios, and a group-aware split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions import md5_bucket


def norms(df: DataFrame, by: str, medians: dict[str, str]) -> DataFrame:
    """Exact medians (name: column) of each group; halves lie half-way."""
    return df.groupBy(by).agg(*(F.median(c).alias(name) for name, c in medians.items()))


def band(value: Column | str, cuts: Sequence[tuple[float, str]], above: str, missing: str) -> Column:
    """The label of the first cut above the value."""
    value = F.col(value) if isinstance(value, str) else value
    out = F.when(value.isNull(), missing)
    for cut, label in cuts:
        out = out.when(value < cut, label)
    return out.otherwise(above)


def split(group: Column, row_id: Column, target: Column, train: int = 60, validate: int = 20) -> Column:
    """train, validate or test: rows of one group and target stay together."""
    bucket = md5_bucket(F.concat(F.coalesce(group.cast("string"), row_id.cast("string")), target.cast("string")))
    return F.when(bucket < train, "train").when(bucket < train + validate, "validate").otherwise("test")


def straddlers(df: DataFrame, group: str, split_col: str = "split") -> DataFrame:
    """Groups with rows in more than one split."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(split_col).alias("n_splits")).where("n_splits > 1")


def drift(df: DataFrame, target: str, split_col: str = "split") -> DataFrame:
    """split, n_rows, rate, and the rate's distance from that of all rows: one pass,
    the whole from the totals of the splits (a window over one row a split)."""
    y = F.col(target).cast("int")
    parts = df.groupBy(split_col).agg(F.count("*").alias("n_rows"), F.sum(y).alias("_s"), F.count(y).alias("_n"))
    every, rate = Window.partitionBy(), F.try_divide(F.col("_s"), F.col("_n"))
    overall = F.try_divide(F.sum("_s").over(every), F.sum("_n").over(every))
    return parts.select(split_col, "n_rows", rate.alias("rate"), F.abs(rate - overall).alias("deviation"))


def rate_by_band(df: DataFrame, banded: Column, target: Column, name: str = "band") -> DataFrame:
    """band, n_rows, rate of the target."""
    return df.groupBy(banded.alias(name)).agg(F.count("*").alias("n_rows"), F.avg(target.cast("int")).alias("rate"))
