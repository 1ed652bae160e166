"""Dimensions: reserved members, new members, and resolution of labels to keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of the reserved members.
UNKNOWN, NOT_APPLICABLE = -1, -2


@dataclass(frozen=True)
class Dimension:
    """A label column of the staged rows and its table ``<table>(<name>_sk, <name>, ...)``."""

    name: str
    marker: str | None = None  # a label that means "not answered"
    only: tuple[str, ...] = ()  # labels admitted; all if empty
    optional: bool = False  # unmatched labels fall to the unknown member
    flags: tuple[str, ...] = ()  # boolean columns of the table

    @property
    def key(self) -> str:
        return f"{self.name}_sk"


def new_members(staged: DataFrame, current: DataFrame, dim: Dimension) -> DataFrame:
    """Labels that the dimension lacks, with the next keys in label order. Present
    members keep theirs. One row a label, so one ordered window is small."""
    labels = staged.select(dim.name).where(F.col(dim.name).isNotNull())
    if dim.marker is not None:
        labels = labels.where(F.col(dim.name) != dim.marker)
    if dim.only:
        labels = labels.where(F.col(dim.name).isin(*dim.only))
    fresh = labels.distinct().join(current.select(dim.name), dim.name, "left_anti")
    top = current.where(F.col(dim.key) > 0).agg(F.coalesce(F.max(dim.key), F.lit(0)).alias("_top"))
    numbered = fresh.withColumn("_n", F.row_number().over(Window.orderBy(dim.name))).join(F.broadcast(top))
    return numbered.select((F.col("_top") + F.col("_n")).cast("int").alias(dim.key), dim.name, *(F.lit(False).alias(f) for f in dim.flags))


def members(labels: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """A dimension from nothing: key 1.. in label order, label."""
    distinct = labels.select(name).where(F.col(name).isNotNull()).distinct()
    return distinct.select(F.row_number().over(Window.orderBy(name)).cast("int").alias(key or f"{name}_sk"), name)


def resolve(df: DataFrame, dims: Sequence[tuple[Dimension, DataFrame]]) -> DataFrame:
    """Adds the key of each label: inner for mandatory dimensions, left with the
    unknown member for optional ones. Spark broadcasts a table that its size allows."""
    for dim, table in dims:
        found = table.select(dim.name, dim.key)
        if dim.optional:
            df = df.join(found, dim.name, "left").withColumn(dim.key, F.coalesce(dim.key, F.lit(UNKNOWN)))
        else:
            df = df.join(found, dim.name)
    return df


def unknown_or_not_applicable(label: str, marker: str, excused: Column, key: Column) -> Column:
    """The label's key; for the marker, not applicable where ``excused`` holds, else unknown."""
    return F.when(F.col(label) != marker, key).when(excused, F.lit(NOT_APPLICABLE)).otherwise(F.lit(UNKNOWN))
