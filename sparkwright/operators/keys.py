"""Content keys, duplicate marking and surrogate numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.functions import content_hash, record_key
from sparkwright.sources.scratch import written


def with_record_key(df: DataFrame, columns: Sequence[str], order: str, null_token: str | None = None, name: str = "record_key") -> DataFrame:
    """``md5#n``: the md5 of the row's content and its occurrence in the given order."""
    hashed = df.withColumn("_hash", content_hash(columns, null_token=null_token))
    n = F.row_number().over(Window.partitionBy("_hash").orderBy(order))
    return hashed.withColumn(name, record_key("_hash", n)).drop("_hash")


def mark_duplicates(df: DataFrame, key: str, order: str, universe: DataFrame | None = None) -> DataFrame:
    """Adds duplicate_group_id and duplicate_seq: rows whose key occurs more than
    once in ``universe`` (itself by default) are numbered in their group; groups
    are numbered by their first row, ties by key, over ranges of them. Others get
    nulls. The group table has a row for each repeated key only."""
    pool = (df if universe is None else universe).select(F.col(key).alias("_key"), F.col(order).alias("_order"))
    groups = pool.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_order").alias("_first")).where("_n > 1")
    groups = number_globally(groups, ["_first", "_key"], "_number").select("_key", F.col("_number").cast("int").alias("duplicate_group_id"))
    joined = df.join(groups, df[key] == groups["_key"], "left").drop("_key")
    seq = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return joined.withColumn("duplicate_seq", F.when(F.col("duplicate_group_id").isNotNull(), seq.cast("int")))


def deduplicated(marked: DataFrame) -> DataFrame:
    return marked.where("duplicate_seq is null or duplicate_seq = 1")


def number_globally(df: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers from start + 1 in a total order, without one task for
    all rows: a range partitioning by the order, written once, numbers inside each
    partition, and the sizes of the partitions before it (one row a partition)."""
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_k")).select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_offset"))
    return ranged.withColumn("_within", within).join(offsets, "_part").withColumn(name, F.lit(start) + F.col("_offset") + F.col("_within")).drop("_part", "_within", "_offset")
