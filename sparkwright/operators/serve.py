"""Serving: flattened star, allocation query, segment mart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions import share


def flatten(fact: DataFrame, dims: Sequence[tuple[DataFrame, str]], columns: Sequence[str | Column]) -> DataFrame:
    """The fact with labels for keys. Only the dimensions given are read: an inner
    join that nothing uses is not dropped by the optimiser."""
    for table, key in dims:
        fact = fact.join(table, key)
    return fact.select(*columns)


def allocation(pool: DataFrame, segment: Sequence[str], means: dict[str, tuple[str, int]], censored: Column, sparse_below: int = 30) -> DataFrame:
    """candidates, rounded means, censored_rows and a note for each segment, largest first."""
    n = F.count("*")
    aggs = [n.alias("candidates"), *(F.round(F.avg(c), p).alias(name) for name, (c, p) in means.items()), F.count_if(censored).alias("censored_rows")]
    out = pool.groupBy(*segment).agg(*aggs)
    note = F.when(F.col("candidates") < sparse_below, F.lit("too thin to fund"))
    return out.withColumn("note", note).orderBy(F.desc("candidates"), *segment)


def segment_mart(pool: DataFrame, segment: Sequence[str], measures: dict[str, str], not_assignable: Column, sparse_below: int = 30) -> DataFrame:
    """One row a segment: candidates, pct_of_eligible_pool, mean and measured-on
    count of each measure (label: column), segment_is_sparse, is_assignable. The
    pool's size is the sum over the segments, so the pool is read once."""
    aggs = [F.count("*").cast("int").alias("candidates")]
    for label, c in measures.items():
        aggs += [F.avg(c).alias(f"mean_{label}"), F.count(c).cast("int").alias(f"{label}_measured_on")]
    grouped = pool.groupBy(*segment).agg(*aggs, F.max(not_assignable).alias("_bar"))
    total = grouped.agg(F.sum("candidates").alias("_total"))
    return (
        grouped.join(F.broadcast(total))
        .withColumn("pct_of_eligible_pool", share(F.col("candidates"), F.col("_total")))
        .withColumn("segment_is_sparse", F.col("candidates") < sparse_below)
        .withColumn("is_assignable", ~F.col("_bar"))
        .drop("_bar", "_total")
    )


def tiles(mart: DataFrame) -> DataFrame:
    """pool, actionable, sparse_segments, unassignable: sums over a mart in one pass."""
    n = F.col("candidates").cast("long")
    return mart.agg(
        F.sum(n).alias("pool"), F.sum(F.when(~F.col("segment_is_sparse") & F.col("is_assignable"), n).otherwise(0)).alias("actionable"),
        F.count_if("segment_is_sparse").alias("sparse_segments"), F.sum(F.when(~F.col("is_assignable"), n).otherwise(0)).alias("unassignable"),
    )


def filtered(mart: DataFrame, within: dict[str, Sequence] | None = None, hide_sparse: bool = False, assignable_only: bool = False) -> DataFrame:
    """A mart under optional filters; an empty choice filters nothing."""
    for column, values in (within or {}).items():
        if values:
            mart = mart.where(F.col(column).isin(*values))
    if hide_sparse:
        mart = mart.where(~F.col("segment_is_sparse"))
    if assignable_only:
        mart = mart.where("is_assignable")
    return mart


def flag_labels(mart: DataFrame) -> DataFrame:
    """Adds flags: the warnings of a segment as one text."""
    listed = F.concat_ws(", ", F.when(F.col("segment_is_sparse"), "sparse"), F.when(~F.col("is_assignable"), "not assignable"))
    return mart.withColumn("flags", F.when(listed == "", "ok").otherwise(listed))
