"""Bytes that a column scan reads, by a fixed width for each type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a value by type; texts have 2 and their UTF-8 length, nulls nothing.
WIDTHS = {"bigint": 8, "int": 8, "smallint": 8, "tinyint": 8, "double": 8, "float": 8, "date": 8, "timestamp": 8, "timestamp_ntz": 8, "boolean": 1}
BILLING_MINIMUM = 10 * 1024 * 1024


def scan_bytes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, bytes: all columns in one pass."""
    fields = [f for f in df.schema if columns is None or f.name in columns]
    aggs = []
    for i, f in enumerate(fields):
        kind = f.dataType.simpleString()
        if kind == "string":
            aggs.append(F.coalesce(F.sum(F.octet_length(f.name).cast("long") + 2), F.lit(0)).cast("long").alias(f"b{i}"))
        elif kind in WIDTHS:
            aggs.append((F.count(f.name) * WIDTHS[kind]).alias(f"b{i}"))
        else:
            raise ValueError(f"no width is known for {kind} ({f.name})")
    stack = ", ".join(f"'{f.name}', b{i}" for i, f in enumerate(fields))
    return df.agg(*aggs).selectExpr(f"stack({len(fields)}, {stack}) as (column_name, bytes)")


def billed(total: int) -> int:
    return max(total, BILLING_MINIMUM)


def human_bytes(n: float) -> str:
    """A count of bytes in the largest unit that leaves 1 or more, two decimals."""
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:,.0f} {unit}" if unit == "B" else f"{n:,.2f} {unit}"
        n /= 1024
    return f"{n:,.2f} TB"


def estimate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """scan, bytes, billed, shown: what the columns and all columns cost to scan; one pass."""
    one = F.when(F.col("column_name").isin(*columns), F.col("bytes")).otherwise(0)
    totals = scan_bytes(df).agg(F.sum(one).alias("some"), F.sum("bytes").alias("every"))
    rows = totals.selectExpr("stack(2, 'columns', some, 'all', every) as (scan, bytes)").withColumn("billed", F.greatest("bytes", F.lit(BILLING_MINIMUM)))
    shown = F.lit(None).cast("string")
    for power, unit in reversed(list(enumerate(("KB", "MB", "GB", "TB"), 1))):
        shown = F.coalesce(shown, F.when(F.col("bytes") >= 1024**power, F.concat(F.format_number(F.col("bytes") / 1024**power, 2), F.lit(f" {unit}"))))
    return rows.withColumn("shown", F.coalesce(shown, F.concat(F.format_number("bytes", 0), F.lit(" B"))))
