"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered 0..n-1 in the order of (id, size, checksum); the permuted number
p gives shard p % shards and slot p // shards, so that shard counts differ by one
at most, slots have no gaps, and any row's place can be computed from its number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.shared import Feistel, arrow_map, materialise


def number_rows(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``row_number`` from 0 in the given order (nulls first).

    The rows are range-partitioned and written once with their partition; the
    offsets of the partitions come from their counts (one row a partition), the
    numbers inside one from a window over it."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = materialise(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.count("*").alias("k")).select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return placed.withColumn("within", within).join(materialise(offsets, "offsets"), "part").withColumn("row_number", F.col("offset") + F.col("within")).drop("part", "within", "offset")


def shard(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, size (UTF-8 bytes of the text, plus 1), text_crc32,
    row_number, shard, slot.

    A null text counts as empty (size 1); ids may be null or repeat: rows that
    agree in id, size and checksum are interchangeable. Reruns agree."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered = materialise(number_rows(narrow, "id", "size", "text_crc32"), "numbered")
    total = numbered.count()
    shuffle = Feistel(max(total, 1), seed)

    def rows(batch: pa.RecordBatch):
        p = shuffle(batch.column(batch.schema.get_field_index("row_number")).to_numpy())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "size", "text_crc32", "row_number")), pa.array((p % shards).astype(np.int32)), pa.array(p // shards)],
            names=["id", "size", "text_crc32", "row_number", "shard", "slot"],
        )

    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    out = arrow_map(numbered, rows, f"id {kind}, size long, text_crc32 long, row_number long, shard int, slot long")
    return out.withColumnRenamed("id", id_col)
