"""What several operators share: intermediate tables, Arrow plumbing, permutations."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: A key with more than this part of the rows of a table is heavy.
HEAVY = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is
    unset, a session on one machine (as in tests) has a local one; a cluster has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file:{tempfile.gettempdir()}/checkpoints"
    return root.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor costs no recomputation from the start) and
    gives the optimiser exact sizes for its choice of join."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stages/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_parts(k: str, total: int) -> Column:
    """Into how many parts of at most about a ``HEAVY``-th of all rows to cut a key with
    ``k`` of the ``total`` rows: 1 for all keys but fewer than ``HEAVY`` heavy ones."""
    return F.greatest(F.lit(1), F.ceil(F.col(k) * HEAVY / F.lit(max(total, 1)))).cast("int")


def with_parts(table: DataFrame, key: str, counts: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """``table`` with the parts of each row's key, and the table of heavy keys that this
    reads: of ``counts`` (key, k: its rows of ``total``) fewer than ``HEAVY``, at any
    size, so they may be broadcast."""
    hot = materialise(counts.where(F.col("k") * HEAVY > total).select(key, in_parts("k", total).alias("parts")), "heavy")
    return table.join(F.broadcast(hot), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))), hot


def spread_join(big: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join on ``key`` of tables that both carry ``parts``, the same for a key: the rows
    of ``big`` are dealt over the parts of their key by a hash of ``by``, rows of
    ``small`` go to each. The result keeps the parts."""
    left = big.withColumn("part", F.pmod(F.xxhash64(by), "parts").cast("int"))
    right = small.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.join(right, [key, "part"], how).drop("part")


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def over(batches):
        for batch in batches:
            if batch.num_rows:
                yield from rows(batch)

    return df.mapInArrow(over, schema)


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``most`` bytes of the text column; a longer row stands alone."""
    if batch.num_rows:
        for lo, hi in runs(strings(batch.column(text))[1], most, batch.num_rows):
            yield batch.slice(lo, hi - lo)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def runs(offsets: np.ndarray, most: int = 1 << 20, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes and ``rows`` rows each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield lo, min(hi, n)
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Feistel:
    """A seeded permutation of 0..n-1: a balanced Feistel network over the next
    even power of two, walked along its cycle until the value falls below n."""

    ROUNDS = 6

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = mix64(np.arange(1, self.ROUNDS + 1, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & MASK64))

    def _once(self, x: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << self.half) - 1)
        left, right = x >> np.uint64(self.half), x & low
        for key in self.keys:
            left, right = right, left ^ (mix64(right + key) & low)
        return (left << np.uint64(self.half)) | right

    def __call__(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._once(np.asarray(x, np.uint64))
            while len(todo := np.flatnonzero(out >= np.uint64(self.n))):
                out[todo] = self._once(out[todo])
        return out.astype(np.int64)
