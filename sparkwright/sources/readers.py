"""Scans: text files, Parquet, inline rows, ranges, other databases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.sources.files import Files


def csv_text(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Every column as text, header checked by name where ``columns`` are given;
    a quoted empty field is null. Quoted fields may hold doubled quotes and line feeds: files that have
    such a field are read whole by one task each, others are split."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", has_quoted_breaks(spark, path))
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).option("enforceSchema", False)
    return reader.csv(path)


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a line ends inside quotes; one pass that stops at the first such line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


def csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def inline_values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def row_range(spark: SparkSession, n: int, name: str = "r") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", name)


def name_sorted(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """The files of a folder by name; each is a load of its own."""
    return [f"{folder.rstrip('/')}/{n}" for n in Files(spark, folder).names(folder) if n.endswith(suffix)]


def fingerprint(spark: SparkSession, path: str) -> tuple[str, int]:
    """SHA-256 and length of a file, computed where it is read."""
    row = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"), "length").first()
    return row["h"], row["length"]


def numbered_lines(df: DataFrame, name: str = "source_row") -> DataFrame:
    """Line numbers from 1 in file order, without a single-task window: rows are
    numbered inside their partition and shifted by the rows of those before (a window
    over one row a partition)."""
    marked = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("_part").agg(F.count("*").alias("_k")).select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return marked.join(starts, "_part").withColumn(name, number).drop("_id", "_part", "_start")


def jdbc_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query that another database runs; needs its driver on the class path."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def columns_like(df: DataFrame, *parts: str) -> list[str]:
    """Columns whose name holds one of the parts, in any case."""
    return [c for c in df.columns if any(p.lower() in c.lower() for p in parts)]


def schema_of(df: DataFrame) -> DataFrame:
    """name, type and position of each column, as rows."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")
