"""A warehouse of versioned Parquet tables.

A table is folders of immutable data and numbered manifests, each a list of the
folders that make a version. Every write puts its data into a new folder and then
adds a manifest, by one rename to a name that nobody had: a refresh lists the new
folder alone, an append the old ones as well. Readers take the highest manifest, so
they see the old table or the new one and need no lock, and a writer that dies at any
point leaves the table as it was. Of two writers at once the later one fails. Keys
and references, which Parquet does not enforce, are checked before a write.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.sources.files import Files


class ConstraintError(ValueError):
    """A write would break a declared constraint."""


class Warehouse:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = dict(schemas or {})
        self.files = Files(spark, root)

    # Catalog ------------------------------------------------------------------

    def tables(self, like: str = "%") -> list[str]:
        names = [n for n in self.files.names(self.root) if self.versions(n)]
        if like == "%" or not names:
            return names
        at = self.spark.createDataFrame([(n,) for n in names], "name string")
        return [r["name"] for r in at.where(F.col("name").like(like)).orderBy("name").collect()]

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def versions(self, name: str) -> list[int]:
        """The versions of a table, oldest first."""
        return sorted(int(n) for n in self.files.names(f"{self.root}/{name}/_manifests") if n.isdigit())

    def create(self, name: str, schema: str) -> None:
        """Declare a table; it is made, empty, only if it is not there yet."""
        self.schemas[name] = schema
        if not self.exists(name):
            self.overwrite(name, self.spark.createDataFrame([], schema))

    def drop(self, name: str) -> None:
        self.files.delete(f"{self.root}/{name}")

    def reset(self) -> None:
        for name in self.tables():
            self.drop(name)

    def view(self, *names: str) -> None:
        """Register current versions as temporary views."""
        for name in names or self.tables():
            self.read(name).createOrReplaceTempView(name)

    def counts(self) -> DataFrame:
        """table_name, n_rows of every table, as one query."""
        parts = [self.read(n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in self.tables()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "table_name string, n_rows long")

    def statistics(self, name: str) -> DataFrame:
        """column_name, n_values, n_distinct (approximate), with the table's rows and stored bytes; one pass."""
        df = self.read(name)
        aggs = [F.count("*").alias("rows")]
        for i, c in enumerate(df.columns):
            aggs += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}")]
        stack = ", ".join(f"'{c}', n{i}, d{i}" for i, c in enumerate(df.columns))
        out = df.agg(*aggs).selectExpr("rows", f"stack({len(df.columns)}, {stack}) as (column_name, n_values, n_distinct)")
        return out.withColumn("stored_bytes", F.lit(sum(map(self.files.size, self._folders(name)))))

    # Reading and writing ------------------------------------------------------

    def _folders(self, name: str, version: int | None = None) -> list[str]:
        version = self.versions(name)[-1] if version is None else version
        return [f"{self.root}/{name}/{f}" for f in self.files.read(f"{self.root}/{name}/_manifests/{version:09d}").split()]

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The current version, or an earlier one."""
        reader = self.spark.read
        if name in self.schemas:
            reader = reader.schema(self.schemas[name])
        return reader.parquet(*self._folders(name, version))

    def _add(self, name: str, df: DataFrame, before: list[str], version: int) -> None:
        folder = f"d{version:09d}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}/{folder}")
        self.files.write_new(f"{self.root}/{name}/_manifests/{version:09d}", "\n".join([*before, folder]))

    def overwrite(self, name: str, df: DataFrame) -> None:
        """The data, then a manifest that lists it alone: a full refresh that is never half seen."""
        self._add(name, df, [], max(self.versions(name), default=0) + 1)

    def append(self, name: str, df: DataFrame) -> None:
        """The data, then a manifest that lists it with what was there: seen whole or not
        at all. A frame that reads the table itself sees it as it was."""
        version = self.versions(name)[-1]
        before = [f.rpartition("/")[2] for f in self._folders(name, version)]
        self._add(name, df.select(*self.read(name, version).columns), before, version + 1)

    def append_absent(self, name: str, df: DataFrame, keys: Sequence[str]) -> None:
        """Append only rows whose key the table does not have."""
        self.append(name, df.join(self.read(name).select(*keys), list(keys), "left_anti"))

    def upsert(self, name: str, df: DataFrame, keys: Sequence[str]) -> None:
        """Rows replace those of the same key."""
        old = self.read(name)
        self.overwrite(name, old.join(df.select(*keys), list(keys), "left_anti").unionByName(df.select(*old.columns)))

    def latest(self, name: str, keys: Sequence[str], *order: str) -> DataFrame:
        """The last event of each key: how a log stands in for an update."""
        w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
        return self.read(name).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    # Constraints --------------------------------------------------------------

    def require(self, df: DataFrame, not_null: Sequence[str] = (), unique: Sequence[str] = (), references: Sequence[tuple[str, str, str]] = ()) -> None:
        """Raise unless the columns are not null, the key is unique and each
        (column, table, its column) resolves."""
        if not_null:
            bad = df.where(" or ".join(f"{c} is null" for c in not_null)).limit(1)
            if not bad.isEmpty():
                raise ConstraintError(f"null in {', '.join(not_null)}")
        if unique and not df.groupBy(*unique).count().where("count > 1").limit(1).isEmpty():
            raise ConstraintError(f"{', '.join(unique)} is not unique")
        for column, table, key in references:
            if not df.where(F.col(column).isNotNull()).join(self.read(table).select(F.col(key).alias(column)), column, "left_anti").limit(1).isEmpty():
                raise ConstraintError(f"{column} has no match in {table}.{key}")
