"""Declarative row rules: one scan yields every (row, reason) that fails."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Rows for which ``broken`` is true are refused with ``reason``; an unknown
    condition does not refuse. ``detail`` renders what was wrong."""

    reason: str
    broken: Column
    detail: Column


def shown(column: str) -> Column:
    """A value for a message: the text, or NULL."""
    return F.coalesce(F.col(column).cast("string"), F.lit("NULL"))


def labelled(**columns: str) -> Column:
    """``a = x, b = y``."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{label.replace('__', '.')} = "), shown(c)) for label, c in columns.items()))


def required(columns: dict[str, str], reason: str = "required_field_empty") -> Rule:
    """None of the columns (name: name in messages) may be null or blank."""
    blank = {label: F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c, label in columns.items()}
    listed = F.concat_ws(", ", *(F.when(b, F.lit(label)) for label, b in blank.items()))
    return Rule(reason, listed != "", F.concat(F.lit("empty: "), listed))


def rejects(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, reason and detail, one row for each rule that a row breaks."""
    hits = F.array_compact(F.array(*(F.when(r.broken, F.struct(F.lit(r.reason).alias("reason"), r.detail.alias("detail"))) for r in rules)))
    return df.select(*keep, F.explode(hits).alias("_r")).select(*keep, "_r.reason", "_r.detail")


def repeated_keys(df: DataFrame, key: str, reason: str = "duplicate_record_key") -> DataFrame:
    """key, reason, detail for keys that occur more than once."""
    n = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return n.select(key, F.lit(reason).alias("reason"), F.concat(F.lit(f"{key} staged "), F.col("n").cast("string"), F.lit(" times")).alias("detail"))


def reject_report(rejected: DataFrame) -> DataFrame:
    """reason, n_rows and an example, most frequent first."""
    return rejected.groupBy("reason").agg(F.count("*").alias("n_rows"), F.min("detail").alias("example")).orderBy(F.desc("n_rows"), "reason")


def quarantine(staged: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """The refused rows whole, once for each reason."""
    return rejected.select(key, "reason", "detail").join(staged, key)


def admissible(staged: DataFrame, rejected: DataFrame, loaded: DataFrame | None, key: str) -> DataFrame:
    """Rows that no rule refused and that are not loaded yet."""
    out = staged.join(rejected.select(key), key, "left_anti")
    return out if loaded is None else out.join(loaded.select(key), key, "left_anti")
