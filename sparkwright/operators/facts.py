"""Censored measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def censor(df: DataFrame, sentinels: dict[str, float]) -> DataFrame:
    """Each measure equal to its sentinel becomes null beside a flag <name>_is_topcoded."""
    flags = {f"{c}_is_topcoded": F.col(c) == s for c, s in sentinels.items()}
    values = {c: F.when(F.col(c) == s, None).otherwise(F.col(c)) for c, s in sentinels.items()}
    return df.withColumns(flags | values)


def uncensored(value: str, sentinel: float, flag: str | None = None) -> Column:
    """The measure with its sentinel put back."""
    return F.coalesce(F.col(value), F.when(F.col(flag or f"{value}_is_topcoded"), F.lit(sentinel)))
