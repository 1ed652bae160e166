"""Column expressions with semantics that agree across engines."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
#: Largest whole number that the kind holds.
_RANGE = {"short": 2**15 - 1, "int": 2**31 - 1, "long": 2**63 - 1}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lenient_int(text: Column | str, kind: str = "int") -> Column:
    """Whole number in a text, fractions rounded half away from zero and exponents
    read; null for anything else. ``1_000`` and ``0x1F`` are not numbers here."""
    text = _col(text)
    plain = F.trim(text).try_cast(kind)
    value = F.round(F.when(text.rlike(_NUMERIC), text.try_cast("double")))
    fits = (value >= -float(_RANGE[kind]) - 1) & (value <= float(_RANGE[kind]))
    return F.coalesce(plain, F.when(fits, value.try_cast(kind)))


def round_to_int(number: Column | str, kind: str = "short") -> Column:
    """A double as a whole number, halves to the even neighbour; null out of range."""
    return F.bround(_col(number), 0).try_cast(kind)


def content_hash(columns: Iterable[str], separator: str = "|", null_token: str | None = None) -> Column:
    """md5 of the columns joined as text. Nulls are skipped, as concat_ws does;
    give ``null_token`` to keep their places apart."""
    cells = [_col(c).cast("string") for c in columns]
    if null_token is not None:
        cells = [F.coalesce(c, F.lit(null_token)) for c in cells]
    return F.md5(F.concat_ws(separator, *cells).cast("binary"))


def record_key(hash_col: Column | str, occurrence: Column | str) -> Column:
    """``hash#n``."""
    return F.concat(_col(hash_col), F.lit("#"), _col(occurrence).cast("string"))


def md5_bucket(key: Column | str, buckets: int = 100) -> Column:
    """A bucket 0..buckets-1 from the first 32 bits of the key's md5; the same in any engine."""
    return (F.conv(F.substring(F.md5(_col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def byte_length(text: Column | str) -> Column:
    return F.octet_length(_col(text))


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    """Hours as a double, to the microsecond."""
    micros = lambda c: F.unix_micros(_col(c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def freshness_state(hours: Column | str, fresh_below: float = 24, stale_from: float = 168) -> Column:
    """fresh, ageing or stale by age in hours; null where the age is not known."""
    hours = _col(hours)
    return F.when(hours < fresh_below, "fresh").when(hours < stale_from, "ageing").when(hours.isNotNull(), "stale")


def share(count: Column, total: Column, places: int = 4) -> Column:
    """Percentage of a total as a double."""
    return F.round(F.try_divide(F.lit(100.0) * count.cast("double"), total.cast("double")), places)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)
