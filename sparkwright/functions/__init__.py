"""Expression helpers: casts, keys, buckets, sizes, durations."""

from sparkwright.functions.expressions import (
    any_of,
    byte_length,
    content_hash,
    freshness_state,
    hours_between,
    lenient_int,
    md5_bucket,
    record_key,
    round_to_int,
    share,
)

__all__ = [
    "any_of", "byte_length", "content_hash", "freshness_state", "hours_between", "lenient_int", "md5_bucket", "record_key", "round_to_int", "share",
]
