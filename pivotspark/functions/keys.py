"""Portable, seed-determined orderings and uniforms.

Random choice in this library is "order by a content hash": the same seed
and key always give the same order, on any partitioning and in any engine
that has md5 (DuckDB included), so sampled members are reproducible and
checkable.  ``hord(seed, key)`` = md5(concat_ws('|', seed, key)).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def hord(seed, *keys) -> Column:
    """Hex md5 of ``seed|key1|key2...``; sort by it for a seeded shuffle."""
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    parts = [first] + [_c(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def uniform01(seed, *keys) -> Column:
    """Uniform in [0, 1) from the first 8 hex digits of ``hord`` / 2**32."""
    h = hord(seed, *keys)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_bucket(seed, *keys, digits: int = 4) -> Column:
    """Leading ``digits`` hex characters of ``hord``: buckets that follow the
    hash order, used to rank by hash without a global window."""
    return F.substring(hord(seed, *keys), 1, digits)
