"""Deterministic ids and hash-derived uniform numbers.

``md5`` hex prefixes convert to the same integers in Spark and DuckDB, so
splits, samples and bucket ids are reproducible and checkable by SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash32(seed, c) -> Column:
    """Unsigned 32-bit integer from ``md5(seed ':' value)`` (bigint)."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), _c(c).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def hash32_sql(seed, expr: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


def hash_unit(seed, c) -> Column:
    """Uniform double in [0, 1) from the value and a seed."""
    return hash32(seed, c) / F.lit(TWO_32)


def hash_unit_sql(seed, expr: str) -> str:
    return f"({hash32_sql(seed, expr)} / 4294967296.0)"


def make_entry_id(*parts) -> Column:
    """Reproducible entry id: md5 over ':'-joined parts (model, text, time, seq)."""
    return F.md5(F.concat_ws(":", *[_c(p).cast("string") for p in parts]))
