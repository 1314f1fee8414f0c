"""Seeded, partition-independent hashing used by every sampling operator.

``h(seed, key)`` = the first 15 hex digits of md5("<seed>:<key>") read as a 60-bit
non-negative bigint. It depends only on the value, never on partitioning or input
order, so every draw is reproducible at any parallelism. DuckDB computes the same
value with ``('0x' || substr(md5(seed || ':' || key), 1, 15))::bigint``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
TWO_60 = float(1 << HASH_BITS)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def h(seed, key) -> Column:
    """60-bit seeded hash of ``key`` (any column castable to string)."""
    text = F.concat(_c(seed).cast("string"), F.lit(":"), _c(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def u(seed, key) -> Column:
    """Uniform [0, 1) draw: h / 2^60."""
    return h(seed, key) / F.lit(TWO_60)


def bucket(hash_col: Column, bits: int) -> Column:
    """Top ``bits`` bits of a 60-bit hash: an order-preserving coarse bucket."""
    return F.shiftright(hash_col, HASH_BITS - bits)


def sql_h(seed_sql: str, key_sql: str) -> str:
    """DuckDB text of ``h`` (used by the oracle)."""
    return (
        f"('0x' || substr(md5(CAST({seed_sql} AS VARCHAR) || ':' || CAST({key_sql} AS VARCHAR)), 1, 15))::BIGINT"
    )
