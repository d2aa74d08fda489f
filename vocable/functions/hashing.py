"""Keyed, reproducible randomness.

Every random choice is a hash of ``seed | operator | key``.  The same value is
computable in SQL engines that have ``md5`` (the oracle uses it), it does not
depend on partitioning or row order, and two operators with different names do
not correlate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 2**52, the range of 13 hex digits of an md5 digest.
U52 = 4503599627370496.0


def _key(seed: int | str, op: str, *parts) -> Column:
    cols = [F.lit(str(seed)), F.lit(op)] + [p.cast("string") if isinstance(p, Column) else F.lit(str(p))
                                            for p in parts]
    return F.concat_ws("|", *cols)


def hash52(seed: int | str, op: str, *parts) -> Column:
    """Integer in [0, 2**52) from the first 13 hex digits of md5(seed|op|parts)."""
    return F.conv(F.substring(F.md5(_key(seed, op, *parts)), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int | str, op: str, *parts) -> Column:
    """Uniform double in [0, 1)."""
    return hash52(seed, op, *parts) / F.lit(U52)


def sql_hash52(seed, op: str, *parts: str) -> str:
    """DuckDB spelling of :func:`hash52` for the oracle SQL; parts are SQL expressions."""
    inner = " || '|' || ".join([f"'{seed}'", f"'{op}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(('0x' || substr(md5({inner}), 1, 13)) AS BIGINT)"


def sql_uniform(seed, op: str, *parts: str) -> str:
    return f"({sql_hash52(seed, op, *parts)} / 4503599627370496.0::DOUBLE)"
