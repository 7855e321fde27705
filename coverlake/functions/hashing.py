"""Order-free pseudo-random numbers from row keys.

``md5`` exists in Spark and DuckDB, so splits and draws built on it are
reproducible in both engines and independent of partitioning (unlike
``rand``/``randn`` or ``randomSplit``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlake.functions.quote import col

TWO32 = 4294967296.0


def key_string(*cols) -> Column:
    return F.concat_ws(":", *[col(c).cast("string") for c in cols])


def hash_uniform(seed, *key_cols, part: int = 0) -> Column:
    """Uniform in [0, 1) from hex digits ``8*part .. 8*part+7`` of
    md5(seed ':' key)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), key_string(*key_cols)))
    return F.conv(F.substring(h, 8 * part + 1, 8), 16, 10).cast("bigint") / TWO32


def hash_uniform_sql(seed, key_sql: str, part: int = 0) -> str:
    h = f"md5('{seed}' || ':' || {key_sql})"
    return f"(CAST(('0x' || substr({h}, {8 * part + 1}, 8)) AS BIGINT) / {TWO32!r})"


def hash_normal(seed, *key_cols) -> Column:
    """Standard normal by Box-Muller from two md5 uniforms (u1 in (0, 1])."""
    u1 = 1.0 - hash_uniform(seed, *key_cols, part=0)
    u2 = hash_uniform(seed, *key_cols, part=1)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)


def hash_normal_sql(seed, key_sql: str) -> str:
    u1 = f"(1.0 - {hash_uniform_sql(seed, key_sql, 0)})"
    u2 = hash_uniform_sql(seed, key_sql, 1)
    return f"(sqrt(-2.0*ln({u1}))*cos({2 * math.pi!r}*{u2}))"
