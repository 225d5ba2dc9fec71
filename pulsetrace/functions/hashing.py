"""Reproducible pseudo-random columns, equal in every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = 1 << 60


def hash60(seed: int, key: Column | str, salt: str = "") -> Column:
    """Whole number in [0, 2^60) from the seed and the key."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}|{salt}"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_uniform(seed: int, key: Column | str, salt: str = "") -> Column:
    """Double in [0, 1) from the first 32 bits of the hash."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}|{salt}"), key.cast("string"))
    bits = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return bits / F.lit(4294967296.0)
