"""Reproducible random numbers from MD5: the same in Spark and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: int | str, *parts: Column | str) -> Column:
    """Hexadecimal digest of the seed and the parts; a random order that no partitioning changes."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts)))


def hash_int(seed: int | str, *parts: Column | str) -> Column:
    """A number in 0 .. 2^32 - 1."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 8), 16, 10).cast("bigint")


def hash_unit(seed: int | str, *parts: Column | str) -> Column:
    """A number in [0, 1)."""
    return hash_int(seed, *parts) / F.lit(4294967296.0)
