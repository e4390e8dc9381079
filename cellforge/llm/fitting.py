"""Bounded samples of rows for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hash of ``key``.

    A threshold on the hash, set from the row count, leaves little more than ``most`` rows in all splits together, so what
    reaches the driver doesn't grow with their number.
    """
    n = df.count()
    slots = 1 << 30
    least = min(slots, int(slots * (most + 6 * most**0.5 + 20) / max(1, n)) + 1)
    hashed = df.withColumn("__h", F.pmod(F.xxhash64(key), F.lit(slots)))
    return hashed.where(F.col("__h") < least).orderBy("__h", key).limit(most).drop("__h")
