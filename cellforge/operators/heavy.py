"""Per-key results when a few keys hold most rows (problem 2).

Keys with many rows are found with a frequent-items sketch, marked through a broadcast join and
aggregated in salted parts; all other keys take an ordinary shuffle; the two are united.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

_KEY, _SALT, _HOT = "__key_hash", "__salt", "__hot"


@dataclass(frozen=True)
class KeyStats:
    """What is wanted of each key: the row count, and per column its distinct values or its mean."""

    distinct: str
    mean: str


def heavy_keys(keyed: DataFrame, tracked: int = 4096, most: int = 256) -> DataFrame:
    """Hashes of the keys that hold many rows, at most ``most`` of them whatever the data.

    One pass with a mergeable frequent-items sketch of ``tracked`` counters. A key with more than
    3.5/``tracked`` of all rows is never missed; a key listed needlessly is only routed differently.
    """
    sketch = keyed.agg(F.expr(f"approx_top_k({_KEY}, {most}, {tracked})").alias("top"))
    total = F.aggregate("top", F.lit(0).cast("bigint"), lambda a, x: a + x["count"])
    # a key is worth the salted way when it has at least 1/most of the rows that the sketch kept
    return sketch.select(F.explode("top").alias("t"), total.alias("n")).where(F.col("t.count") * most >= F.col("n")).select(F.col("t.item").alias(_KEY))


def key_stats(df: DataFrame, keys: list[str], stats: KeyStats, *, salts: int = 32, tracked: int = 4096, most: int = 256) -> DataFrame:
    """Rows, distinct values of one column and mean of another, per key, evenly spread over tasks.

    Returns ``keys``, ``n_rows``, ``n_distinct``, ``mean_value``, ``hot`` (true where the key took
    the salted way). Nulls in a key form their own group, as in GROUP BY; null values count as rows
    but not as distinct values nor in the mean; a key with only null values has a null mean. Repeated
    rows count each time. An empty table gives an empty result. Other columns, whatever they are
    called, are not read.

    A hot key's rows are salted by the hash of the value whose distinct count is wanted, so each
    value falls into one salt and the parts' distinct counts add up. A single hot value is folded by
    map-side aggregation before the shuffle, since its (key, value) is a grouping key.
    """
    hot_set = heavy_keys(df.select(F.xxhash64(*keys).alias(_KEY)), tracked, most)
    cols = list(dict.fromkeys([*keys, stats.distinct, stats.mean]))
    # at most `most` rows by construction, so the broadcast is bounded
    marked = df.select(*cols, F.xxhash64(*keys).alias(_KEY)).join(F.broadcast(hot_set.withColumn(_HOT, F.lit(True))), _KEY, "left")

    def parts(part: DataFrame, by: list[str | Column]) -> DataFrame:
        names = [c if isinstance(c, str) else _SALT for c in by]
        values = part.groupBy(*by, F.col(stats.distinct).alias("__value")).agg(
            F.count(F.lit(1)).alias("__rows"), F.sum(F.col(stats.mean).cast("double")).alias("__sum"), F.count(stats.mean).alias("__n")
        )
        return values.groupBy(*names).agg(
            F.sum("__rows").alias("__rows"), F.count("__value").alias("__distinct"), F.sum("__sum").alias("__sum"), F.sum("__n").alias("__n")
        )

    salt = F.pmod(F.xxhash64(F.col(stats.distinct)), F.lit(salts)).alias(_SALT)
    hot = parts(marked.where(F.col(_HOT)), [*keys, salt]).groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in ("__rows", "__distinct", "__sum", "__n"))
    )
    rest = parts(marked.where(F.col(_HOT).isNull()), list(keys))
    whole = hot.withColumn("hot", F.lit(True)).unionByName(rest.withColumn("hot", F.lit(False)))
    return whole.select(
        *keys,
        F.col("__rows").alias("n_rows"),
        F.col("__distinct").alias("n_distinct"),
        F.when(F.col("__n") > 0, F.col("__sum") / F.col("__n")).alias("mean_value"),
        "hot",
    )


def hot_share(stats: DataFrame, keys: list[str], least: float, total: int) -> DataFrame:
    """The keys without nulls of ``key_stats`` that hold at least ``least`` of the ``total`` rows."""
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return stats.where(known & (F.col("n_rows") >= F.lit(least * total))).select(*keys, "n_rows")
