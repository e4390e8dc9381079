"""The registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cellforge.llm import leaks, mixing, pii, sampling, seen, subset
from cellforge.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- problem 1: has this key been seen before?

_SEEN = (("shapes", ["dataset_id", "cells"], "record_id"), ("landmarks", ["dataset_id", "mask"], "landmark_id"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    parts = [seen.seen_before(table(spark, d, name), keys, order).select(F.lit(name).alias("tbl"), "*") for name, keys, order in _SEEN]
    return parts[0].unionByName(parts[1])


def _seen_sql(name: str, key: str, order: str) -> str:
    return f"""SELECT '{name}' AS tbl, {order} AS row_id, {order} > min({order}) OVER (PARTITION BY dataset_id, {key}) AS seen
    FROM {name} WHERE {key} IS NOT NULL AND dataset_id IS NOT NULL"""


_ALL_SEEN = _seen_sql("shapes", "cells", "record_id") + " UNION ALL " + _seen_sql("landmarks", "mask", "landmark_id")


@query("p1_found", f"SELECT tbl, row_id FROM ({_ALL_SEEN}) WHERE seen")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).where("seen").select("tbl", "row_id")


@query("p1_answers", _ALL_SEEN)
def p1_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every record with a key, and whether the key came before."""
    return _answers(spark, d)


@query("p1_batches", _seen_sql("shapes", "cells", "record_id"))
def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """The answers for shapes in two batches, of which the later finds the earlier one's keys in the stored index."""
    rows = table(spark, d, "shapes").select("record_id", "dataset_id", "cells")
    ends = rows.agg(F.min("record_id").alias("a"), F.max("record_id").alias("b")).first()
    half = ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    early, index = seen.seen_with(rows.where(F.col("record_id") <= half), ["dataset_id", "cells"], "record_id")
    late, _ = seen.seen_with(rows.where(F.col("record_id") > half), ["dataset_id", "cells"], "record_id", index)
    return early.unionByName(late).select(F.lit("shapes").alias("tbl"), "*")


def _wrong_sql(name: str, key: str, order: str) -> str:
    """Two ways to the answers, by window and by join with the least order, held against each other."""
    return f"""SELECT '{name}' AS tbl, count(*) AS n_rows, count(*) FILTER (a.seen) AS n_seen, count(*) FILTER (a.seen <> (a.row_id > f.first)) AS n_wrong,
    count(*) FILTER (a.seen <> (a.row_id > f.first)) / count(*) AS wrong_rate FROM ({_seen_sql(name, key, order)}) a JOIN {name} r ON r.{order} = a.row_id
    JOIN (SELECT dataset_id, {key}, min({order}) AS first FROM {name} GROUP BY ALL) f ON f.dataset_id = r.dataset_id AND f.{key} = r.{key}"""


@query("p1_error_rate", _wrong_sql("shapes", "cells", "record_id") + " UNION ALL " + _wrong_sql("landmarks", "mask", "landmark_id"))
def p1_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """The answers held against the truth, per table."""
    parts = []
    for name, keys, order in _SEEN:
        rows = table(spark, d, name)
        parts.append(seen.wrong_answers(seen.seen_before(rows, keys, order), rows, keys, order).select(F.lit(name).alias("tbl"), "n_rows", "n_seen", "n_wrong", "wrong_rate"))
    return parts[0].unionByName(parts[1])


# -- problem 3: samples with target shares

_NEEDS_SQL = """SELECT plan_id, dataset_id, max_dimension, has_hole, available, CASE WHEN min_rows > rows THEN min_rows ELSE rows END AS need FROM (
    SELECT t.*, coalesce(a.n, 0) AS available, CAST(ceil(sample_size * CASE share_unit WHEN 'fraction' THEN target_share
        WHEN 'percent' THEN target_share / 100 ELSE target_share / sum(target_share) OVER (PARTITION BY plan_id) END - 1e-9) AS BIGINT) AS rows
    FROM sample_targets t LEFT JOIN (SELECT dataset_id, max_dimension, has_hole, count(DISTINCT cells) AS n FROM shapes GROUP BY ALL) a
    USING (dataset_id, max_dimension, has_hole))"""


@query("p3_found", f"SELECT plan_id, max_dimension, CAST(has_hole AS INTEGER) AS has_hole FROM ({_NEEDS_SQL}) WHERE need > available")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = sampling.report(table(spark, d, "sample_targets"), table(spark, d, "shapes")).where("short")
    return found.select("plan_id", "max_dimension", F.col("has_hole").cast("int").alias("has_hole"))


@query("p3_report")
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Every category's target, what was available, and what the sample reaches."""
    return sampling.report(table(spark, d, "sample_targets"), table(spark, d, "shapes"))


@query("p3_gaps", f"SELECT plan_id, max_dimension, has_hole, need, available, greatest(need - available, 0) AS gap FROM ({_NEEDS_SQL})")
def p3_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What each category needs and has, and what the drawn sample lacks."""
    found = sampling.report(table(spark, d, "sample_targets"), table(spark, d, "shapes"))
    return found.select("plan_id", "max_dimension", "has_hole", "need", "available", "gap")


@query("p3_sample")
def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(table(spark, d, "sample_targets"), table(spark, d, "shapes"))


# -- problem 4: a varied subset


@query(
    "p4_found",
    """SELECT a.landmark_id FROM landmarks a JOIN landmarks b ON a.dataset_id = b.dataset_id AND a.landmark_id <> b.landmark_id
    AND bit_count(xor(a.mask, b.mask)) <= 2 GROUP BY a.landmark_id HAVING count(*) >= 8""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return subset.crowded(table(spark, d, "landmarks")).select("landmark_id").distinct()


@query("p4_subset")
def p4_subset(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of each export's landmarks."""
    return subset.varied(table(spark, d, "landmarks"))


@query(
    "p4_counts",
    """SELECT dataset_id, least(count(DISTINCT mask), CAST(ceil(count(*) / 10) AS BIGINT)) AS n_chosen, least(count(DISTINCT mask), CAST(ceil(count(*) / 10) AS BIGINT)) AS n_masks FROM landmarks
    WHERE dataset_id IS NOT NULL AND mask IS NOT NULL GROUP BY dataset_id""",
)
def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many landmarks each export's subset has, and how many different masks."""
    return subset.varied(table(spark, d, "landmarks")).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_chosen"), F.countDistinct("mask").alias("n_masks"))


# -- problem 7: evaluation texts in training text


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


@query("p7_leaks")
def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


@query("p7_items")
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item and how far it leaked."""
    return leaks.leaked_items(_leaks(spark, d), table(spark, d, "eval_items"))


# -- problem 8: mixing sources to target weights


def _mixing(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], DataFrame, mixing.Fit]:
    sized, known = mixing.measured(table(spark, d, "documents"))
    targets = table(spark, d, "mix_targets")
    return sized, known, targets, mixing.fitted(sized, known, targets)


#: Every case is clear by a wide margin, so the SQL may count code points in place of tokens.
_SHORT_SQL = """WITH d AS (SELECT replace(lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))), '-', '_') AS src, coalesce(length(text), 0) AS t FROM documents)
    SELECT mix_id, source FROM mix_targets m WHERE coalesce((SELECT sum(t) FROM d WHERE d.src = replace(lower(trim(m.source)), '-', '_')), 0) * max_uses < target_weight * (SELECT sum(t) FROM d)"""


@query("p8_found", _SHORT_SQL)
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mixing(spark, d)).where("short").select("mix_id", "source")


@query("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """The shares that every mix reaches."""
    return mixing.report(*_mixing(spark, d))


@query("p8_mix")
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every mix's documents and how often each is used."""
    sized, known, _, fit = _mixing(spark, d)
    return mixing.mix(sized, known, fit).drop("member")


# -- problem 9: personal information


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return pii.detected(documents).select("doc_id", "pii_type", "pii_text").distinct()


@query("p9_redacted")
def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text with placeholders."""
    documents = table(spark, d, "documents")
    return pii.detected(documents, redact=True)
