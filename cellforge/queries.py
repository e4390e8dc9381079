"""The registered queries of the core, and their SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cellforge.functions import geometry as g, render, wide
from cellforge.operators import drift, heavy, shapes as sh, tablediff
from cellforge.session import cut, own_dir, table
from cellforge.sources import packed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- problem 2: a few keys holding most records

_STREAM_KEY = ["max_dimension", "has_hole"]


def _stream_stats(spark: SparkSession, d: str) -> DataFrame:
    return heavy.key_stats(table(spark, d, "shapes"), _STREAM_KEY, heavy.KeyStats("cells", "size"))


@query(
    "p2_found",
    """SELECT max_dimension, CAST(has_hole AS INTEGER) AS has_hole FROM shapes
    WHERE max_dimension IS NOT NULL AND has_hole IS NOT NULL GROUP BY ALL
    HAVING count(*) >= 0.05 * (SELECT count(*) FROM shapes)""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    hot = heavy.hot_share(_stream_stats(spark, d), _STREAM_KEY, 0.05, table(spark, d, "shapes").count())
    return hot.select("max_dimension", F.col("has_hole").cast("int").alias("has_hole"))


@query(
    "p2_key_stats",
    """SELECT max_dimension, has_hole, count(*) AS n_rows, count(DISTINCT cells) AS n_distinct, avg(size) AS mean_value
    FROM shapes GROUP BY max_dimension, has_hole""",
)
def p2_key_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stream_stats(spark, d).drop("hot")


# -- problem 5: differences between two copies

_STREAM_COLUMNS = {
    "dataset_id": tablediff.as_is,
    "stream_path": tablediff.as_path,
    "max_dimension": tablediff.as_is,
    "has_hole": tablediff.as_is,
    "record_count": tablediff.as_number,
}
_POLY_COLUMNS = {c: tablediff.as_is for c in ("dataset_id", "cells", "w", "h", "size")}


def _both_diffs(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, key, columns in (("streams", "stream_id", _STREAM_COLUMNS), ("polys", "poly_id", _POLY_COLUMNS)):
        found = tablediff.table_diff(table(spark, d, name), table(spark, d, f"{name}_mirror"), key, columns)
        parts.append(found.select(F.lit(name).alias("tbl"), "*"))
    return parts[0].unionByName(parts[1])


def _diff_sql(tbl: str, key: str, columns: dict[str, str]) -> str:
    fields = "\n".join(
        f"UNION ALL SELECT '{tbl}', a.{key}, '{c}' FROM a_{tbl} a JOIN b_{tbl} b USING ({key}) WHERE a.{c} IS DISTINCT FROM b.{c}" for c in columns
    )
    return f"""SELECT '{tbl}' AS tbl, {key} AS row_key, 'missing_in_mirror' AS diff FROM a_{tbl} WHERE {key} NOT IN (SELECT {key} FROM b_{tbl})
    UNION ALL SELECT '{tbl}', {key}, 'missing_in_primary' FROM b_{tbl} WHERE {key} NOT IN (SELECT {key} FROM a_{tbl})
    {fields}"""


def _side_sql(alias: str, tbl: str, key: str, columns: dict[str, str]) -> str:
    return f"{alias} AS (SELECT DISTINCT {key}, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {tbl})"


_STREAM_SQL = {
    "dataset_id": "dataset_id",
    "stream_path": "replace(stream_path, '\\', '/')",
    "max_dimension": "max_dimension",
    "has_hole": "has_hole",
    "record_count": "CAST(replace(replace(trim(record_count), ',', ''), '+', '') AS DECIMAL(38,6))",
}
_POLY_SQL = {"dataset_id": "dataset_id", "cells": "cells", "w": "CAST(w AS BIGINT)", "h": "CAST(h AS BIGINT)", "size": "CAST(size AS BIGINT)"}


_SIDES_SQL = "WITH " + ",\n".join(
    (
        _side_sql("a_streams", "streams", "stream_id", _STREAM_SQL),
        _side_sql("b_streams", "streams_mirror", "stream_id", _STREAM_SQL),
        _side_sql("a_polys", "polys", "poly_id", _POLY_SQL),
        _side_sql("b_polys", "polys_mirror", "poly_id", _POLY_SQL),
    )
)


@query(
    "p5_found",
    _SIDES_SQL
    + "\n"
    + _diff_sql("streams", "stream_id", _STREAM_SQL)
    + "\nUNION ALL "
    + _diff_sql("polys", "poly_id", _POLY_SQL),
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _both_diffs(spark, d).select("tbl", "row_key", "diff").where("row_key is not null")


def _cells_sql(tbl: str, key: str, columns: dict[str, str]) -> str:
    """The lines of ``_diff_sql`` with the values of fields that need no notation of their own; for paths and counts only whether they are there."""
    plain = lambda c, side: f"CASE WHEN {side}.{c} IS NULL THEN NULL ELSE 'given' END" if c in ("stream_path", "record_count") else f"CAST({side}.{c} AS VARCHAR)"
    fields = "\n".join(
        f"UNION ALL SELECT '{tbl}', a.{key}, '{c}', {plain(c, 'a')}, {plain(c, 'b')} FROM a_{tbl} a JOIN b_{tbl} b USING ({key}) WHERE a.{c} IS DISTINCT FROM b.{c}" for c in columns
    )
    return f"""SELECT '{tbl}' AS tbl, {key} AS row_key, 'missing_in_mirror' AS diff, CAST(NULL AS VARCHAR) AS primary_value, CAST(NULL AS VARCHAR) AS mirror_value FROM a_{tbl}
    WHERE {key} NOT IN (SELECT {key} FROM b_{tbl})
    UNION ALL SELECT '{tbl}', {key}, 'missing_in_primary', NULL, NULL FROM b_{tbl} WHERE {key} NOT IN (SELECT {key} FROM a_{tbl})
    {fields}"""


@query("p5_values", _SIDES_SQL + "\n" + _cells_sql("streams", "stream_id", _STREAM_SQL) + "\nUNION ALL " + _cells_sql("polys", "poly_id", _POLY_SQL))
def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """``p5_cells`` with no more than 'given' for paths and counts, whose notation SQL doesn't share."""
    told = lambda c: F.when(F.col("diff").isin("stream_path", "record_count") & F.col(c).isNotNull(), "given").otherwise(F.col(c)).alias(c)
    return _both_diffs(spark, d).where("row_key is not null").select("tbl", "row_key", "diff", told("primary_value"), told("mirror_value"))


@query("p5_cells")
def p5_cells(spark: SparkSession, d: str) -> DataFrame:
    """The same with the two values of each differing field."""
    return _both_diffs(spark, d)


# -- problem 6: schemas that drift between files


def _manifest_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "manifests").select("file_id", "series_id", "dataset_id", "written_at", "received_at", "body"))


#: The names that carry a field in these tables, letters only. The SQL needs them; the operator finds them.
_NAMES = {
    "format_version": ("formatversion", "manifestversion", "version"),
    "encoding": ("encoding", "cellsencoding", "encodingname", "maskencoding"),
    "record_bytes": ("recordbytes", "bytesperrecord"),
    "stride": ("stride", "rowstride", "stridecells"),
}
_KEYS_SQL = f"""WITH ok AS (SELECT * FROM (SELECT *, trim(body, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS b FROM manifests) WHERE b <> '' AND json_valid(b)),
leaf AS (SELECT file_id, replace(substr(j.fullkey, 3), '"', '') AS name, lower(regexp_replace(j.key, '[^A-Za-z]', '', 'g')) AS letters, CASE j.type WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool'
    WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'int' END AS kind, CASE j.type WHEN 'OBJECT' THEN j.value->>'$.name' WHEN 'ARRAY' THEN j.value->>'$[0]' ELSE j.value->>'$' END AS value
    FROM ok, json_tree(ok.b) j WHERE j.key IS NOT NULL AND j.type <> 'NULL'),
hit AS (SELECT file_id, name, kind, value, CASE {" ".join(f"WHEN letters IN {names} THEN '{field}'" for field, names in _NAMES.items())} END AS field_name FROM leaf),
grid AS (SELECT ok.file_id, series_id, written_at, f.field_name FROM ok, (VALUES {", ".join(f"('{x}')" for x in _NAMES)}) f(field_name)),
pair AS (SELECT g.*, name, kind, lag(name) OVER w AS name0, lag(kind) OVER w AS kind0, row_number() OVER w > 1 AS follows FROM grid g LEFT JOIN hit USING (file_id, field_name)
    WINDOW w AS (PARTITION BY series_id, g.field_name ORDER BY written_at, file_id)),
change AS (SELECT * FROM pair, (VALUES ('added'), ('removed'), ('renamed'), ('retyped')) k(change_kind) WHERE follows AND CASE change_kind WHEN 'added' THEN name0 IS NULL AND name IS NOT NULL
    WHEN 'removed' THEN name0 IS NOT NULL AND name IS NULL WHEN 'renamed' THEN name0 <> name ELSE kind0 <> kind END)"""


@query("p6_found", _KEYS_SQL + " SELECT file_id, field_name, change_kind FROM change")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = drift.changes(_manifest_table(spark, d), "series_id", ["written_at", "file_id"])
    return found.select("file_id", "field_name", "change_kind").distinct()


def _held_sql(field: str) -> str:
    value = f"max(value) FILTER (field_name = '{field}')"
    cast = value if field == "encoding" else f"try_cast(try_cast(trim({value}) AS DOUBLE) AS INTEGER)"
    return f"{cast} AS {field}, max(name) FILTER (field_name = '{field}') AS {field}_key, max(kind) FILTER (field_name = '{field}') AS {field}_kind"


@query(
    "p6_table",
    _KEYS_SQL + f" SELECT ok.file_id, series_id, dataset_id, written_at, received_at, {', '.join(_held_sql(x) for x in _NAMES)} FROM ok LEFT JOIN hit USING (file_id) GROUP BY ALL",
)
def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """All readable manifests in one table, the four fields in one type each."""
    return _manifest_table(spark, d)


@query("p6_changes", _KEYS_SQL + " SELECT series_id, written_at, file_id, field_name, change_kind, name0 AS key_before, name AS key_after, kind0 AS kind_before, kind AS kind_after FROM change")
def p6_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every change with the keys and types before and after."""
    return drift.changes(cut(_manifest_table(spark, d)), "series_id", ["written_at", "file_id"])


# -- shapes: geometry of every record

#: The cells of every record, and their place in the tight box.
_BITS = """WITH bits AS (SELECT {id} AS id, i // 8 AS r, i % 8 AS c FROM {tbl}, range(64) t(i) WHERE ({mask} >> i) & 1 = 1),
box AS (SELECT id, min(r) AS r0, min(c) AS c0, CAST(max(r) - min(r) + 1 AS INTEGER) AS h, CAST(max(c) - min(c) + 1 AS INTEGER) AS w, count(*) AS n FROM bits GROUP BY id),
norm AS (SELECT id, r - r0 AS r, c - c0 AS c, w, h, n FROM bits JOIN box USING (id)),
turns AS (SELECT id, w, h, n, sum(CAST(1 AS HUGEINT) << CAST(8 * r + c AS INTEGER)) AS m0, sum(CAST(1 AS HUGEINT) << CAST(8 * c + h - 1 - r AS INTEGER)) AS m1,
    sum(CAST(1 AS HUGEINT) << CAST(8 * (h - 1 - r) + w - 1 - c AS INTEGER)) AS m2, sum(CAST(1 AS HUGEINT) << CAST(8 * (w - 1 - c) + r AS INTEGER)) AS m3 FROM norm GROUP BY ALL)
"""
_EULER = """, corners AS (SELECT id, count(*) AS v FROM (SELECT DISTINCT id, r + dr AS y, c + dc AS x FROM bits, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc)) GROUP BY id),
edges AS (SELECT id, count(*) AS e FROM (SELECT DISTINCT id, k, r + dr AS y, c + dc AS x FROM bits, (VALUES (0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 0, 1)) d(k, dr, dc)) GROUP BY id),
chi AS (SELECT id, CAST(v - e + n AS INTEGER) AS chi FROM corners JOIN edges USING (id) JOIN box USING (id))
"""
_SIGNED = "CAST(CASE WHEN {0} >= 9223372036854775808 THEN {0} - 18446744073709551616 ELSE {0} END AS BIGINT)"


def _bits(tbl: str = "shapes", row: str = "record_id", mask: str = "cells") -> str:
    return _BITS.format(tbl=tbl, id=row, mask=mask)


def _masks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shapes").select("record_id", "dataset_id", F.col("cells").alias("mask")).where("mask is not null")


@query("shape_box", _bits() + "SELECT id AS record_id, w, h, CAST(n AS INTEGER) AS size FROM box")
def shape_box(spark: SparkSession, d: str) -> DataFrame:
    return g.with_box(_masks(spark, d).where("mask <> 0")).select("record_id", "w", "h", g.size(F.col("mask")).alias("size"))


@query(
    "shape_turns",
    _bits() + "SELECT id AS record_id, " + ", ".join(f"{_SIGNED.format(m)} AS {n}" for m, n in (("m0", "normal"), ("m1", "m90"), ("m2", "m180"), ("m3", "m270"), ("least(m0, m1, m2, m3)", "canonical"))) + " FROM turns",
)
def shape_turns(spark: SparkSession, d: str) -> DataFrame:
    return g.with_canonical(_masks(spark, d).where("mask <> 0")).select("record_id", "normal", "m90", "m180", "m270", "canonical")


@query(
    "shape_symmetry",
    _bits()
    + """SELECT id AS record_id, w = h AND m0 = m1 AS s90, m0 = m2 AS s180, CASE WHEN w = h AND m0 = m1 THEN 1 WHEN m0 = m2 THEN 2 ELSE 4 END AS weight,
    greatest(w, h) AS max_dim, m0 = least(m0, m1, m2, m3) AS is_canonical FROM turns""",
)
def shape_symmetry(spark: SparkSession, d: str) -> DataFrame:
    shaped = g.with_canonical(_masks(spark, d).where("mask <> 0"))
    return shaped.select("record_id", "s90", "s180", "weight", "max_dim", (F.col("normal") == F.col("canonical")).alias("is_canonical"))


@query("shape_euler", _bits() + _EULER + "SELECT id AS record_id, chi, 1 - chi AS holes FROM chi")
def shape_euler(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("mask")
    return _masks(spark, d).where("mask <> 0").select("record_id", g.euler(m).alias("chi"), g.holes(m).alias("holes"))


_SIDES4 = "(VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(dr, dc)"
#: The cells reached from one of them, and the empty places reached from outside the box, each shape once however often it is logged.
_FLOODS = f""", shape AS (SELECT DISTINCT ON (m0) id AS rep, m0, w, h, n FROM turns),
cell AS (SELECT rep, r, c FROM shape JOIN norm ON id = rep),
inside AS (SELECT rep, min(r * 1000 + c) // 1000 AS r, min(r * 1000 + c) % 1000 AS c FROM cell GROUP BY rep UNION
    SELECT i.rep, b.r, b.c FROM inside i CROSS JOIN {_SIDES4} JOIN cell b ON b.rep = i.rep AND b.r = i.r + dr AND b.c = i.c + dc),
free AS (SELECT rep, y.r, x.c FROM shape, range(-1, 9) y(r), range(-1, 9) x(c) WHERE y.r <= h AND x.c <= w AND NOT EXISTS (SELECT 1 FROM cell k WHERE k.rep = shape.rep AND k.r = y.r AND k.c = x.c)),
outside AS (SELECT rep, CAST(-1 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS c FROM shape UNION
    SELECT o.rep, f.r, f.c FROM outside o CROSS JOIN {_SIDES4} JOIN free f ON f.rep = o.rep AND f.r = o.r + dr AND f.c = o.c + dc),
flood AS (SELECT s.m0, i.k = s.n AS connected, o.k < f.k AS holed FROM shape s JOIN (SELECT rep, count(*) AS k FROM inside GROUP BY rep) i USING (rep)
    JOIN (SELECT rep, count(*) AS k FROM outside GROUP BY rep) o USING (rep) JOIN (SELECT rep, count(*) AS k FROM free GROUP BY rep) f USING (rep))
"""


@query("shape_holes", _bits().replace("WITH ", "WITH RECURSIVE ", 1) + _FLOODS + "SELECT t.id AS record_id, connected, holed AS has_hole FROM turns t JOIN flood USING (m0)")
def shape_holes(spark: SparkSession, d: str) -> DataFrame:
    """Connectivity and holes by flooding, in the SQL as well."""
    m = F.col("mask")
    return _masks(spark, d).where("mask <> 0").select("record_id", g.connected(m).alias("connected"), g.has_hole_by_flood(m).alias("has_hole"))


@query(
    "shape_frontier",
    _bits()
    + """, around AS (SELECT DISTINCT id, r + dr AS r, c + dc AS c FROM bits, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(dr, dc) WHERE r + dr BETWEEN 0 AND 7 AND c + dc BETWEEN 0 AND 7)
    SELECT id AS record_id, CAST(count(*) AS INTEGER) AS n_open FROM around ANTI JOIN bits USING (id, r, c) GROUP BY id""",
)
def shape_frontier(spark: SparkSession, d: str) -> DataFrame:
    """How many empty neighbours a shape has within the 8 x 8 board."""
    found = _masks(spark, d).where("mask <> 0").select("record_id", g.size(g.frontier(F.col("mask"))).alias("n_open"))
    return found.where("n_open > 0")


@query(
    "shape_text",
    _bits()
    + """SELECT id AS record_id, '[size=' || n || ' ' || w || 'x' || h || '] ' || string_agg('(' || c || ',' || r || ')', ' ' ORDER BY r, c) AS text FROM norm GROUP BY id, n, w, h""",
)
def shape_text(spark: SparkSession, d: str) -> DataFrame:
    shaped = g.with_normal(_masks(spark, d).where("mask <> 0"))
    return shaped.select("record_id", render.as_text(F.col("normal"), F.col("w"), F.col("h")).alias("text"))


@query(
    "shape_picture",
    _bits()
    + """, lines AS (SELECT b.id, y.r, string_agg(CASE WHEN s.id IS NULL THEN '  ' ELSE '██' END, '' ORDER BY x.c) AS line FROM box b, range(8) y(r), range(8) x(c)
        LEFT JOIN norm s ON s.id = b.id AND s.r = y.r AND s.c = x.c WHERE y.r < b.h AND x.c < b.w GROUP BY b.id, y.r)
    SELECT id AS record_id, string_agg(line, chr(10) ORDER BY r DESC) AS picture FROM lines GROUP BY id""",
)
def shape_picture(spark: SparkSession, d: str) -> DataFrame:
    shaped = g.with_normal(_masks(spark, d).where("mask <> 0"))
    return shaped.select("record_id", render.as_picture(F.col("normal"), F.col("w"), F.col("h")).alias("picture"))


@query(
    "shape_hex",
    "SELECT record_id, " + " || ".join(f"printf('%02x', (cells >> {8 * i}) & 255)" for i in range(8)) + " AS record FROM shapes WHERE cells IS NOT NULL",
)
def shape_hex(spark: SparkSession, d: str) -> DataFrame:
    """The stored form of every mask: 8 bytes, little-endian."""
    return _masks(spark, d).select("record_id", g.to_hex(F.col("mask")).alias("record"))


@query("shape_decoded", "SELECT record_id, cells AS by_record, cells AS by_cells FROM shapes WHERE cells IS NOT NULL")
def shape_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every mask back from its stored form, and from the list of its cells."""
    m = F.col("mask")
    return _masks(spark, d).select("record_id", g.from_hex(g.to_hex(m)).alias("by_record"), g.from_cells(g.cells(m)).alias("by_cells"))


@query("shape_touches", _bits() + "SELECT id AS record_id, r0 = 0 AND c0 = 0 AND w = 6 AND h = 6 AS touches_6, r0 = 0 AND c0 = 0 AND w = 7 AND h = 7 AS touches_7 FROM box")
def shape_touches(spark: SparkSession, d: str) -> DataFrame:
    """Whether a shape touches all sides of the board that it fills: 6 x 6 or 7 x 7."""
    boxed = g.with_box(_masks(spark, d).where("mask <> 0"))
    fits = lambda n: (F.col("min_row") + F.col("h") <= n) & (F.col("min_col") + F.col("w") <= n)
    return boxed.select("record_id", *((fits(n) & g.touches_all_sides(F.col("mask"), n, n)).alias(f"touches_{n}") for n in (6, 7)))


_WIDE = """WITH bits AS (SELECT s.record_id, (8 * i + k) // d.stride AS r, (8 * i + k) % d.stride AS c FROM shapes s JOIN datasets d USING (dataset_id), range(2000) t(i), range(8) u(k)
    WHERE s.wide_cells IS NOT NULL AND i < length(s.wide_cells) // 2 AND (CAST('0x' || substr(s.wide_cells, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) >> CAST(k AS INTEGER)) & 1 = 1)"""


@query(
    "wide_shapes",
    _WIDE
    + """, box AS (SELECT record_id, CAST(max(c) - min(c) + 1 AS INTEGER) AS w, CAST(max(r) - min(r) + 1 AS INTEGER) AS h, CAST(count(*) AS INTEGER) AS size FROM bits GROUP BY record_id),
    corners AS (SELECT record_id, count(*) AS v FROM (SELECT DISTINCT record_id, r + dr AS y, c + dc AS x FROM bits, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc)) GROUP BY record_id),
    edges AS (SELECT record_id, count(*) AS e FROM (SELECT DISTINCT record_id, k, r + dr AS y, c + dc AS x FROM bits, (VALUES (0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 0, 1)) d(k, dr, dc)) GROUP BY record_id)
    SELECT record_id, w, h, size, CAST(v - e + size AS INTEGER) AS chi FROM box JOIN corners USING (record_id) JOIN edges USING (record_id)""",
)
def wide_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Box, size and Euler number of the shapes of wider exports."""
    exports = table(spark, d, "datasets").select("dataset_id", "stride")
    rows = table(spark, d, "shapes").where("wide_cells is not null").select("record_id", "dataset_id", "wide_cells").join(exports, "dataset_id")
    at = rows.withColumn("at", wide.cells(F.col("wide_cells"), F.col("stride")))
    return at.select("record_id", wide.extent(F.col("at"), "col").alias("w"), wide.extent(F.col("at"), "row").alias("h"), F.size("at").alias("size"), wide.euler(F.col("at")).alias("chi"))


_WIDE_TURNS = (
    _WIDE
    + """, box AS (SELECT record_id, min(r) AS r0, min(c) AS c0, CAST(max(r) - min(r) + 1 AS INTEGER) AS h, CAST(max(c) - min(c) + 1 AS INTEGER) AS w FROM bits GROUP BY record_id),
    norm AS (SELECT record_id, stride, dataset_id, r - r0 AS r, c - c0 AS c, box.w, box.h FROM bits JOIN box USING (record_id) JOIN shapes USING (record_id) JOIN datasets USING (dataset_id)),
    turns AS (SELECT record_id, dataset_id, stride, w, h, list_reverse_sort(list(r * stride + c)) AS b0, list_reverse_sort(list(c * stride + h - 1 - r)) AS b1,
        list_reverse_sort(list((h - 1 - r) * stride + w - 1 - c)) AS b2, list_reverse_sort(list((w - 1 - c) * stride + r)) AS b3 FROM norm GROUP BY ALL)"""
)


def _wide_at(spark: SparkSession, d: str) -> DataFrame:
    exports = table(spark, d, "datasets").select("dataset_id", "stride")
    rows = table(spark, d, "shapes").where("wide_cells is not null").join(exports, "dataset_id")
    return rows.withColumn("at", wide.cells(F.col("wide_cells"), F.col("stride")))


@query(
    "wide_turns",
    _WIDE_TURNS
    + """ SELECT record_id, array_to_string(b0, ' ') AS normal, array_to_string(least(b0, b1, b2, b3), ' ') AS canonical, w = h AND b0 = b1 AS s90, b0 = b2 AS s180,
    CASE WHEN w = h AND b0 = b1 THEN 1 WHEN b0 = b2 THEN 2 ELSE 4 END AS weight, greatest(w, h) AS max_dim FROM turns""",
)
def wide_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of the shapes of wider exports: set bits from the highest, of the shape at (0, 0) and of its least turn."""
    made = wide.turned(_wide_at(spark, d).select("record_id", "at", "stride").where("size(at) > 0"), "at", "stride")
    return made.select("record_id", F.array_join("normal", " ").alias("normal"), F.array_join("canonical", " ").alias("canonical"), "s90", "s180", "weight", "max_dim")


@query(
    "wide_classes",
    _WIDE_TURNS
    + """ SELECT dataset_id, greatest(w, h) AS max_dim, count(DISTINCT least(b0, b1, b2, b3)) AS one_sided, count(*) AS n_records FROM turns GROUP BY ALL""",
)
def wide_classes(spark: SparkSession, d: str) -> DataFrame:
    """Per wider export and longest side the distinct shapes up to moving and turning. The least turns are made distinct before they are counted."""
    made = wide.turned(_wide_at(spark, d).select("dataset_id", "at", "stride").where("size(at) > 0"), "at", "stride")
    once = made.groupBy("dataset_id", "max_dim", "canonical").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("dataset_id", "max_dim").agg(F.count(F.lit(1)).alias("one_sided"), F.sum("n").alias("n_records"))


# -- shapes: counting

_CLASSES = (
    _bits()
    + """, least4 AS (SELECT DISTINCT least(m0, m1, m2, m3) AS m, CASE WHEN w = h AND m0 = m1 THEN 1 WHEN m0 = m2 THEN 2 ELSE 4 END AS weight,
        m0 = m2 AS s180, w = h AND m0 = m1 AS s90, greatest(w, h) AS max_dim, min(id) OVER (PARTITION BY least(m0, m1, m2, m3)) AS id FROM turns)"""
    + _EULER
    + """, kinds AS (SELECT l.*, chi <= 0 AS hole FROM least4 l JOIN chi USING (id)),
    bins AS (SELECT max_dim, hole, count(*) AS one_sided, CAST(sum(weight) AS BIGINT) AS fixed, CAST(sum(CASE WHEN s180 THEN weight ELSE 0 END) AS BIGINT) AS sym180,
        CAST(sum(CASE WHEN s90 THEN weight ELSE 0 END) AS BIGINT) AS sym90 FROM kinds GROUP BY ALL)"""
)


def _bins(spark: SparkSession, d: str) -> DataFrame:
    return sh.bins(sh.one_sided(_masks(spark, d)))


@query("count_bins", _CLASSES + " SELECT * FROM bins")
def count_bins(spark: SparkSession, d: str) -> DataFrame:
    """Distinct logged shapes per longest side and hole."""
    return _bins(spark, d)


@query(
    "count_cumulative",
    _CLASSES
    + """ SELECT max_dim AS n, hole, CAST(sum(one_sided) OVER w AS BIGINT) AS one_sided, CAST(sum(fixed) OVER w AS BIGINT) AS fixed, CAST(sum(sym180) OVER w AS BIGINT) AS sym180,
    CAST(sum(sym90) OVER w AS BIGINT) AS sym90 FROM bins WINDOW w AS (PARTITION BY hole ORDER BY max_dim)""",
)
def count_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return sh.cumulative(_bins(spark, d))


@query("count_burnside", _CLASSES + " SELECT max_dim, hole, one_sided AS burnside FROM bins")
def count_burnside(spark: SparkSession, d: str) -> DataFrame:
    """The one-sided counts from fixed and symmetric ones; the SQL counts the shapes themselves."""
    return _bins(spark, d).select("max_dim", "hole", sh.burnside(F.col("fixed"), F.col("sym180"), F.col("sym90")).alias("burnside"))


@query(
    "duplicates",
    """SELECT dataset_id, cells, count(*) AS copies, min(record_id) AS first_row, count(*) - 1 AS findings FROM shapes
    WHERE dataset_id IS NOT NULL AND cells IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
)
def duplicates(spark: SparkSession, d: str) -> DataFrame:
    return sh.duplicates(table(spark, d, "shapes").select("dataset_id", "cells", "record_id"), ["dataset_id", "cells"], "record_id")


@query(
    "duplicates_top",
    """SELECT dataset_id, cells, count(*) AS copies, min(record_id) AS first_row, count(*) - 1 AS findings FROM shapes
    WHERE dataset_id IS NOT NULL AND cells IS NOT NULL GROUP BY ALL HAVING count(*) > 1 ORDER BY copies DESC, first_row LIMIT 100""",
)
def duplicates_top(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred findings, most copies first."""
    return duplicates(spark, d).orderBy(F.desc("copies"), "first_row").limit(100)


_INDEX_SQL = """SELECT record_id, has_hole, max_dimension, cells, row_number() OVER (ORDER BY has_hole, max_dimension, cells, record_id) - 1 AS global_index
    FROM shapes WHERE cells IS NOT NULL AND has_hole IS NOT NULL AND max_dimension IS NOT NULL"""


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "shapes").select("record_id", "has_hole", "max_dimension", "cells").dropna()
    return sh.indexed(rows, ["has_hole", "max_dimension", "cells", "record_id"])


@query("global_index", _INDEX_SQL)
def global_index(spark: SparkSession, d: str) -> DataFrame:
    """Every record's place in stream order: class, longest side, mask."""
    return _indexed(spark, d)


@query("index_range", f"SELECT record_id, has_hole, max_dimension, cells, global_index FROM ({_INDEX_SQL}) WHERE global_index BETWEEN 99 AND 4999 AND has_hole = FALSE")
def index_range(spark: SparkSession, d: str) -> DataFrame:
    """Records 100 to 5000, then those without holes."""
    return sh.index_range(_indexed(spark, d), 100, 5000).where(~F.col("has_hole"))


# -- packed datasets


_PACKED_SQL = """WITH s AS (SELECT DISTINCT has_hole AS hole, max_dimension AS max_dim, cells AS mask FROM shapes WHERE has_hole IS NOT NULL AND max_dimension IS NOT NULL AND cells IS NOT NULL),
    placed AS (SELECT hole, max_dim, mask, row_number() OVER (ORDER BY hole, max_dim, CAST(mask AS HUGEINT) + CASE WHEN mask < 0 THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END) - 1 AS global_index FROM s)"""


def _packed(spark: SparkSession, d: str) -> str:
    """All logged masks by class, written as a packed dataset into the shared folder, which must be one that tasks can open as files; where it lies."""
    rows = table(spark, d, "shapes").select(F.col("has_hole").alias("hole"), F.col("max_dimension").alias("max_dim"), F.col("cells").alias("mask")).dropna().distinct()
    root = f"{re.sub('^file:/+', '/', own_dir(spark))}/packed-{uuid.uuid4().hex}"
    if not root.startswith("/"):
        raise ValueError(f"{root} can't be opened as a folder of files")
    packed.write_dataset(cut(rows, "rows"), root, g.SIDE)
    return root


@query("packed_round_trip", _PACKED_SQL + " SELECT hole, max_dim, mask, global_index FROM placed")
def packed_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The packed dataset of all logged masks, read again."""
    return packed.read_dataset(spark, _packed(spark, d)).select("hole", "max_dim", "mask", "global_index")


@query("packed_range", _PACKED_SQL + " SELECT hole, max_dim, mask, global_index FROM placed WHERE global_index BETWEEN 99 AND 4999")
def packed_range(spark: SparkSession, d: str) -> DataFrame:
    """Its records 100 to 5000, of which other chunks aren't opened."""
    return packed.read_dataset(spark, _packed(spark, d), 100, 5000).select("hole", "max_dim", "mask", "global_index")


@query("packed_streams", _PACKED_SQL + " SELECT hole, max_dim, count(*) AS n_records, min(global_index) AS first_index, max(global_index) AS last_index FROM placed GROUP BY ALL")
def packed_streams(spark: SparkSession, d: str) -> DataFrame:
    """Its streams as their files have them: records and the places of the first and last."""
    return packed.read_dataset(spark, _packed(spark, d)).groupBy("hole", "max_dim").agg(F.count(F.lit(1)).alias("n_records"), F.min("global_index").alias("first_index"), F.max("global_index").alias("last_index"))


# -- checks

_CHECK = (
    _bits().replace("WITH ", "WITH RECURSIVE ", 1)
    + _FLOODS
    + _EULER
    + f""", facts AS (SELECT s.*, s.cells <> 0 AS not_empty, {_SIGNED.format("t.m0")} = s.cells AS at_origin, t.w = s.w AS w_right, t.h = s.h AS h_right, t.n = s.size AS size_right,
    greatest(t.w, t.h) = s.max_dimension AS max_dim_right, f.connected, {_SIGNED.format("least(t.m0, t.m1, t.m2, t.m3)")} = s.cells AS canonical_right,
    (c.chi <= 0) = s.has_hole AS hole_right, (c.chi <= 0) = f.holed AS flood_agrees FROM shapes s JOIN turns t ON s.record_id = t.id JOIN chi c ON c.id = t.id JOIN flood f USING (m0))"""
)


@query(
    "verify_exports",
    _CHECK
    + " SELECT dataset_id, count(*) AS n_records, "
    + ", ".join(f"count(*) FILTER (NOT {r}) AS bad_{r}" for r in sh.RULES)
    + " FROM facts GROUP BY dataset_id",
)
def verify_exports(spark: SparkSession, d: str) -> DataFrame:
    """Per export how many records break each rule of the format."""
    rows = table(spark, d, "shapes").where("cells is not null").select("dataset_id", "record_id", "cells", "w", "h", "size", "max_dimension", "has_hole")
    return sh.verdict(sh.checked(rows, "cells", "w", "h", "size", "max_dimension", "has_hole"), ["dataset_id"])


def _wide_rows(spark: SparkSession, d: str) -> DataFrame:
    """Records of exports wider than 8 with their export's stride, null where the export isn't known."""
    exports = table(spark, d, "datasets").select("dataset_id", "stride").dropna(subset=["dataset_id"]).groupBy("dataset_id").agg(F.max("stride").alias("stride"))
    return table(spark, d, "shapes").where("cells is null and wide_cells is not null").join(exports, "dataset_id", "left")


#: The same facts of wider records, at any stride. Numbers are compared by their set bits from the highest.
_WIDE_FACTS = f"""wbit AS (SELECT s.record_id AS id, d.stride, (8 * i + k) // d.stride AS r, (8 * i + k) % d.stride AS c FROM shapes s JOIN datasets d USING (dataset_id), range(2000) t(i), range(8) u(k)
    WHERE s.cells IS NULL AND s.wide_cells IS NOT NULL AND i < length(s.wide_cells) // 2 AND (CAST('0x' || substr(s.wide_cells, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) >> CAST(k AS INTEGER)) & 1 = 1),
wbox AS (SELECT id, stride, min(r) AS r0, min(c) AS c0, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w, count(*) AS n FROM wbit GROUP BY ALL),
wnorm AS (SELECT b.id, b.stride, r, c, r - r0 AS y, c - c0 AS x, w, h FROM wbit b JOIN wbox USING (id)),
wturn AS (SELECT id, list_reverse_sort(list(r * stride + c)) AS b, list_reverse_sort(list(y * stride + x)) AS b0, list_reverse_sort(list(x * stride + h - 1 - y)) AS b1,
    list_reverse_sort(list((h - 1 - y) * stride + w - 1 - x)) AS b2, list_reverse_sort(list((w - 1 - x) * stride + y)) AS b3 FROM wnorm GROUP BY id),
wcorner AS (SELECT id, count(*) AS v FROM (SELECT DISTINCT id, r + dr AS y, c + dc AS x FROM wbit, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc)) GROUP BY id),
wedge AS (SELECT id, count(*) AS e FROM (SELECT DISTINCT id, k, r + dr AS y, c + dc AS x FROM wbit, (VALUES (0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 0, 1)) d(k, dr, dc)) GROUP BY id),
winside AS (SELECT id, min(y * 1000 + x) // 1000 AS y, min(y * 1000 + x) % 1000 AS x FROM wnorm GROUP BY id UNION
    SELECT i.id, b.y, b.x FROM winside i CROSS JOIN {_SIDES4} JOIN wnorm b ON b.id = i.id AND b.y = i.y + dr AND b.x = i.x + dc),
wfree AS (SELECT id, v.y, u.x FROM wbox, range(-1, 1001) v(y), range(-1, 1001) u(x) WHERE v.y <= h AND u.x <= w AND NOT EXISTS (SELECT 1 FROM wnorm k WHERE k.id = wbox.id AND k.y = v.y AND k.x = u.x)),
woutside AS (SELECT id, CAST(-1 AS BIGINT) AS y, CAST(-1 AS BIGINT) AS x FROM wbox UNION
    SELECT o.id, f.y, f.x FROM woutside o CROSS JOIN {_SIDES4} JOIN wfree f ON f.id = o.id AND f.y = o.y + dr AND f.x = o.x + dc),
wfacts AS (SELECT s.dataset_id, TRUE AS not_empty, x.r0 = 0 AND x.c0 = 0 AS at_origin, x.w = s.w AS w_right, x.h = s.h AS h_right, x.n = s.size AS size_right, greatest(x.w, x.h) = s.max_dimension AS max_dim_right,
    i.k = x.n AS connected, least(b0, b1, b2, b3) = b AS canonical_right, (v - e + x.n <= 0) = s.has_hole AS hole_right, (v - e + x.n <= 0) = (o.k < f.k) AS flood_agrees
    FROM shapes s JOIN wbox x ON x.id = s.record_id JOIN wturn USING (id) JOIN wcorner USING (id) JOIN wedge USING (id) JOIN (SELECT id, count(*) AS k FROM winside GROUP BY id) i USING (id)
    JOIN (SELECT id, count(*) AS k FROM woutside GROUP BY id) o USING (id) JOIN (SELECT id, count(*) AS k FROM wfree GROUP BY id) f USING (id))"""


@query(
    "verify_records",
    _CHECK
    + ", "
    + _WIDE_FACTS
    + " SELECT dataset_id, count(*) AS n_records, "
    + ", ".join(f"count(*) FILTER (NOT {r}) AS bad_{r}" for r in sh.RULES)
    + f" FROM (SELECT dataset_id, {', '.join(sh.RULES)} FROM facts UNION ALL SELECT dataset_id, {', '.join(sh.RULES)} FROM wfacts) GROUP BY dataset_id",
)
def verify_records(spark: SparkSession, d: str) -> DataFrame:
    """``verify_exports`` over all exports, also those wider than 8, which its SQL leaves out. Rows without a mask in either form aren't records."""
    fields = ("w", "h", "size", "max_dimension", "has_hole")
    rows = table(spark, d, "shapes").where("cells is not null").select("dataset_id", "record_id", "cells", *fields)
    narrow = sh.checked(rows, "cells", *fields).select("dataset_id", *sh.RULES)
    broad = sh.checked_wide(_wide_rows(spark, d).select("dataset_id", "wide_cells", "stride", *fields), "wide_cells", "stride", *fields)
    return sh.verdict(narrow.unionByName(broad.select("dataset_id", *sh.RULES)), ["dataset_id"])


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """All records with a mask, in stored form: little-endian bytes in hexadecimal."""
    record = F.coalesce(g.to_hex(F.col("cells")), F.lower("wide_cells"))
    return table(spark, d, "shapes").select("dataset_id", "record_id", "has_hole", "max_dimension", record.alias("record")).where("record is not null")


#: The stored form of a record: little-endian bytes in hexadecimal.
_RECORD_SQL = "coalesce(" + " || ".join(f"printf('%02x', (cells >> {8 * i}) & 255)" for i in range(8)) + ", lower(wide_cells))"


@query(
    "duplicate_records",
    f"""SELECT dataset_id, record, count(*) AS copies, min(record_id) AS first_row, count(*) - 1 AS findings FROM (SELECT dataset_id, record_id, {_RECORD_SQL} AS record FROM shapes)
    WHERE dataset_id IS NOT NULL AND record IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_records(spark: SparkSession, d: str) -> DataFrame:
    """``duplicates`` by stored record, over all exports."""
    return sh.duplicates(_stored(spark, d), ["dataset_id", "record"], "record_id")


@query(
    "record_index",
    f"""SELECT record_id, has_hole, max_dimension, record, row_number() OVER (ORDER BY has_hole, max_dimension, length(value), value, record_id) - 1 AS global_index FROM (
    SELECT record_id, has_hole, max_dimension, record, ltrim(array_to_string(list_reverse(regexp_extract_all(record, '..')), ''), '0') AS value
    FROM (SELECT *, {_RECORD_SQL} AS record FROM shapes) WHERE record IS NOT NULL AND has_hole IS NOT NULL AND max_dimension IS NOT NULL)""",
)
def record_index(spark: SparkSession, d: str) -> DataFrame:
    """``global_index`` over all exports: class, longest side, mask. Masks go by their value as unsigned numbers, whatever the record's width."""
    rows = _stored(spark, d).drop("dataset_id").dropna()
    big = F.array_join(F.reverse(F.regexp_extract_all("record", F.lit("(..)"))), "")
    value = rows.withColumn("value", F.regexp_replace(big, "^0+", "")).withColumn("digits", F.length("value"))
    return sh.indexed(value, ["has_hole", "max_dimension", "digits", "value", "record_id"]).drop("value", "digits")


@query(
    "export_layouts",
    """SELECT dataset_id, stride = greatest(8, max_n) AS stride_right, record_bytes = greatest(8, CAST(ceil(max_n * greatest(8, max_n) / 8.0) AS INTEGER)) AS bytes_right,
    encoding = CASE WHEN format_version = 3 THEN 'uint-le-fixed' ELSE 'u64-le-stride8' END AS encoding_right, coalesce(complete, FALSE) AS complete FROM datasets""",
)
def export_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Whether each export's stride, record width and encoding are those of its side and version."""
    stride, record = sh.layout(F.col("max_n"))
    right = F.when(F.col("format_version") == 3, "uint-le-fixed").otherwise("u64-le-stride8")
    return table(spark, d, "datasets").select(
        "dataset_id", (F.col("stride") == stride).alias("stride_right"), (F.col("record_bytes") == record).alias("bytes_right"),
        (F.col("encoding") == right).alias("encoding_right"), F.coalesce("complete", F.lit(False)).alias("complete"),
    )


_PATH_SQL = sh.STREAM_PATH


@query(
    "stream_faults",
    f"""SELECT stream_id, NOT coalesce(ok, FALSE) AS bad_path, coalesce(ok, FALSE) AND side <> lpad(CAST(CAST(side AS INTEGER) AS VARCHAR), CAST(greatest(2, length(CAST(CAST(side AS INTEGER) AS VARCHAR))) AS INTEGER), '0') AS bad_padding,
    coalesce(ok, FALSE) AND NOT coalesce(CAST(side AS INTEGER) = max_dimension, FALSE) AS bad_side,
    coalesce(ok, FALSE) AND NOT coalesce((kind = 'with_holes') = has_hole, FALSE) AS bad_class,
    NOT coalesce(regexp_matches(record_count, '^[1-9][0-9]*$'), FALSE) AS bad_count, n > 1 AS repeated
    FROM (SELECT *, regexp_matches(stream_path, '{_PATH_SQL}') AS ok, nullif(regexp_extract(stream_path, '{_PATH_SQL}', 2), '') AS side, regexp_extract(stream_path, '{_PATH_SQL}', 1) AS kind,
        count(*) OVER (PARTITION BY dataset_id, max_dimension, has_hole) AS n FROM streams)""",
)
def stream_faults(spark: SparkSession, d: str) -> DataFrame:
    return sh.stream_faults(table(spark, d, "streams"))


@query(
    "stream_totals",
    """SELECT d.dataset_id, try_cast(d.record_count AS BIGINT) AS declared, sum(try_cast(s.record_count AS BIGINT))::BIGINT AS in_streams, count(s.stream_id) AS n_streams,
    try_cast(d.record_count AS BIGINT) = sum(try_cast(s.record_count AS BIGINT)) AS agrees FROM datasets d LEFT JOIN streams s USING (dataset_id) GROUP BY d.dataset_id, d.record_count""",
)
def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """Each export's declared count against the sum of its streams'."""
    streams = table(spark, d, "streams").groupBy("dataset_id").agg(F.sum(F.col("record_count").try_cast("bigint")).alias("in_streams"), F.count("stream_id").alias("n_streams"))
    both = table(spark, d, "datasets").select("dataset_id", F.col("record_count").try_cast("bigint").alias("declared")).join(streams, "dataset_id", "left")
    return both.select("dataset_id", "declared", "in_streams", F.coalesce("n_streams", F.lit(0)).alias("n_streams"), (F.col("declared") == F.col("in_streams")).alias("agrees"))


# -- landmarks


@query(
    "landmark_check",
    """SELECT dataset_id, count(*) AS n_landmarks, count(*) FILTER (hit) AS n_found, count(*) FILTER (NOT hit) AS n_missing
    FROM (SELECT l.dataset_id, EXISTS (SELECT 1 FROM shapes s WHERE s.dataset_id = l.dataset_id AND s.cells = l.mask) AS hit FROM landmarks l WHERE mask IS NOT NULL) GROUP BY dataset_id""",
)
def landmark_check(spark: SparkSession, d: str) -> DataFrame:
    return sh.landmark_check(table(spark, d, "landmarks"), table(spark, d, "shapes").select("dataset_id", "cells"))


_LANDMARK = _bits("landmarks", "landmark_id", "mask") + _EULER


@query(
    "landmark_summary",
    _LANDMARK
    + """SELECT label, count(*) AS n, round(avg(b.n), 1) AS avg_size, count(*) FILTER (chi <= 0) AS n_holes, round(count(*) FILTER (chi <= 0) * 100 / count(*), 1) AS hole_percent,
    CAST(min(b.n) AS INTEGER) AS min_size, CAST(max(b.n) AS INTEGER) AS max_size, min(w) AS min_w, max(w) AS max_w, min(h) AS min_h, max(h) AS max_h
    FROM landmarks l JOIN box b ON l.landmark_id = b.id JOIN chi USING (id) GROUP BY label""",
)
def landmark_summary(spark: SparkSession, d: str) -> DataFrame:
    return sh.landmark_summary(table(spark, d, "landmarks"), ["label"])


@query(
    "landmark_totals",
    _LANDMARK
    + """SELECT count(*) AS n, round(avg(b.n), 1) AS avg_size, count(*) FILTER (chi <= 0) AS n_holes, round(count(*) FILTER (chi <= 0) * 100 / count(*), 1) AS hole_percent,
    CAST(min(b.n) AS INTEGER) AS min_size, CAST(max(b.n) AS INTEGER) AS max_size, min(w) AS min_w, max(w) AS max_w, min(h) AS min_h, max(h) AS max_h FROM box b JOIN chi USING (id)""",
)
def landmark_totals(spark: SparkSession, d: str) -> DataFrame:
    return sh.landmark_summary(table(spark, d, "landmarks"), [])


@query(
    "landmark_histogram",
    """SELECT label, size, n, repeat('█', CAST(greatest(1, n * 40 // max(n) OVER (PARTITION BY label)) AS INTEGER)) AS bar
    FROM (SELECT label, CAST(bit_count(mask) AS INTEGER) AS size, count(*) AS n FROM landmarks WHERE mask IS NOT NULL GROUP BY ALL)""",
)
def landmark_histogram(spark: SparkSession, d: str) -> DataFrame:
    return sh.histogram(table(spark, d, "landmarks"), "label")


@query(
    "landmark_rooms",
    _LANDMARK
    + "SELECT landmark_id, label, selection_order, global_index, "
    + " || ".join(f"printf('%02x', (mask >> {8 * i}) & 255)" for i in range(8))
    + " AS record, w AS width, h AS height, CAST(b.n AS INTEGER) AS size, chi <= 0 AS hole FROM landmarks l JOIN box b ON l.landmark_id = b.id JOIN chi USING (id)",
)
def landmark_rooms(spark: SparkSession, d: str) -> DataFrame:
    """Every landmark as an asset with its stored record."""
    return sh.rooms(table(spark, d, "landmarks")).drop("mask")


@query(
    "landmark_set_difference",
    """(SELECT DISTINCT dataset_id, mask, 'left' AS side FROM landmarks l WHERE mask IS NOT NULL AND NOT EXISTS (SELECT 1 FROM shapes s WHERE s.dataset_id = l.dataset_id AND s.cells = l.mask))
    UNION ALL (SELECT DISTINCT dataset_id, cells, 'right' FROM shapes s WHERE cells IS NOT NULL AND NOT EXISTS (SELECT 1 FROM landmarks l WHERE s.dataset_id = l.dataset_id AND s.cells = l.mask))""",
)
def landmark_set_difference(spark: SparkSession, d: str) -> DataFrame:
    """Masks that are logged but no landmarks, and the other way round."""
    marks = table(spark, d, "landmarks").select("dataset_id", "mask").where("mask is not null")
    logged = table(spark, d, "shapes").select("dataset_id", F.col("cells").alias("mask")).where("mask is not null")
    return sh.set_difference(marks, logged)


#: Behind an entry without a count no start is known.
_CHUNK_SQL = """WITH n AS (SELECT dataset_id, stream_id, try_cast(record_count AS BIGINT) AS count, has_hole, max_dimension FROM streams),
    s AS (SELECT dataset_id, stream_id, count, CASE WHEN count(*) FILTER (count IS NULL) OVER w = 0 THEN coalesce(sum(count) OVER w, 0)::BIGINT END AS start FROM n
    WINDOW w AS (PARTITION BY dataset_id ORDER BY has_hole, max_dimension, stream_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "landmark_streams",
    _CHUNK_SQL
    + """ SELECT l.landmark_id, s.stream_id, l.global_index - s.start AS position FROM landmarks l JOIN s ON s.dataset_id = l.dataset_id
    AND l.global_index >= s.start AND l.global_index < s.start + s.count WHERE s.count > 0""",
)
def landmark_streams(spark: SparkSession, d: str) -> DataFrame:
    """In which stream, and where in it, each landmark's global index lies, as far as the streams before it have counts."""
    before = Window.partitionBy("dataset_id").orderBy("has_hole", "max_dimension", "stream_id").rowsBetween(Window.unboundedPreceding, -1)
    count = F.col("record_count").try_cast("bigint")
    start = F.when(F.coalesce(F.sum(count.isNull().cast("int")).over(before), F.lit(0)) == 0, F.coalesce(F.sum(count).over(before), F.lit(0)))
    chunks = table(spark, d, "streams").select("dataset_id", "stream_id", count.alias("count"), start.alias("start")).where("start is not null")
    asked = table(spark, d, "landmarks").where("global_index is not null").select("dataset_id", "landmark_id", F.col("global_index").alias("first"), F.col("global_index").alias("last"))
    found = sh.asked_chunks(asked, chunks)
    return found.select("landmark_id", "stream_id", (F.col("first") - F.col("start")).alias("position"))


@query(
    "landmark_extract",
    """SELECT l.landmark_id, l.dataset_id, l.global_index, x.cells AS record_mask, CASE WHEN x.record_id IS NOT NULL THEN l.mask = x.cells END AS same FROM landmarks l
    LEFT JOIN (SELECT dataset_id, record_id, cells, row_number() OVER (PARTITION BY dataset_id ORDER BY has_hole, max_dimension, cells, record_id) - 1 AS at FROM shapes
    WHERE dataset_id IS NOT NULL AND cells IS NOT NULL AND has_hole IS NOT NULL AND max_dimension IS NOT NULL) x ON x.dataset_id = l.dataset_id AND x.at = l.global_index""",
)
def landmark_extract(spark: SparkSession, d: str) -> DataFrame:
    """The logged record at each landmark's index in its export, and whether it has the landmark's mask."""
    rows = table(spark, d, "shapes").select("dataset_id", "record_id", "has_hole", "max_dimension", "cells").dropna()
    numbered = sh.indexed_within(rows, "dataset_id", ["has_hole", "max_dimension", "cells", "record_id"])
    asked = table(spark, d, "landmarks").select("landmark_id", "dataset_id", "global_index", "mask")
    return sh.extracted(asked, numbered, "dataset_id", "mask", "cells").drop("mask")


@query(
    "export_totals",
    """WITH once AS (SELECT dataset_id, coalesce(CAST(cells AS VARCHAR), lower(wide_cells)) AS record, count(*) AS n, max(has_hole) AS hole FROM shapes
        WHERE dataset_id IS NOT NULL AND (cells IS NOT NULL OR wide_cells IS NOT NULL) GROUP BY ALL)
    SELECT d.dataset_id, try_cast(d.record_count AS BIGINT) AS declared, coalesce(sum(n), 0)::BIGINT AS n_records, count(record) AS n_distinct, count(*) FILTER (hole) AS n_holes,
    count(*) FILTER (NOT hole) AS n_without, count(record) FILTER (hole IS NULL) AS n_unsaid, coalesce(count(record) <= try_cast(d.record_count AS BIGINT), TRUE) AS fits
    FROM datasets d LEFT JOIN once USING (dataset_id) GROUP BY d.dataset_id, d.record_count""",
)
def export_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per export the records logged, the different ones by class, and whether the declared count has room for them."""
    found = sh.totals(_stored(spark, d).dropna(subset=["dataset_id"]), "dataset_id", "record", "has_hole")
    declared = table(spark, d, "datasets").select("dataset_id", F.col("record_count").try_cast("bigint").alias("declared"))
    counts = ("n_records", "n_distinct", "n_holes", "n_without", "n_unsaid")
    both = declared.join(found, "dataset_id", "left").na.fill(0, list(counts))
    return both.select("dataset_id", "declared", *counts, F.coalesce(F.col("n_distinct") <= F.col("declared"), F.lit(True)).alias("fits"))


#: Each distinct shape with each empty neighbour, within 8 x 8, as the least of its turns.
_GROWTH = _bits() + f""", parent AS (SELECT least(m0, m1, m2, m3) AS p FROM turns GROUP BY p),
    cell AS (SELECT p, CAST(i // 8 AS INTEGER) AS r, CAST(i % 8 AS INTEGER) AS c FROM parent, range(64) t(i) WHERE (p >> CAST(i AS INTEGER)) & 1 = 1),
    new AS (SELECT DISTINCT p, r + dr AS y, c + dc AS x FROM cell, {_SIDES4}), open AS (SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM cell WHERE cell.p = new.p AND r = y AND c = x)),
    child AS (SELECT p, y, x, r, c FROM open JOIN cell USING (p) UNION ALL SELECT p, y, x, y, x FROM open),
    size AS (SELECT p, y, x, min(r) AS r0, min(c) AS c0, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM child GROUP BY ALL),
    kid AS (SELECT p, y, x, r - r0 AS r, c - c0 AS c, h, w FROM child JOIN size USING (p, y, x) WHERE h <= 8 AND w <= 8),
    least4 AS (SELECT p, least(sum(CAST(1 AS HUGEINT) << (8 * r + c)), sum(CAST(1 AS HUGEINT) << (8 * c + h - 1 - r)), sum(CAST(1 AS HUGEINT) << (8 * (h - 1 - r) + w - 1 - c)),
        sum(CAST(1 AS HUGEINT) << (8 * (w - 1 - c) + r))) AS m FROM kid GROUP BY p, y, x, h, w)
    SELECT {_SIGNED.format("m")} AS mask, count(DISTINCT p) AS parents FROM least4 GROUP BY m"""


@query("growth_children", _GROWTH)
def growth_children(spark: SparkSession, d: str) -> DataFrame:
    """The shapes one cell larger that the logged ones lead to, within 8 x 8, and from how many."""
    return sh.children(sh.one_sided(_masks(spark, d)).select("mask"), g.SIDE)
