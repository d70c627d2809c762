"""Queries of the feature-table engine over the driver's tables, with the SQL that gives the same rows.

Tables get object ids from their dense keys (key + 1). Two-valued logic is spelled out in the SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.functions import geometry as g
from parcela.functions import scalars
from parcela.functions.spatial import CONTAINS, ENVELOPE_INTERSECTS, INTERSECTS, WITHIN
from parcela.operators.filters import OID, QueryFilter
from parcela.operators.table import FeatureTable
from parcela.sources.shared import scratch
from parcela.sources.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEYS = {"orders": "o_orderkey", "events": "event_id", "customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with OBJECTID where it has a dense key."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumn(OID, F.col(KEYS[name]) + 1) if name in KEYS else rows


def table_of(spark: SparkSession, sf_dir: str, name: str, shape: Column | None = None, **how) -> FeatureTable:
    rows = rows_of(spark, sf_dir, name)
    if shape is not None:
        rows = g.with_bounds(rows.withColumn("SHAPE", shape))
    return FeatureTable(name, rows, 1, "SHAPE" if shape is not None else None, how)


def filtered(name: str, table: str, text: str, columns: str, where: str, derived: dict[str, tuple[str, str]] | None = None) -> None:
    """A query that filters a table by a text, and SQL with the condition spelled out; derived columns as (Spark, SQL)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = rows_of(spark, sf_dir, table)
        for column, (made, _) in (derived or {}).items():
            rows = rows.withColumn(column, F.expr(made))
        return QueryFilter.where(text).apply(rows).select(*columns.split(", "))

    QUERIES[name] = run
    made = "".join(f", {sql} AS {column}" for column, (_, sql) in (derived or {}).items())
    oid = f", CAST({KEYS[table]} + 1 AS BIGINT) AS {OID}" if table in KEYS else ""
    ORACLES[name] = f"SELECT {columns} FROM (SELECT *{oid}{made} FROM {table}) AS t WHERE {where}"


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"
PRIORITY = {"prio": ("nullif(o_orderpriority, '5-LOW')", "nullif(o_orderpriority, '5-LOW')")}
SIZE = {"size": ("cast(nullif(p_size, 7) as int)", "nullif(p_size, 7)")}
filtered("where_eq", "lineitem", "l_quantity = 17", LINE, "l_quantity = 17")
filtered("where_ne", "lineitem", "l_quantity != 17", LINE, "l_quantity <> 17")
filtered("where_gt", "lineitem", "l_extendedprice > 50000.5", LINE, "l_extendedprice > 50000.5::DOUBLE")
filtered("where_ge", "lineitem", "l_quantity >= 49", LINE, "l_quantity >= 49")
filtered("where_lt", "lineitem", "l_discount < 0.02", LINE, "l_discount < 0.02::DOUBLE")
filtered("where_le", "lineitem", "l_tax <= 1e-2", LINE, "l_tax <= 0.01::DOUBLE")
filtered("where_eq_str", "customer", "c_mktsegment = 'BUILDING'", f"{OID}, c_name", "c_mktsegment = 'BUILDING'")
filtered("where_quoted_ident", "customer", "\"c_mktsegment\" > 'C' AND \"c_acctbal\" < -10", f"{OID}, c_name", "c_mktsegment > 'C' AND c_acctbal < -10")
filtered("where_and_or_paren", "orders", "(o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice > 250000", f"{OID}, o_totalprice", "(o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice > 250000")
filtered("where_precedence", "orders", "o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AND o_totalprice > 250000", f"{OID}, o_totalprice", "o_orderstatus = 'F' OR (o_orderpriority = '1-URGENT' AND o_totalprice > 250000)")
filtered("where_not", "orders", "NOT (o_orderstatus = 'F' AND NOT o_totalprice > 250000)", f"{OID}, o_totalprice", "o_orderstatus <> 'F' OR o_totalprice > 250000")
filtered("where_is_null", "orders", "prio IS NULL", f"{OID}, o_orderpriority", "prio IS NULL", PRIORITY)
filtered("where_is_not_null", "orders", "prio IS NOT NULL", f"{OID}, o_orderpriority", "prio IS NOT NULL", PRIORITY)
filtered("where_in", "part", "p_size IN (1, 5, '7', 9.0, 12.5, 'x')", f"{OID}, p_size", "p_size IN (1, 5, 7, 9)")
filtered("where_not_in", "part", "p_brand NOT IN ('Brand#11', 'Brand#12', 5)", f"{OID}, p_brand", "p_brand NOT IN ('Brand#11', 'Brand#12')")
filtered("where_in_double", "lineitem", "l_discount IN (0.05, 0.07) AND l_quantity IN (2, 17)", LINE, "(abs(l_discount - 0.05::DOUBLE) < 2.220446049250313e-16 OR abs(l_discount - 0.07::DOUBLE) < 2.220446049250313e-16) AND l_quantity IN (2, 17)")
filtered("where_not_cmp_null", "orders", "NOT (prio = '1-URGENT')", f"{OID}, prio", "prio IS NULL OR prio <> '1-URGENT'", PRIORITY)
filtered("where_cmp_null_literal", "orders", "prio = NULL OR NOT (o_orderstatus <> NULL)", f"{OID}, prio", "true", PRIORITY)
filtered("where_not_in_null", "part", "size NOT IN (1, 2, 3)", f"{OID}, size", "size IS NULL OR size NOT IN (1, 2, 3)", SIZE)
filtered("where_in_list_null", "part", "size IN (1, NULL)", f"{OID}, size", "size IS NULL OR size = 1", SIZE)
filtered("where_not_in_list_null", "part", "size NOT IN (1, NULL)", f"{OID}, size", "size IS NOT NULL AND size <> 1", SIZE)
filtered("where_unknown_col_is_null", "orders", "nope IS NULL AND NOT (nope = 1) AND o_totalprice > 400000", f"{OID}, o_totalprice", "o_totalprice > 400000")
filtered("where_unknown_col_cmp", "orders", "nope = 1 OR nope IN (1) OR nope IS NOT NULL", f"{OID}, o_totalprice", "false")
filtered("where_str_num_coerce", "lineitem", "l_quantity > ' 30 ' AND l_linenumber = '+1e0'", LINE, "l_quantity > 30 AND l_linenumber = 1")
filtered("where_num_as_text", "part", "p_size < '4x' AND p_size <> 'y'", f"{OID}, p_size", "CAST(p_size AS VARCHAR) < '4x'")
filtered("where_double_as_text", "lineitem", "l_quantity >= '4x'", LINE, "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) >= '4x'")
filtered("where_num_vs_text_false", "customer", "NOT (c_name = 5) AND NOT (c_name <> 5)", f"{OID}, c_name", "true")
filtered("where_datetime_iso", "orders", "o_orderdate >= '1998-01-01' AND NOT (o_orderdate > '1998-03-01 00:00:00')", f"{OID}, o_orderdate", "o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate <= TIMESTAMP '1998-03-01'")
filtered("where_datetime_day_equals", "orders", "o_orderdate = '1998-01-01' OR o_orderdate IN ('1998-01-01 00:00:00', '1998-01-02')", f"{OID}, o_orderdate", "o_orderdate = TIMESTAMP '1998-01-01'")
filtered("where_datetime_text", "events", "ts > '2024-01-01T' OR ts < '2024-01-01 00:30:00.5'", f"{OID}, event_type", "strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END > '2024-01-01T' OR strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END < '2024-01-01 00:30:00.5'")
filtered("where_bool_int", "labels", "toxic = TRUE OR quality < TRUE", "doc_id, quality, toxic", "toxic <> 0 OR quality = 0")
filtered("where_bool_long_false", "labels", "doc_id = TRUE OR doc_id <> FALSE", "doc_id, quality, toxic", "false")
filtered("where_case_insensitive", "orders", "O_TOTALPRICE > 300000 and O_ORDERSTATUS in ('F')", f"{OID}, o_totalprice", "o_totalprice > 300000 AND o_orderstatus = 'F'")
filtered("where_unicode", "documents", "lang >= 'é' OR lang = 'de' OR text < 'A'", "doc_id, lang", "lang >= 'é' OR lang = 'de' OR text < 'A'")
filtered("where_nan", "lineitem", "v < 10 OR v >= 49", LINE, "isnan(v) OR v < 10 OR v >= 49", {"v": ("if(l_linenumber = 3, double('NaN'), l_quantity)", "CASE WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE ELSE l_quantity END")})
filtered("where_long_beyond_53_bits", "orders", "big = 9007199254740993", f"{OID}", "CAST(big AS DOUBLE) = 9007199254740992::DOUBLE", {"big": ("9007199254740990 + o_orderkey", "9007199254740990 + o_orderkey")})
filtered("where_conversations", "conversations", "role = 'user' AND turn IN (0, 2) AND NOT text IS NULL", "conv_id, turn, role", "role = 'user' AND turn IN (0, 2) AND text IS NOT NULL")

ORDERS = f"SELECT CAST(o_orderkey + 1 AS BIGINT) AS {OID}, o_orderstatus, o_totalprice FROM orders"
FIELDS = [OID, "o_orderstatus", "o_totalprice"]


@query(ORDERS)
def scan_all(spark, sf_dir):
    return table_of(spark, sf_dir, "orders").search(fields=FIELDS)


@query("SELECT count(*) AS n FROM orders")
def count_rows(spark, sf_dir):
    return table_of(spark, sf_dir, "orders").search().agg(F.count(F.lit(1)).alias("n"))


@query(f"{ORDERS} WHERE o_orderkey + 1 = 42")
def by_oid(spark, sf_dir):
    return table_of(spark, sf_dir, "orders").search(QueryFilter.by_oid(42), FIELDS)


@query(f"{ORDERS} WHERE o_orderkey + 1 IN (3, 5, 8, 13, 99999999)")
def by_oids(spark, sf_dir):
    return table_of(spark, sf_dir, "orders").search(QueryFilter.by_oids([13, 5, 3, 8, 5, 99999999]), FIELDS)


@query(f"{ORDERS} WHERE o_orderkey < 20000 AND o_orderkey % 7 = 3")
def by_many_oids(spark, sf_dir):
    return table_of(spark, sf_dir, "orders").search(QueryFilter.by_oids(range(4, 20001, 7)), FIELDS)


@query(f"SELECT CAST(o_orderkey + 1 AS BIGINT) AS {OID} FROM orders WHERE o_totalprice > 300000")
def query_oids_where(spark, sf_dir):
    return table_of(spark, sf_dir, "orders").oids(QueryFilter.where("o_totalprice > 300000"))


# Line items as points (quantity, discount in percent).


def item_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir, "lineitem").withColumns({"px": F.col("l_quantity"), "py": F.round(F.col("l_discount") * 100, 6)})


def item_sql(where: str) -> str:
    return f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM (SELECT *, l_quantity AS px, round(l_discount * 100, 6) AS py FROM lineitem) AS t WHERE {where}"


def inside_sql(rings, closed: bool = True) -> str:
    """Point in polygon as SQL: on an edge, or an odd number of edges crossed to the right."""
    edges = [(a, b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if a != b]
    on = [f"(abs(({bx - ax})::DOUBLE * (py - {ay}) - ({by - ay})::DOUBLE * (px - {ax})) <= {1e-9 * max(abs(bx - ax), abs(by - ay), 1.0)} AND px BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND py BETWEEN {min(ay, by)} AND {max(ay, by)})" for (ax, ay), (bx, by) in edges]
    crossed = [f"CASE WHEN ({by} > py) <> ({ay} > py) AND px < ({ax - bx})::DOUBLE * (py - {by}) / ({ay - by})::DOUBLE + {bx} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in edges if ay != by]
    return f"({' OR '.join(on)} OR ({' + '.join(crossed)}) % 2 = 1)"


RING = [(3.37, 0.41), (41.13, 1.57), (46.71, 8.93), (22.19, 9.83), (7.61, 6.29)]
HOLE = [(15.3, 2.7), (30.9, 2.9), (27.7, 6.1), (16.1, 5.3)]
GRID_RING = [(5.0, 1.0), (40.0, 1.0), (40.0, 8.0), (5.0, 8.0)]
GRID_HOLE = [(10.0, 3.0), (20.0, 3.0), (20.0, 5.0), (10.0, 5.0)]
MANY = [(25.003 + 21.017 * math.cos(k * 0.0981), 5.011 + 4.513 * math.sin(k * 0.0981)) for k in range(64)]


def points_query(name: str, relation: str, shape: g.Geometry, where: str, text: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = QueryFilter.where(text).and_related(relation, shape) if text else QueryFilter.related(relation, shape)
        return asked.apply(item_points(spark, sf_dir), point=("px", "py")).select(*LINE.split(", "))

    QUERIES[name], ORACLES[name] = run, item_sql(where)


points_query("spatial_envelope_points", ENVELOPE_INTERSECTS, g.polyline([(10, 2), (20, 5)]), "px BETWEEN 10 AND 20 AND py BETWEEN 2 AND 5")
points_query("spatial_intersects_points", INTERSECTS, g.polygon(RING), inside_sql([RING]))
points_query("spatial_donut", INTERSECTS, g.polygon(RING, HOLE), inside_sql([RING, HOLE]))
points_query("spatial_point_on_boundary", CONTAINS, g.polygon(GRID_RING, GRID_HOLE), "px BETWEEN 5 AND 40 AND py BETWEEN 1 AND 8 AND NOT (px > 10 AND px < 20 AND py > 3 AND py < 5)")
points_query("spatial_many_edges", INTERSECTS, g.polygon(MANY), inside_sql([MANY]))
points_query("spatial_point_in_point", INTERSECTS, g.multipoint([(17, 4), (30, 0)]), "(px = 17 AND py = 4) OR (px = 30 AND py = 0)")
points_query("combined_where_spatial", INTERSECTS, g.polygon(RING, HOLE), f"{inside_sql([RING, HOLE])} AND (l_returnflag = 'R' OR l_linestatus <> 'O') AND l_extendedprice >= 2000", "(l_returnflag = 'R' OR l_linestatus <> 'O') AND l_extendedprice >= 2000")


@query(item_sql(f"{inside_sql([GRID_HOLE])} AND l_linenumber = 1"))
def and_spatial_replaces(spark, sf_dir):
    asked = QueryFilter.where("l_linenumber = 1").and_related(INTERSECTS, g.polygon(RING)).and_related(CONTAINS, g.polygon(GRID_HOLE))
    return asked.apply(item_points(spark, sf_dir), point=("px", "py")).select(*LINE.split(", "))


# Parts as boxes: size by a hash of the key, so that bounds overlap in every way.

BOX_SQL = "(SELECT CAST(p_partkey + 1 AS BIGINT) AS OBJECTID, CAST(p_size AS DOUBLE) AS x0, CAST(p_partkey % 40 AS DOUBLE) AS y0, p_size + 1.0 + p_partkey % 5 AS x1, p_partkey % 40 + 2.0 + p_partkey % 3 AS y1, p_size FROM part) AS b"


def boxes(spark: SparkSession, sf_dir: str, **how) -> FeatureTable:
    x0, y0 = F.col("p_size").cast("double"), (F.col("p_partkey") % 40).cast("double")
    return table_of(spark, sf_dir, "part", g.box_shape(x0, y0, x0 + 1 + F.col("p_partkey") % 5, y0 + 2 + F.col("p_partkey") % 3), **how)


def box_query(name: str, relation: str, shape: g.Geometry, where: str, **how) -> None:
    QUERIES[name] = lambda spark, sf_dir: boxes(spark, sf_dir, **how).search(QueryFilter.related(relation, shape), [OID, "p_size"])
    ORACLES[name] = f"SELECT {OID}, p_size FROM {BOX_SQL} WHERE {where}"


FRAME = [(10.5, 5.5), (30.5, 5.5), (30.5, 25.5), (10.5, 25.5), (10.5, 5.5)]
EXACT = [(5.0, 2.0), (8.0, 2.0), (8.0, 6.0), (5.0, 6.0), (5.0, 2.0)]
OVERLAP = "x1 >= 10.5 AND x0 <= 30.5 AND y1 >= 5.5 AND y0 <= 25.5"
INSIDE = "x0 >= 10.5 AND x1 <= 30.5 AND y0 >= 5.5 AND y1 <= 25.5"
box_query("spatial_envelope", ENVELOPE_INTERSECTS, g.polygon(FRAME), OVERLAP)
box_query("spatial_box_box", INTERSECTS, g.polygon(FRAME), OVERLAP)
box_query("spatial_box_in_box_center", INTERSECTS, g.polygon([(-100, -100), (200, -100), (200, 200), (-100, 200), (-100, -100)]), "true")
box_query("spatial_contains", CONTAINS, g.polygon(FRAME), INSIDE)
box_query("spatial_within_documented", WITHIN, g.polygon(FRAME), INSIDE)
box_query("spatial_within_as_coded", WITHIN, g.polygon(EXACT), "x0 = 5 AND y0 = 2 AND x1 = 8 AND y1 = 6", within="as_coded")
box_query("spatial_boxes_many_edges", INTERSECTS, g.polygon([(10.5 + k, 5.5) for k in range(21)] + [(30.5, 6.5 + k) for k in range(20)] + [(10.5, 25.5), (10.5, 5.5)]), OVERLAP)
box_query("spatial_point_in_boxes", INTERSECTS, g.point(20.25, 11.75), "x0 <= 20.25 AND x1 >= 20.25 AND y0 <= 11.75 AND y1 >= 11.75")

SEGMENT = "(SELECT CAST(o_orderkey + 1 AS BIGINT) AS OBJECTID, CAST(o_orderkey % 97 AS DOUBLE) AS ax, CAST(o_custkey % 53 AS DOUBLE) AS ay, CAST(o_custkey % 89 AS DOUBLE) AS bx, CAST(o_orderkey % 61 AS DOUBLE) AS by_ FROM orders) AS s"


def clip_sql(x0: float, y0: float, x1: float, y1: float) -> str:
    """A segment against a rectangle whose sides no segment touches only: an end inside, or a side crossed."""
    ends = " OR ".join(f"({x} BETWEEN {x0} AND {x1} AND {y} BETWEEN {y0} AND {y1})" for x, y in (("ax", "ay"), ("bx", "by_")))
    across = [f"((ax - {x}) * (bx - {x}) <= 0 AND ax <> bx AND ay + (by_ - ay) * ({x} - ax) / nullif(bx - ax, 0) BETWEEN {y0} AND {y1})" for x in (x0, x1)]
    along = [f"((ay - {y}) * (by_ - {y}) <= 0 AND ay <> by_ AND ax + (bx - ax) * ({y} - ay) / nullif(by_ - ay, 0) BETWEEN {x0} AND {x1})" for y in (y0, y1)]
    return " OR ".join([ends, *across, *along])


@query(f"SELECT {OID} FROM {SEGMENT} WHERE {clip_sql(20.37, 11.41, 47.73, 33.59)}")
def spatial_segment_polygon(spark, sf_dir):
    point = lambda x, mx, y, my: ((F.col(x) % mx).cast("double"), (F.col(y) % my).cast("double"))
    shape = g.line_shape(point("o_orderkey", 97, "o_custkey", 53), point("o_custkey", 89, "o_orderkey", 61))
    asked = QueryFilter.intersecting(g.polygon([(20.37, 11.41), (47.73, 11.41), (47.73, 33.59), (20.37, 33.59), (20.37, 11.41)]))
    return table_of(spark, sf_dir, "orders", shape).search(asked, [OID])


@query(f"SELECT {OID}, p_size FROM {BOX_SQL} WHERE x0 BETWEEN 10.5 AND 30.5 AND y0 BETWEEN 5.5 AND 25.5")
def spatial_multipoint_first_vertex(spark, sf_dir):
    """Multipoints whose second point lies inside, but not the first, don't intersect; those whose first does, do."""
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 40).cast("double")
    parts = F.array(*[F.array(F.struct(a.alias("x"), b.alias("y"))) for a, b in ((x, y), (F.lit(20.0), F.lit(10.0)))])
    return table_of(spark, sf_dir, "part", g.shape(g.MULTIPOINT, parts)).search(QueryFilter.intersecting(g.polygon(FRAME)), [OID, "p_size"])


# Edits.

PRICE = f"SELECT CAST(o_orderkey + 1 AS BIGINT) AS {OID}, {{}} FROM orders"


@query(PRICE.format("CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 0.0 ELSE o_totalprice END AS o_totalprice"))
def update_where(spark, sf_dir):
    changed = table_of(spark, sf_dir, "orders").updated(QueryFilter.where("o_orderstatus = 'F' AND o_totalprice > 200000"), {"o_orderstatus": "X", "o_totalprice": 0.0})
    return changed.search(fields=FIELDS)


@query(PRICE.format("CASE WHEN o_orderkey IN (1, 2, 3) THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice"))
def update_oids(spark, sf_dir):
    return table_of(spark, sf_dir, "orders").updated(QueryFilter.by_oids([2, 3, 4]), {"o_totalprice": F.col("o_totalprice") * 2}).search(fields=[OID, "o_totalprice"])


@query(PRICE.format("prio").replace("FROM orders", "FROM (SELECT *, nullif(o_orderpriority, '5-LOW') AS prio FROM orders) AS t WHERE prio IS NULL OR prio <> '1-URGENT'"))
def delete_where(spark, sf_dir):
    rows = rows_of(spark, sf_dir, "orders").withColumn("prio", F.expr("nullif(o_orderpriority, '5-LOW')"))
    return FeatureTable("orders", rows, 1).deleted(QueryFilter.where("prio = '1-URGENT'")).search(fields=[OID, "prio"])


@query(f"{ORDERS} WHERE o_orderkey NOT IN (0, 4, 9)")
def delete_oids(spark, sf_dir):
    return table_of(spark, sf_dir, "orders").deleted(QueryFilter.by_oids([1, 5, 10, 99999999])).search(fields=FIELDS)


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 300000")
def dry_run_delete_count(spark, sf_dir):
    return table_of(spark, sf_dir, "orders").search(QueryFilter.where("o_totalprice > 300000")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(s_suppkey + 1 AS BIGINT) AS OBJECTID, s_name, s_acctbal FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) + 2 FROM supplier), 'new', NULL UNION ALL SELECT (SELECT max(s_suppkey) + 3 FROM supplier), NULL, 1.5")
def insert_rows(spark, sf_dir):
    table = FeatureTable.of("supplier", rows_of(spark, sf_dir, "supplier").select(OID, "s_name", "s_acctbal"))
    return table.inserted([{"s_name": "new"}, {"s_acctbal": 1.5}]).search()


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS OBJECTID, n_name FROM nation UNION ALL SELECT 25 + row_number() OVER (ORDER BY n_nationkey), n_name FROM nation WHERE n_regionkey = 1")
def insert_copies(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").coalesce(1)
    table = FeatureTable.of("nation", rows)
    return table.copied(QueryFilter.where("n_regionkey = 1")).search(fields=[OID, "n_name"])


@query("SELECT count(*) AS rows, count(*) AS ids, CAST(1 AS BIGINT) AS first, 2 * count(*) AS last, 2 * count(*) AS next_oid, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def insert_shuffled(spark, sf_dir):
    """Rows that come out of a skewed shuffle, made a table and inserted into it again."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("by")).repartition("by")
    table = FeatureTable.of("orders", rows)
    n = table.next_oid - 1
    table = table.inserted(rows)
    first = F.col(OID) <= n
    facts = [F.count_if(first).alias("rows"), (F.count_distinct(OID) - n).alias("ids"), F.min(OID).alias("first"), F.max(OID).alias("last"), F.lit(table.next_oid - 1).cast("long").alias("next_oid"), F.sum(F.when(first, F.col("o_orderkey"))).alias("keys")]
    return table.rows.agg(*facts)


@query("SELECT count(*) FILTER (WHERE o_totalprice <= 300000) AS kept, count(*) FILTER (WHERE o_totalprice > 300000) AS deleted FROM orders")
def delete_count(spark, sf_dir):
    left, n = table_of(spark, sf_dir, "orders").deleted_with_count(QueryFilter.where("o_totalprice > 300000"))
    return left.rows.agg(F.count(F.lit(1)).alias("kept"), F.lit(n).cast("long").alias("deleted"))


@query("SELECT CAST(s_suppkey + 1 AS BIGINT) AS OBJECTID FROM supplier QUALIFY row_number() OVER (ORDER BY s_suppkey) NOT IN (1, 4, 8)")
def delete_positions(spark, sf_dir):
    return table_of(spark, sf_dir, "supplier").deleted_positions([0, 3, 7]).search(fields=[OID])


def edited(spark: SparkSession, sf_dir: str, commit: bool) -> DataFrame:
    """A session over a workspace in files; what a commit wrote is read by another one."""
    workspace = Workspace.create(spark, scratch(spark, "workspace"))
    workspace.add_table("orders", rows_of(spark, sf_dir, "orders").select(*FIELDS))
    session = workspace.session()
    session.begin_transaction()
    session.edit("orders", lambda t: t.updated(QueryFilter.by_oid(1), {"o_orderstatus": "Z"}))
    session.start_operation()
    session.edit("orders", lambda t: t.deleted(QueryFilter.where("o_totalprice < 50000")))
    session.stop_operation()
    session.stop_operation()
    session.commit() if commit else session.abort()
    return (Workspace(spark, workspace.root) if commit else session).open("orders").search(fields=FIELDS)


@query(ORDERS)
def session_abort(spark, sf_dir):
    return edited(spark, sf_dir, commit=False)


@query(PRICE.format("CASE WHEN o_orderkey = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice") + " WHERE o_totalprice >= 50000")
def session_commit(spark, sf_dir):
    return edited(spark, sf_dir, commit=True)


# Geometry and conversions.


@query(f"SELECT {OID}, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM {BOX_SQL}")
def envelope_of_geom(spark, sf_dir):
    return boxes(spark, sf_dir).rows.select(OID, *[F.col(f"SHAPE_{b}").alias(b.lower()) for b in g.BOUNDS])


@query(f"SELECT {OID}, 2 * (x1 - x0) + 2 * (y1 - y0) AS length FROM {BOX_SQL}")
def geom_length(spark, sf_dir):
    return boxes(spark, sf_dir).rows.select(OID, g.length_of(F.col("SHAPE")).alias("length"))


@query("SELECT CAST(p_partkey + 1 AS BIGINT) AS OBJECTID, 'POINT(' || p_size || ' ' || (p_partkey % 8) // 2 || CASE WHEN p_partkey % 2 = 1 THEN '.5' ELSE '' END || ')' AS wkt FROM part")
def wkt_point(spark, sf_dir):
    return table_of(spark, sf_dir, "part", g.point_shape(F.col("p_size"), (F.col("p_partkey") % 8) / 2)).rows.select(OID, g.wkt_of(F.col("SHAPE")).alias("wkt"))


@query(f"SELECT {OID}, 'POLYGON(1 rings, 5 points)' AS wkt FROM {BOX_SQL}")
def wkt_polygon(spark, sf_dir):
    return boxes(spark, sf_dir).rows.select(OID, g.wkt_of(F.col("SHAPE")).alias("wkt"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round((l_extendedprice - (-400.0)::DOUBLE) * 1000.0::DOUBLE) AS BIGINT) AS cell, round((l_extendedprice - (-400.0)::DOUBLE) * 1000.0::DOUBLE) / 1000.0::DOUBLE + (-400.0)::DOUBLE AS back FROM lineitem")
def grid_quantize_roundtrip(spark, sf_dir):
    cell = scalars.to_grid(F.col("l_extendedprice"), -400.0, 1000.0)
    return rows_of(spark, sf_dir, "lineitem").select(*LINE.split(", ")[:4], cell.alias("cell"), scalars.from_grid(cell, -400.0, 1000.0).alias("back"))


@query(f"SELECT CAST(event_id + 1 AS BIGINT) AS {OID}, CAST(epoch_us(ts) + 2209161600000000 AS DOUBLE) / 86400000000.0::DOUBLE AS days, CAST(round(CAST(epoch_us(ts) + 2209161600000000 AS DOUBLE) / 86400000000.0::DOUBLE * 86400000000.0::DOUBLE) AS BIGINT) - 2209161600000000 AS micros FROM events")
def ole_date_roundtrip(spark, sf_dir):
    days = scalars.time_to_ole(F.col("ts"))
    return rows_of(spark, sf_dir, "events").select(OID, days.alias("days"), F.unix_micros(scalars.ole_to_time(days).cast("timestamp")).alias("micros"))


@query(f"SELECT CAST(event_id + 1 AS BIGINT) AS {OID}, strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END AS iso FROM events")
def iso_text(spark, sf_dir):
    return rows_of(spark, sf_dir, "events").select(OID, scalars.iso_text(F.col("ts")).alias("iso"))


@query("SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid, true AS same FROM (SELECT c_custkey, md5(c_name) AS h FROM customer) AS t")
def uuid_roundtrip(spark, sf_dir):
    raw = F.unhex(F.md5("c_name"))
    text = scalars.uuid_text(raw)
    return rows_of(spark, sf_dir, "customer").select("c_custkey", text.alias("uuid"), (scalars.uuid_bytes(F.concat(F.lit("{"), F.upper(text), F.lit("}"))) == raw).alias("same"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 30000 AS SMALLINT) END AS small, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_acctbal AS DOUBLE) END AS number,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-02-01 00:00:00' + to_days(CAST(c_custkey % 20 AS INTEGER)) + to_hours(CAST(c_custkey % 24 AS INTEGER)) END AS at FROM customer""")
def typed_values(spark, sf_dir):
    """Texts as values of a field's kind."""
    rows, key = rows_of(spark, sf_dir, "customer"), F.col("c_custkey")
    null = lambda n, text: F.when(key % n == 0, F.lit("NuLL")).otherwise(text)
    day, hour = F.lpad((key % 20 + 1).cast("string"), 2, "0"), F.lpad((key % 24).cast("string"), 2, "0")
    times = F.concat(F.lit("2024-02-"), day, F.when(key % 2 == 0, F.lit("T")).otherwise(F.lit(" ")), hour, F.lit(":00:00"))
    return rows.select("c_custkey", scalars.typed(null(7, (key % 30000).cast("string")), "int16").alias("small"), scalars.typed(null(5, F.col("c_acctbal").cast("string")), "float64").alias("number"), scalars.typed(null(3, times), "datetime").alias("at"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '<null>' ELSE CAST(user_id AS VARCHAR) END AS number, strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END AS at,
    '<binary ' || strlen(event_type) || ' bytes>' AS raw, CAST(event_id AS VARCHAR) || CASE WHEN event_id % 2 = 1 THEN '.5' ELSE '' END AS half FROM events""")
def shown_values(spark, sf_dir):
    """Values as the command line shows them."""
    rows, key = rows_of(spark, sf_dir, "events"), F.col("event_id")
    shown = {"number": (F.when(key % 4 != 0, F.col("user_id")), "int64"), "at": (F.col("ts"), "datetime"), "raw": (F.col("event_type").cast("binary"), "binary"), "half": (key + (key % 2) / 2, "float64")}
    return rows.select("event_id", *[scalars.shown_column(c, kind).alias(name) for name, (c, kind) in shown.items()])


@query("SELECT * FROM (VALUES ('Cities_Tbl', 'Table', NULL, NULL), ('Capitals', 'FeatureClass', 'POINT', NULL), ('Admin', 'FeatureDataset', NULL, NULL), ('Regions', 'FeatureClass', 'POLYGON', 'Admin')) AS t(name, item_type, geometry_type, parent_dataset)")
def catalog_list(spark, sf_dir):
    """The catalog of the sample geodatabase, read back from its files."""
    from parcela.cli import sample
    from parcela.sources.gdb.tables import catalog

    folder = scratch(spark, "gdb")
    sample(folder)
    rows = [(i.name, i.item_type, i.geometry_type, i.parent_dataset) for i in catalog(folder)]
    return spark.createDataFrame(rows, "name string, item_type string, geometry_type string, parent_dataset string")


@query("SELECT CAST(s_suppkey + 1 AS BIGINT) AS OBJECTID, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0 OR s_nationkey = 3")
def gdb_roundtrip(spark, sf_dir):
    """Suppliers written as a table of a geodatabase, read back with a filter."""
    from parcela.sources.gdb.datasource import GdbDataSource

    spark.dataSource.register(GdbDataSource)
    folder = scratch(spark, "gdb")
    rows_of(spark, sf_dir, "supplier").select(OID, "s_name", "s_nationkey", "s_acctbal").write.format("gdb").option("table", "Suppliers").mode("append").save(folder)
    rows = spark.read.format("gdb").option("table", "Suppliers").option("slotsPerPartition", 64).load(folder)
    return QueryFilter.where("s_acctbal > 0 OR s_nationkey = 3").apply(rows)


#: Suppliers' ids as UUIDs, their shapes and XML, in a geodatabase.
UUID_SQL = "printf('%08x-0000-4000-8000-%012x', s_suppkey, s_suppkey * 7)"
XML_SQL = "printf('<a n=\"%d\"/>', s_nationkey)"


def typed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of all the types that only the format tells apart from texts and bytes, written and read back."""
    from parcela.sources.gdb import datasource

    folder = scratch(spark, "gdb")
    x, y = F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 11) / F.lit(4.0)
    shape = g.box_shape(x, y, x + 1.5, y + 2 + F.col("s_suppkey") % 3)
    uuid, xml = F.format_string("%08x-0000-4000-8000-%012x", "s_suppkey", F.col("s_suppkey") * 7), F.format_string('<a n="%d"/>', "s_nationkey")
    facts = {"SHAPE": {"kind": "geometry", "geometry_type": g.POLYGON}, "KEY": {"kind": "uuid"}, "DOC": {"kind": "xml"}}
    made = {"SHAPE": F.when(F.col("s_suppkey") % 10 > 0, shape), "KEY": F.when(F.col("s_suppkey") % 7 > 0, uuid), "DOC": xml}
    rows = rows_of(spark, sf_dir, "supplier").select(OID, *[c.alias(name, metadata=facts[name]) for name, c in made.items()])
    spark.dataSource.register(datasource.GdbDataSource)
    rows.write.format("gdb").option("table", "Typed").mode("append").save(folder)
    return datasource.read(spark, folder, "Typed", slotsPerPartition=64)


TYPED = f"(SELECT CAST(s_suppkey + 1 AS BIGINT) AS {OID}, CASE WHEN s_suppkey % 7 > 0 THEN {UUID_SQL} END AS KEY, {XML_SQL} AS DOC, s_suppkey % 10 > 0 AS shaped, CAST(s_nationkey AS DOUBLE) AS x0, s_suppkey % 11 / 4 AS y0, s_suppkey % 3 AS more FROM supplier) AS t"


@query(f"SELECT {OID}, CASE WHEN shaped THEN x0 END AS xmin, CASE WHEN shaped THEN y0 END AS ymin, CASE WHEN shaped THEN x0 + 1.5 END AS xmax, CASE WHEN shaped THEN y0 + 2 + more END AS ymax, CASE WHEN shaped THEN CAST(5 AS BIGINT) END AS points, CASE WHEN shaped THEN 3 + 2.0 * (2 + more) END AS length FROM {TYPED}")
def gdb_geometry(spark, sf_dir):
    """Polygons written as shape blobs and read back: bounds, vertices and length, on the grid of the format."""
    rows = typed_table(spark, sf_dir)
    bounds = [F.round(f"SHAPE_{b}", 4).alias(b.lower()) for b in g.BOUNDS]
    points = F.when(F.col("SHAPE").isNotNull(), F.size(g.points_of(F.col("SHAPE")))).cast("long").alias("points")
    return rows.select(OID, *bounds, points, F.when(F.col("SHAPE").isNotNull(), F.round(g.length_of(F.col("SHAPE")), 4)).alias("length"))


def typed_filter(name: str, text: str, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: QueryFilter.where(text).apply(typed_table(spark, sf_dir)).select(OID, "KEY", "DOC")
    ORACLES[name] = f"SELECT {OID}, KEY, DOC FROM {TYPED} WHERE {where}"


typed_filter("where_uuid", "KEY >= '00000003-0000-4000-8000-000000000000' AND NOT KEY = '00000005-0000-4000-8000-000000000023' OR KEY = '0000000A-0000-4000-8000-000000000046'", "coalesce(KEY >= '00000003-0000-4000-8000-000000000000', false) AND KEY IS DISTINCT FROM '00000005-0000-4000-8000-000000000023'")
typed_filter("where_geometry", "SHAPE = 'x' OR SHAPE > 5 OR (SHAPE IS NULL AND NOT SHAPE = 1)", "NOT shaped")
typed_filter("where_xml", """DOC = '<a n="3"/>' OR DOC > '<a n="7'""", """DOC = '<a n="3"/>' OR DOC > '<a n="7'""")
