import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcela.functions import geometry as g
from parcela.functions import spatial as s
from parcela.functions.where import FilterError

SQUARE = g.polygon([(0, 0), (10, 0), (10, 10), (0, 10)])
DONUT = g.polygon([(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (4, 6), (6, 6), (6, 4)])


def test_points_and_polygons():
    assert s.in_polygon(DONUT.parts, (1, 1)) and not s.in_polygon(DONUT.parts, (5, 5)) and s.in_polygon(DONUT.parts, (4, 5))
    assert not s.in_rings(DONUT.parts, (4, 5)) and s.in_ring(SQUARE.parts[0], (10, 3))


@pytest.mark.parametrize(("edge", "meets"), [(((5, -5), (5, 5)), True), (((5, 0), (5, 5)), True), (((5, 0), (15, 0)), True), (((0, 1), (10, 1)), False), (((11, 0), (12, 0)), False)])
def test_segments(edge, meets):
    assert s.segments_meet(((0, 0), (10, 0)), edge) == meets


def test_lines_polygons_and_multipoints():
    assert s.intersects(g.polyline([(-5, 5), (15, 5)]), SQUARE) and s.intersects(g.polyline([(1, 1), (3, 3)]), SQUARE)
    assert not s.intersects(g.polyline([(20, 20), (30, 30)]), SQUARE)
    small = g.polygon([(2, 2), (4, 2), (4, 4), (2, 4)])
    assert s.is_within(small, SQUARE) and s.intersects(SQUARE, small)
    assert not s.is_within(g.polygon([(8, 8), (12, 8), (12, 12), (8, 12)]), SQUARE)
    inside, outside = g.multipoint([(1, 1), (2, 2), (3, 3)]), g.multipoint([(50, 50)])
    assert s.is_within(inside, SQUARE) and s.intersects(inside, SQUARE) and not s.intersects(outside, SQUARE)
    assert not s.intersects(SQUARE, g.multipoint([(50, 50), (5, 5)]))  # only the first point is tested inside


def test_open_rings_are_not_closed_for_lines():
    """The missing edge of an open ring counts for inside tests only."""
    ring = g.polygon([(0, 0), (10, 0), (10, 10), (0, 10)])
    assert not s.intersects(g.polyline([(-1, 2), (-1, 8)]), ring)
    line = g.polyline([(-5, 5), (-0.5, 5), (0.5, 5)])
    assert not any(s.lines_meet(line.parts[0], part) for part in ring.parts)


def random_shape(rng):
    p = lambda: (rng.choice([rng.randint(0, 8), rng.uniform(0, 8)]), rng.choice([rng.randint(0, 8), rng.uniform(0, 8)]))
    kind = rng.choice(["point", "multi", "line", "polygon"])
    if kind == "point":
        return g.point(*p())
    if kind == "multi":
        return g.multipoint([p() for _ in range(rng.randint(1, 3))])
    parts = [[p() for _ in range(rng.randint(1 if kind == "line" else 3, 5))] for _ in range(rng.randint(1, 2))]
    return g.polyline(*parts) if kind == "line" else g.polygon(*[r + [r[0]] * rng.randint(0, 1) for r in parts])


def test_columns_match_plain_python(spark):
    rng = random.Random(5)
    shapes = [random_shape(rng) for _ in range(120)] + [None, g.Geometry(g.POLYLINE, ()), g.point(math.nan, 1)]
    rows = g.with_bounds(spark.createDataFrame([(i, x and x.row()) for i, x in enumerate(shapes)], f"id int, SHAPE {g.SHAPE}")).coalesce(1)
    many = g.polygon([(4 + 3 * math.cos(k / 4), 4 + 3 * math.sin(k / 4)) for k in range(25)])
    for query in [random_shape(rng) for _ in range(6)] + [DONUT, many]:
        for relation in s.RELATIONS:
            got = {r.id for r in rows.where(s.spatial_condition(relation, query)).select("id").collect()}
            want = {i for i, x in enumerate(shapes[:-1]) if s.related(relation, query, x)}
            assert got - {len(shapes) - 1} == want, (query, relation)


def test_point_columns(spark):
    rng = random.Random(7)
    points = [(rng.choice([rng.randint(0, 10), rng.uniform(0, 10)]), rng.choice([rng.randint(0, 10), rng.uniform(0, 10)])) for _ in range(300)]
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, x double, y double").coalesce(1)
    many = g.polygon([(5 + 4 * math.cos(k / 6), 5 + 4 * math.sin(k / 6)) for k in range(37)], [(4, 4), (4, 6), (6, 6), (6, 4)])
    for query in (DONUT, many, g.polyline([(0, 0), (5, 5), (5, 9)]), g.multipoint([(1, 1), (3, 4)])):
        for relation in s.RELATIONS:
            got = {r.id for r in rows.where(s.spatial_condition(relation, query, point=("x", "y"))).select("id").collect()}
            assert got == {i for i, (x, y) in enumerate(points) if s.related(relation, query, g.point(x, y))}


def test_within_as_coded(spark):
    box = lambda a, b: g.polygon([(a, a), (b, a), (b, b), (a, b), (a, a)])
    rows = g.with_bounds(spark.createDataFrame([(1, box(2, 3).row()), (2, box(0, 10).row()), (3, box(-1, 11).row())], f"id int, SHAPE {g.SHAPE}"))
    found = lambda how: [r.id for r in rows.where(s.spatial_condition(s.WITHIN, box(0, 10), within=how)).collect()]
    assert found("documented") == [1, 2] and found("as_coded") == [2]


def test_errors():
    with pytest.raises(FilterError):
        s.spatial_condition(s.INTERSECTS, g.Geometry(g.POLYGON, ()))
    with pytest.raises(FilterError):
        s.spatial_condition("TOUCHES", SQUARE)


def test_measures(spark):
    ring = [(40538389.490, 3044658.394), (40538499.680, 3044695.035), (40538449.010, 3044778.332), (40538389.490, 3044742.125), (40538389.490, 3044658.394)]
    rows = spark.createDataFrame([(g.polygon(ring).row(),), (g.point(1.5, -2).row(),), (g.multipoint([(1, 2), (1e-7, 1e21)]).row(),)], f"SHAPE {g.SHAPE}").coalesce(1)
    got = rows.select(g.length_of(F.col("SHAPE")), g.wkt_of(F.col("SHAPE")), *g.bounds_of(F.col("SHAPE"))).collect()
    assert got[0][0] == pytest.approx(367.01885752436857, abs=1e-9) and got[0][1] == "POLYGON(1 rings, 5 points)"
    assert got[1][1] == "POINT(1.5 -2)" == str(g.point(1.5, -2)) and list(got[1])[2:] == [1.5, -2, 1.5, -2]


@settings(max_examples=200, deadline=None)
@given(st.tuples(*[st.integers(0, 6)] * 8))
def test_segments_are_symmetric(c):
    p, q = ((c[0], c[1]), (c[2], c[3])), ((c[4], c[5]), (c[6], c[7]))
    assert s.segments_meet(p, q) == s.segments_meet(q, p) == s.segments_meet(p[::-1], q)
