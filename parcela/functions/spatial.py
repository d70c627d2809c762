"""Spatial relations between a constant query geometry and the geometries of rows.

Relations follow vertices and segments with a tolerance, in the plane. Rows are first filtered by their bounds, which are
plain comparisons that reach the Parquet scan, then by the exact relation. For points against few edges that is unrolled
arithmetic inside generated code; for other rows, expressions over their nested points; against many edges, an Arrow UDF
that holds the query's edges as arrays.

Behaviour that is part of the definition: segments join consecutive points and rings are closed only for inside tests;
points on any ring count as inside; whether one geometry lies inside another is tested at its first point only; within
tests every vertex and nothing between them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce
from operator import and_, or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.functions.geometry import BOUNDS, POLYGON, POLYLINE, Geometry, Point, from_row
from parcela.functions.where import FilterError

EPS = 1e-9
#: More edges than this are not unrolled: the generated code would grow too large to be compiled.
UNROLLED_EDGES = 8
ENVELOPE_INTERSECTS, INTERSECTS, CONTAINS, WITHIN = "ENVELOPE_INTERSECTS", "INTERSECTS", "CONTAINS", "WITHIN"
RELATIONS = (ENVELOPE_INTERSECTS, INTERSECTS, CONTAINS, WITHIN)
Edge = tuple[Point, Point]


def open_edges(part) -> list[Edge]:
    return list(zip(part, part[1:], strict=False))


def closed_edges(ring) -> list[Edge]:
    return [(ring[i], ring[(i + 1) % len(ring)]) for i in range(len(ring))]


# Plain Python: one pair at a time, for tests, rows read one by one, and the Arrow UDF.


def cross(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def scale(a: Point, b: Point) -> float:
    return max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1.0)


def in_box(a: Point, b: Point, p: Point) -> bool:
    return min(a[0], b[0]) - EPS <= p[0] <= max(a[0], b[0]) + EPS and min(a[1], b[1]) - EPS <= p[1] <= max(a[1], b[1]) + EPS


def same_point(a: Point, b: Point) -> bool:
    return (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= EPS * EPS


def on_segment(a: Point, b: Point, p: Point) -> bool:
    return abs(cross(a, b, p)) <= EPS * scale(a, b) and in_box(a, b, p)


def segments_meet(p: Edge, q: Edge) -> bool:
    tolerance = EPS * max(scale(*p), scale(*q))
    sides = [cross(*q, p[0]), cross(*q, p[1]), cross(*p, q[0]), cross(*p, q[1])]
    apart = lambda s, t: s > tolerance and t < -tolerance or s < -tolerance and t > tolerance
    if apart(*sides[:2]) and apart(*sides[2:]):
        return True
    ends = ((q, p[0]), (q, p[1]), (p, q[0]), (p, q[1]))
    return any(abs(s) <= tolerance and in_box(*edge, end) for s, (edge, end) in zip(sides, ends, strict=True))


def crosses_ray(a: Point, b: Point, p: Point) -> bool:
    """Whether the edge crosses the ray from p to the right; a is the ring's point, b the one before it."""
    return (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]


def in_ring(ring, p: Point) -> bool:
    """Inside or on the closed ring."""
    return any(on_segment(a, b, p) for a, b in closed_edges(ring)) or sum(crosses_ray(b, a, p) for a, b in closed_edges(ring)) % 2 == 1


def in_polygon(rings, p: Point) -> bool:
    """On any ring, or inside an odd number of rings."""
    if any(on_segment(a, b, p) for ring in rings for a, b in closed_edges(ring)):
        return True
    return sum(crosses_ray(b, a, p) for ring in rings if len(ring) >= 3 for a, b in closed_edges(ring)) % 2 == 1


def in_rings(rings, p: Point) -> bool:
    """Inside or on an odd number of rings; unlike in_polygon(), a point on a hole's ring is outside."""
    return sum(in_ring(ring, p) for ring in rings) % 2 == 1


def on_line(part, p: Point) -> bool:
    return same_point(part[0], p) if len(part) == 1 else any(on_segment(a, b, p) for a, b in open_edges(part))


def lines_meet(a, b) -> bool:
    if not a or not b:
        return False
    if len(a) == 1 or len(b) == 1:
        return on_line(b, a[0]) if len(a) == 1 else on_line(a, b[0])
    return any(segments_meet(p, q) for p in open_edges(a) for q in open_edges(b))


def intersects(a: Geometry, b: Geometry) -> bool:
    """Whether any of their lines meet, or the first point of one lies in the other."""
    if any(lines_meet(p, q) for p in a.parts for q in b.parts):
        return True
    first = lambda g: g.parts[0][0] if g.parts and g.parts[0] else None
    return any(outer.kind == POLYGON and first(inner) is not None and in_polygon(outer.parts, first(inner)) for inner, outer in ((a, b), (b, a)))


def is_within(inner: Geometry, outer: Geometry) -> bool:
    """Whether every vertex of inner lies in, or on, outer."""
    points = inner.points
    if outer.kind == POLYGON:
        return bool(points) and all(in_polygon(outer.parts, p) for p in points)
    if outer.kind == POLYLINE:
        return bool(points) and all(any(part and on_line(part, p) for part in outer.parts) for p in points)
    return all(any(same_point(q, p) for q in outer.points) for p in points)


def boxes_meet(q, r) -> bool:
    return not (r[2] < q[0] or r[0] > q[2] or r[3] < q[1] or r[1] > q[3])


def box_inside(r, q) -> bool:
    return q[0] <= r[0] and q[1] <= r[1] and q[2] >= r[2] and q[3] >= r[3]


def related(relation: str, query: Geometry, row: Geometry | None, within: str = "documented") -> bool:
    """The relation for one row's geometry; false for none and for one without points."""
    if row is None or row.bounds is None:
        return False
    q, r = query.bounds, row.bounds
    if relation == ENVELOPE_INTERSECTS:
        return boxes_meet(q, r)
    if relation == INTERSECTS:
        return boxes_meet(q, r) and intersects(query, row)
    if relation == WITHIN and within == "as_coded":
        return box_inside(q, r) and is_within(row, query)
    return box_inside(r, q) and is_within(row, query)


# The same as Column expressions. A point is a pair of Columns or of floats.


def number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def least(*xs):
    return F.least(*map(number, xs)) if any(isinstance(x, Column) for x in xs) else min(xs)


def greatest(*xs):
    return F.greatest(*map(number, xs)) if any(isinstance(x, Column) for x in xs) else max(xs)


def absolute(x):
    return F.abs(x) if isinstance(x, Column) else abs(x)


def any_column(conditions: list[Column]) -> Column:
    return reduce(or_, conditions) if conditions else F.lit(False)


def in_box_column(a, b, p) -> Column:
    terms = [number(p[k]) >= number(least(a[k], b[k]) - EPS) for k in (0, 1)] + [number(p[k]) <= number(greatest(a[k], b[k]) + EPS) for k in (0, 1)]
    return reduce(and_, terms)


def scale_column(a, b):
    return greatest(absolute(b[0] - a[0]), absolute(b[1] - a[1]), 1.0)


def on_segment_column(a, b, p) -> Column:
    return (number(absolute(cross(a, b, p))) <= number(EPS * scale_column(a, b))) & in_box_column(a, b, p)


def same_point_column(a, b) -> Column:
    return number((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])) <= F.lit(EPS * EPS)


def segments_meet_column(p, q) -> Column:
    tolerance = number(EPS * greatest(scale_column(*p), scale_column(*q)))
    sides = [number(cross(*q, p[0])), number(cross(*q, p[1])), number(cross(*p, q[0])), number(cross(*p, q[1]))]
    apart = lambda s, t: ((s > tolerance) & (t < -tolerance)) | ((s < -tolerance) & (t > tolerance))
    ends = ((q, p[0]), (q, p[1]), (p, q[0]), (p, q[1]))
    return any_column([apart(*sides[:2]) & apart(*sides[2:]), *[(F.abs(s) <= tolerance) & in_box_column(*edge, end) for s, (edge, end) in zip(sides, ends, strict=True)]])


def crosses_ray_column(a, b, p) -> Column:
    """crosses_ray(); a division by nothing is null, and its edge counts as not crossed."""
    differ = (number(a[1]) > number(p[1])) != (number(b[1]) > number(p[1]))
    if isinstance(b[1] - a[1], Column):
        rise = F.nullif(b[1] - a[1], F.lit(0.0))
    elif b[1] == a[1]:
        return F.lit(False)
    else:
        rise = F.lit(float(b[1] - a[1]))
    return F.coalesce(differ & (number(p[0]) < number(b[0] - a[0]) * (number(p[1]) - number(a[1])) / rise + number(a[0])), F.lit(False))


def pair(p: Column) -> tuple[Column, Column]:
    return p["x"], p["y"]


def constant_polygon(rings, p) -> Column:
    """in_polygon() for constant rings, unrolled."""
    boundary = [on_segment_column(a, b, p) for ring in rings for a, b in closed_edges(ring)]
    crossed = [crosses_ray_column(b, a, p).cast("int") for ring in rings if len(ring) >= 3 for a, b in closed_edges(ring)]
    odd = reduce(lambda s, t: s + t, crossed) % 2 == 1 if crossed else F.lit(False)
    return any_column([*boundary, odd])


def row_edges(part: Column, closed: bool) -> Column:
    """The edges of a row's part, as structs a and b."""
    n = F.size(part)
    last = n if closed else n - 1
    at = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.get(part, i).alias("a"), F.get(part, (i + 1) % F.greatest(n, F.lit(1))).alias("b")))


def row_polygon(rings: Column, p) -> Column:
    """in_polygon() for a row's rings and a constant point."""
    boundary = F.exists(rings, lambda ring: F.exists(row_edges(ring, True), lambda e: on_segment_column(pair(e["a"]), pair(e["b"]), p)))
    full = F.filter(rings, lambda ring: F.size(ring) >= 3)
    crossed = F.aggregate(full, F.lit(0), lambda n, ring: n + F.size(F.filter(row_edges(ring, True), lambda e: crosses_ray_column(pair(e["b"]), pair(e["a"]), p))))
    return boundary | (crossed % 2 == 1)


def row_on_line(part: Column, p) -> Column:
    """on_line() for a row's part and a constant point."""
    return F.when(F.size(part) == 1, same_point_column(pair(F.get(part, F.lit(0))), p)).otherwise(F.exists(row_edges(part, False), lambda e: on_segment_column(pair(e["a"]), pair(e["b"]), p)))


def constant_on_line(part, p) -> Column:
    """on_line() for a constant part and a row's point."""
    return same_point_column(part[0], p) if len(part) == 1 else any_column([on_segment_column(a, b, p) for a, b in open_edges(part)])


def lines_meet_column(query_part, part: Column) -> Column:
    if not query_part:
        return F.lit(False)
    if len(query_part) == 1:
        return (F.size(part) > 0) & row_on_line(part, query_part[0])
    single = constant_on_line(query_part, pair(F.get(part, F.lit(0))))
    many = F.exists(row_edges(part, False), lambda e: any_column([segments_meet_column(edge, (pair(e["a"]), pair(e["b"]))) for edge in open_edges(query_part)]))
    return F.when(F.size(part) == 0, F.lit(False)).when(F.size(part) == 1, single).otherwise(many)


def intersects_column(query: Geometry, value: Column) -> Column:
    terms = [F.exists(value["parts"], partial(lines_meet_column, q)) for q in query.parts]
    first = F.get(F.get(value["parts"], F.lit(0)), F.lit(0))
    if query.kind == POLYGON:
        terms.append(first.isNotNull() & constant_polygon(query.parts, pair(first)))
    if query.parts and query.parts[0]:
        terms.append((value["gtype"] == POLYGON) & row_polygon(value["parts"], query.parts[0][0]))
    return any_column(terms)


def within_column(query: Geometry, points: Column) -> Column:
    if query.kind == POLYGON:
        return (F.size(points) > 0) & F.forall(points, lambda p: constant_polygon(query.parts, pair(p)))
    if query.kind == POLYLINE:
        return (F.size(points) > 0) & F.forall(points, lambda p: any_column([constant_on_line(part, pair(p)) for part in query.parts if part]))
    return F.forall(points, lambda p: any_column([same_point_column(q, pair(p)) for q in query.points]))


def point_column(relation: str, query: Geometry, p) -> Column:
    """The exact relation for rows that are single points."""
    if relation != INTERSECTS:
        if query.kind == POLYGON:
            return constant_polygon(query.parts, p)
        return any_column([constant_on_line(part, p) if query.kind == POLYLINE else same_point_column(part[0], p) for part in query.parts if part])
    closed = query.kind == POLYGON  # whose edges count as inside anyway; a ring of one point has none
    touching = [constant_on_line(part, p) for part in query.parts if part and not (closed and len(part) > 1)]
    return any_column([*touching, *([constant_polygon(query.parts, p)] if query.kind == POLYGON else [])])


class Edges:
    """A polygon's closed edges as arrays, to test many points at once."""

    def __init__(self, rings) -> None:
        edges = [(a, b, len(ring) >= 3) for ring in rings for a, b in closed_edges(ring)]
        self.a, self.b = (np.array([e[k] for e in edges], float).reshape(-1, 2).T for k in (0, 1))
        self.full = np.array([e[2] for e in edges], bool)

    def inside(self, x: np.ndarray, y: np.ndarray, block: int = 1 << 20) -> np.ndarray:
        """in_polygon() for every point, in blocks of points."""
        (ax, ay), (bx, by) = self.a[:, :, None], self.b[:, :, None]
        step = max(1, block // max(1, self.a.shape[1]))
        parts = []
        for i in range(0, len(x), step):
            px, py = x[None, i : i + step], y[None, i : i + step]
            side = np.abs((bx - ax) * (py - ay) - (by - ay) * (px - ax)) <= EPS * np.maximum(np.maximum(np.abs(bx - ax), np.abs(by - ay)), 1.0)
            near = (px >= np.minimum(ax, bx) - EPS) & (px <= np.maximum(ax, bx) + EPS) & (py >= np.minimum(ay, by) - EPS) & (py <= np.maximum(ay, by) + EPS)
            with np.errstate(divide="ignore", invalid="ignore"):
                crossed = ((by > py) != (ay > py)) & (px < (ax - bx) * (py - by) / (ay - by) + bx) & self.full[:, None]
            parts.append((side & near).any(axis=0) | (crossed.sum(axis=0) % 2 == 1))
        return np.concatenate(parts) if parts else np.zeros(0, bool)


def points_udf(relation: str, query: Geometry) -> Callable[[Column, Column], Column]:
    """The relation of single points to a polygon with many edges (a point on its lines is on its closed rings too)."""
    edges = Edges(query.parts)

    @F.pandas_udf(T.BooleanType())
    def inside(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(edges.inside(x.to_numpy(float, na_value=math.nan), y.to_numpy(float, na_value=math.nan)))

    return inside


def shapes_udf(relation: str, query: Geometry) -> Callable[[Column], Column]:
    """The relation of any geometries to a query with many edges."""

    @F.arrow_udf(T.BooleanType())
    def holds(kind: pa.Array, parts: pa.Array) -> pa.Array:
        test = intersects if relation == INTERSECTS else lambda q, r: is_within(r, q)
        rows = (from_row({"gtype": k, "parts": p}) if k is not None and p is not None else None for k, p in zip(kind.to_pylist(), parts.to_pylist(), strict=True))
        return pa.array([r is not None and test(query, r) for r in rows], pa.bool_())

    return lambda value: holds(value["gtype"], value["parts"])


def spatial_condition(relation: str, query: Geometry, name: str = "SHAPE", point: tuple[str, str] | None = None, within: str = "documented") -> Column:
    """The relation as a Column over a table with SHAPE and its bounds, or with the coordinates of points in two columns.

    within: "documented" finds rows that lie within the query; "as_coded" asks besides that the row's bounds hold the
    query's, which leaves rows with equal bounds only.
    """
    if relation not in RELATIONS:
        raise FilterError(f"no relation {relation}")
    if query.bounds is None:
        raise FilterError("a spatial filter needs a geometry with points")
    xmin, ymin, xmax, ymax = (F.col(c) for c in (point * 2 if point else [f"{name}_{b}" for b in BOUNDS]))
    q = [F.lit(v) for v in query.bounds]
    if relation in (ENVELOPE_INTERSECTS, INTERSECTS):
        bounds = (xmax >= q[0]) & (xmin <= q[2]) & (ymax >= q[1]) & (ymin <= q[3])
    elif relation == WITHIN and within == "as_coded":
        bounds = (xmin <= q[0]) & (ymin <= q[1]) & (xmax >= q[2]) & (ymax >= q[3])
    else:
        bounds = (xmin >= q[0]) & (ymin >= q[1]) & (xmax <= q[2]) & (ymax <= q[3])
    if relation == ENVELOPE_INTERSECTS:
        return bounds
    many = sum(len(part) for part in query.parts) > UNROLLED_EDGES
    if point:
        x, y = (F.col(c).cast("double") for c in point)
        return bounds & (points_udf(relation, query)(x, y) if many and query.kind == POLYGON else point_column(relation, query, (x, y)))
    value = F.col(name)
    if many:
        return bounds & shapes_udf(relation, query)(value)
    return bounds & (intersects_column(query, value) if relation == INTERSECTS else within_column(query, F.flatten(value["parts"])))


def spatial_truth(relation: str, query: Geometry, **how) -> Column:
    """spatial_condition(), never null."""
    return F.coalesce(spatial_condition(relation, query, **how), F.lit(False))
