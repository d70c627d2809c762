"""Two-dimensional geometry: values, the column type, and measures as Column expressions.

A geometry is a kind and parts, each a sequence of points: a point is one part of one point, a multipoint has a part for
each point, a polyline and a polygon have their parts and rings. Rows hold the struct SHAPE and, beside it, the bounds
SHAPE_XMIN to SHAPE_YMAX, whose Parquet statistics prune files and row groups.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.functions.where import plain_number

POINT, MULTIPOINT, POLYLINE, POLYGON = "POINT", "MULTIPOINT", "POLYLINE", "POLYGON"
#: Codes of the layer types. Fixed values.
LAYER_CODES = {None: 0, POINT: 1, MULTIPOINT: 2, POLYLINE: 3, POLYGON: 4, "ENVELOPE": 5, "MULTIPATCH": 9}
SHAPE = "struct<gtype:string,parts:array<array<struct<x:double,y:double>>>>"
SHAPE_TYPE = T.StructType([T.StructField("gtype", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))])
BOUNDS = ("XMIN", "YMIN", "XMAX", "YMAX")
Point = tuple[float, float]
Parts = tuple[tuple[Point, ...], ...]


@dataclass(frozen=True)
class Geometry:
    """A geometry value, as used to query or to write."""

    kind: str
    parts: Parts

    @classmethod
    def of(cls, kind: str, parts) -> Geometry:
        return cls(kind, tuple(tuple((float(x), float(y)) for x, y in part) for part in parts))

    @property
    def points(self) -> list[Point]:
        return [p for part in self.parts for p in part]

    @property
    def bounds(self) -> tuple[float, float, float, float] | None:
        """xmin, ymin, xmax, ymax; None for a geometry without points."""
        if not self.points:
            return None
        xs, ys = zip(*self.points, strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def row(self) -> dict:
        return {"gtype": self.kind, "parts": [[{"x": x, "y": y} for x, y in part] for part in self.parts]}

    def __str__(self) -> str:
        pair = lambda p: f"{plain_number(p[0])} {plain_number(p[1])}"
        if self.kind == POINT:
            return f"POINT({pair(self.parts[0][0])})"
        if self.kind == MULTIPOINT:
            return f"MULTIPOINT({','.join(f'({pair(p)})' for p in self.points)})"
        return f"{self.kind}({len(self.parts)} {'rings' if self.kind == POLYGON else 'parts'}, {len(self.points)} points)"


def point(x: float, y: float) -> Geometry:
    return Geometry.of(POINT, [[(x, y)]])


def multipoint(points) -> Geometry:
    return Geometry.of(MULTIPOINT, [[p] for p in points])


def polyline(*parts) -> Geometry:
    return Geometry.of(POLYLINE, parts)


def polygon(*rings) -> Geometry:
    return Geometry.of(POLYGON, rings)


def from_row(row) -> Geometry | None:
    """The value of a SHAPE struct, given as a Row or dict."""
    if row is None:
        return None
    return Geometry.of(row["gtype"], [[(p["x"], p["y"]) for p in part] for part in row["parts"]])


def literal(geometry: Geometry) -> Column:
    parts = F.array(*[F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in part]) for part in geometry.parts])
    return F.struct(F.lit(geometry.kind).alias("gtype"), parts.alias("parts")).cast(SHAPE)


def shape(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("gtype"), parts.alias("parts"))


def point_shape(x: Column, y: Column) -> Column:
    """SHAPE of a point column; null where a coordinate is."""
    at = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.when(x.isNotNull() & y.isNotNull(), shape(POINT, F.array(F.array(at))))


def line_shape(*points: tuple[Column, Column], kind: str = POLYLINE) -> Column:
    """SHAPE of one part through these points."""
    return shape(kind, F.array(F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])))


def box_shape(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return line_shape((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin), kind=POLYGON)


def points_of(value: Column) -> Column:
    return F.flatten(value["parts"])


def bounds_of(value: Column) -> list[Column]:
    """xmin, ymin, xmax, ymax of a SHAPE; null for one without points."""
    xs, ys = F.transform(points_of(value), lambda p: p["x"]), F.transform(points_of(value), lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def with_bounds(df, name: str = "SHAPE"):
    """Adds the bounds of a SHAPE column, for pruning."""
    return df.withColumns({f"{name}_{b}": c for b, c in zip(BOUNDS, bounds_of(F.col(name)), strict=True)})


def length_of(value: Column) -> Column:
    """The length of all parts, or the perimeter of all rings, as their points stand."""
    step = lambda part: F.zip_with(F.slice(part, 1, F.greatest(F.size(part) - 1, F.lit(0))), F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))), lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)))
    add = lambda total, x: total + x
    return F.aggregate(value["parts"], F.lit(0.0), lambda total, part: total + F.aggregate(step(part), F.lit(0.0), add))


def number_text(x: Column) -> Column:
    """A double without exponent, and without fraction if it is whole."""
    text, whole = x.cast("string"), x.try_cast("decimal(38,0)")
    plain = F.coalesce(F.when(x == whole, whole.cast("string")), F.regexp_replace(x.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", ""), text)
    return F.when(text.contains("E"), plain).otherwise(F.regexp_replace(text, r"\.0$", ""))


def wkt_of(value: Column) -> Column:
    """The summary text: points with their coordinates, other kinds with their counts."""
    pair = lambda p: F.concat(number_text(p["x"]), F.lit(" "), number_text(p["y"]))
    points, kind, n = points_of(value), value["gtype"], F.size(value["parts"]).cast("string")
    unit = F.when(kind == POLYGON, F.lit(" rings, ")).otherwise(F.lit(" parts, "))
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(kind == POINT, F.concat(F.lit("POINT("), pair(F.get(points, F.lit(0))), F.lit(")")))
        .when(kind == MULTIPOINT, F.concat(F.lit("MULTIPOINT("), F.array_join(F.transform(points, lambda p: F.concat(F.lit("("), pair(p), F.lit(")"))), ","), F.lit(")")))
        .otherwise(F.concat(kind, F.lit("("), n, unit, F.size(points).cast("string"), F.lit(" points)")))
    )


def parse_xy(text: str) -> Point:
    found = re.fullmatch(r"([^,]*),([^,]*)", text)
    if not found:
        raise ValueError(f"a point has the form x,y: {text}")
    return float(found[1].strip()), float(found[2].strip())
