"""Bytes of the format: numbers, field definitions, rows and geometries.

All numbers are little-endian. A row is its length, a bit for each nullable field (set: null) and the values of the
others in field order; the object id isn't stored, it is the row's slot plus one. Coordinates are integers on the
geometry field's grid, as differences from point to point.
"""

from __future__ import annotations

import datetime
import math
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from parcela.functions.geometry import LAYER_CODES, MULTIPOINT, POINT, POLYGON, POLYLINE, Geometry
from parcela.functions.scalars import GRID_ORIGIN, GRID_SCALE, ole_days, ole_time, parse_uuid, uuid_of

#: Codes of the field types. Fixed values.
KINDS = {0: "int16", 1: "int32", 2: "float32", 3: "float64", 4: "string", 5: "datetime", 6: "oid", 7: "geometry", 8: "binary", 9: "raster", 10: "uuid", 11: "uuid", 12: "xml", 13: "int64", 14: "date", 15: "time"}
CODES = {kind: code for code, kind in reversed(KINDS.items())}
NUMBERS = {"int16": "<h", "int32": "<i", "int64": "<q", "float32": "<f", "float64": "<d"}
TIMES = ("datetime", "date", "time")
#: Codes of the shapes, plain and with Z or M, by kind. Fixed values.
SHAPES = {POINT: (1, 9, 11, 21, 52), POLYLINE: (3, 10, 13, 23, 50), POLYGON: (5, 15, 19, 25, 51), MULTIPOINT: (8, 18, 20, 28, 53)}
SHAPE_KINDS = {code: kind for kind, codes in SHAPES.items() for code in codes}
HAS_Z, HAS_M, HAS_CURVES = 0x80000000, 0x40000000, 0x20000000
NULLABLE, REQUIRED, EDITABLE = 1, 2, 4
MASK = (1 << 64) - 1


class FormatError(ValueError):
    """Bytes that aren't of the format, or a shape that isn't supported."""


class Input:
    """Reads numbers from bytes, from a place on."""

    def __init__(self, data: bytes | memoryview, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, form: str) -> int | float:
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise FormatError("the data ends too early")
        self.at += size
        return struct.unpack_from(form, self.data, self.at - size)[0]

    def bytes(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError("the data ends too early")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def byte(self) -> int:
        return self.take("<B")

    def unsigned(self) -> int:
        """A number in groups of seven bits, the lowest first; bit 7 says that another follows."""
        value = shift = 0
        while True:
            byte = self.byte()
            value |= (byte & 127) << shift
            if byte < 128:
                return value & MASK
            shift += 7
            if shift >= 64:
                raise FormatError("a number is too long")

    def signed(self) -> int:
        """Like unsigned(), but the first group has six bits, and bit 6 says that the number is negative."""
        first = byte = self.byte()
        value, shift = byte & 63, 6
        while byte > 127:
            if shift >= 64:
                raise FormatError("a number is too long")
            byte = self.byte()
            value |= (byte & 127) << shift
            shift += 7
        return -value if first & 64 else value

    def utf16(self, units: int) -> str:
        return self.bytes(2 * units).decode("utf-16-le", "replace")


def unsigned(value: int) -> bytes:
    value, out = value & MASK, bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes((*out, value))


def signed(value: int) -> bytes:
    size = abs(value)
    first, size = size & 63 | 64 * (value < 0), size >> 6
    return bytes((first | 128,)) + unsigned(size) if size else bytes((first,))


@dataclass(frozen=True)
class Grid:
    """Origin and scale of coordinates; M and Z have their own, which only matter for writing them again."""

    x: float = GRID_ORIGIN
    y: float = GRID_ORIGIN
    scale: float = GRID_SCALE
    m: tuple[float, float] = (-1e9, 1e9)
    z: tuple[float, float] = (-1e9, 1e9)
    tolerance: float = 0.001
    m_tolerance: float = 0.001
    z_tolerance: float = 0.001
    extent: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    sizes: tuple[float, ...] = ()

    def cell(self, value: float, origin: float) -> int:
        """The nearest whole number on the grid, halves away from zero."""
        scaled = (value - origin) * self.scale
        if scaled != scaled:
            return 0
        nearest = math.copysign(math.floor(abs(scaled)) + (abs(scaled) - math.floor(abs(scaled)) >= 0.5), scaled) if math.isfinite(scaled) else scaled
        return int(max(min(nearest, 2**63 - 1), -(2**63)))

    def cells(self, p: tuple[float, float]) -> tuple[int, int]:
        return self.cell(p[0], self.x), self.cell(p[1], self.y)

    def point(self, x: int, y: int) -> tuple[float, float]:
        return x / self.scale + self.x, y / self.scale + self.y


@dataclass(frozen=True)
class Field:
    """A field's definition."""

    name: str
    kind: str
    alias: str = ""
    nullable: bool = True
    required: bool = False
    editable: bool = True
    length: int = 0
    default: object = None
    srs_wkt: str = ""
    grid: Grid = field(default_factory=Grid)
    has_z: bool = False
    has_m: bool = False
    code: int | None = None

    @property
    def flags(self) -> int:
        return NULLABLE * self.nullable | REQUIRED * self.required | EDITABLE * self.editable


OBJECT_ID = Field("OBJECTID", "oid", nullable=False, required=True, editable=False)


@dataclass(frozen=True)
class Schema:
    """A table's fields, and what holds for the whole table."""

    fields: tuple[Field, ...]
    geometry_type: str | None = None
    has_z: bool = False
    has_m: bool = False
    utf8: bool = True

    def index(self, name: str) -> int | None:
        return next((i for i, f in enumerate(self.fields) if f.name == name), None)

    @property
    def shape(self) -> Field | None:
        return next((f for f in self.fields if f.kind == "geometry"), None)


def decoded_default(raw: bytes, kind: str):
    if kind in NUMBERS and len(raw) == struct.calcsize(NUMBERS[kind]):
        return struct.unpack(NUMBERS[kind], raw)[0]
    return ole_time(struct.unpack("<d", raw)[0]) if kind in TIMES and len(raw) == 8 else None


def default_text(raw: bytes) -> str:
    """A string's default, which some files hold as UTF-16: those have zeros in at least half of the high bytes."""
    wide = len(raw) >= 2 and len(raw) % 2 == 0 and 2 * raw[1::2].count(0) >= len(raw) // 2
    return raw.decode("utf-16-le" if wide else "utf-8", "replace")


def read_field(source: Input, has_z: bool, has_m: bool) -> Field:
    name, alias = source.utf16(source.byte()), source.utf16(source.byte())
    code = source.byte()
    kind = KINDS.get(code, "other")
    facts: dict = {"code": code if kind == "other" else None}
    if kind == "string":
        facts["length"], flags = source.take("<i"), source.byte()
        size = source.unsigned()
        if flags & EDITABLE and size:
            facts["default"] = default_text(source.bytes(size))
    elif kind in ("oid", "binary", "raster", "uuid", "xml"):
        source.byte()
        flags = source.byte()
        flags = REQUIRED if kind == "oid" else flags
    elif kind == "geometry":
        source.byte()
        flags = source.byte()
        facts["srs_wkt"] = source.bytes(source.take("<H")).decode("utf-16-le", "replace")
        groups = source.byte()
        two = lambda: (source.take("<d"), source.take("<d"))
        x, y, scale = source.take("<d"), source.take("<d"), source.take("<d")
        m, z = (two() if groups & bit else pair for bit, pair in ((2, Grid.m), (4, Grid.z)))
        tolerance = source.take("<d")
        m_tolerance, z_tolerance = (source.take("<d") if groups & bit else 0.001 for bit in (2, 4))
        extent = (*two(), *two())
        for has in (has_z, has_m):
            has and two()
        source.byte()
        sizes = tuple(source.take("<d") for _ in range(source.take("<I")))
        facts |= {"grid": Grid(x, y, scale, m, z, tolerance, m_tolerance, z_tolerance, extent, sizes), "has_z": has_z, "has_m": has_m}
    else:
        source.byte()
        flags = source.byte()
        size = source.byte()
        if flags & EDITABLE and size:
            facts["default"] = decoded_default(source.bytes(size), kind)
    return Field(name, kind, alias, bool(flags & NULLABLE), bool(flags & REQUIRED), bool(flags & EDITABLE), **facts)


def named(text: str) -> bytes:
    raw = text.encode("utf-16-le")
    return bytes((len(raw) // 2,)) + raw


def write_field(f: Field, schema: Schema) -> bytes:
    head = named(f.name) + named(f.alias) + bytes((f.code if f.code is not None else CODES[f.kind],))
    if f.kind == "string":
        default = f.default.encode() if f.editable and isinstance(f.default, str) else b""
        return head + struct.pack("<iB", f.length, f.flags) + unsigned(len(default)) + default
    if f.kind in ("oid", "binary", "raster", "uuid", "xml"):
        return head + bytes(({"oid": 4, "uuid": 38}.get(f.kind, 0), f.flags))
    if f.kind == "geometry":
        g, wkt = f.grid, f.srs_wkt.encode("utf-16-le")
        has_m, has_z = f.has_m or schema.has_m, f.has_z or schema.has_z
        values = [g.x, g.y, g.scale, *g.m * has_m, *g.z * has_z, g.tolerance, *[g.m_tolerance] * has_m, *[g.z_tolerance] * has_z, *g.extent, *[0.0] * (2 * (has_z + has_m))]
        body = struct.pack("<BBH", 0, f.flags, len(wkt)) + wkt + bytes((1 | 2 * has_m | 4 * has_z,)) + struct.pack(f"<{len(values)}d", *values)
        return head + body + struct.pack(f"<BI{len(g.sizes)}d", 0, len(g.sizes), *g.sizes)
    default = b""
    if f.editable and f.default is not None:
        default = struct.pack(NUMBERS[f.kind], f.default) if f.kind in NUMBERS else struct.pack("<d", ole_days(f.default))
    width = struct.calcsize(NUMBERS[f.kind]) if f.kind in NUMBERS else 8 if f.kind in TIMES else 0
    return head + bytes((width, f.flags, len(default))) + default


def read_schema(section: bytes) -> Schema:
    """The schema of a field section, which begins with its own length."""
    source = Input(section, 8)
    layer = source.take("<I")
    has_z, has_m = bool(layer & HAS_Z), bool(layer & HAS_M)
    kinds = {code: kind for kind, code in LAYER_CODES.items()}
    fields = tuple(read_field(source, has_z, has_m) for _ in range(source.take("<H")))
    return Schema(fields, kinds.get(layer & 255), has_z, has_m, bool(layer & 256))


def write_schema(schema: Schema, version: int) -> bytes:
    layer = LAYER_CODES[schema.geometry_type] | HAS_Z * schema.has_z | HAS_M * schema.has_m | 256 * schema.utf8
    body = struct.pack("<IIH", 6 if version == 4 else 4, layer, len(schema.fields)) + b"".join(write_field(f, schema) for f in schema.fields)
    return struct.pack("<I", len(body)) + body


def read_geometry(blob: bytes, grid: Grid) -> Geometry:
    source = Input(blob)
    shape = source.unsigned() & 0xFFFFFFFF
    kind = SHAPE_KINDS.get(shape & 255)
    if kind is None:
        raise FormatError(f"shapes of code {shape & 255} are not supported")
    if kind == POINT:
        x, y = source.unsigned(), source.unsigned()
        if not x or not y:
            raise FormatError("a point without coordinates")
        to_signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
        return Geometry(kind, ((grid.point(to_signed(x) - 1, to_signed(y) - 1),),))
    n = source.unsigned()
    if not n:
        return Geometry(kind, ())
    if kind == MULTIPOINT:
        counts = [1] * n
    else:
        n_parts = source.unsigned()
        if shape & HAS_CURVES and source.unsigned():
            raise FormatError("curves are not supported")
        if not n_parts:
            return Geometry(kind, ())
        counts = []
    for _ in range(4):  # the bounds
        source.unsigned()
    if kind != MULTIPOINT:
        counts = [source.unsigned() for _ in range(n_parts - 1)]
        if sum(counts) > n:
            raise FormatError("the parts have more points than the shape")
        counts.append(n - sum(counts))
    x = y = 0
    points = []
    for _ in range(n):
        x += source.signed()
        y += source.signed()
        points.append(grid.point(x, y))
    parts, at = [], 0
    for count in counts:
        parts.append(tuple(points[at : at + count]))
        at += count
    return Geometry(kind, tuple(parts))


def write_geometry(geometry: Geometry, grid: Grid, has_z: bool = False, has_m: bool = False) -> bytes:
    """The blob; Z and M, where the table has them, are zero."""
    out = unsigned(SHAPES[geometry.kind][0] | HAS_Z * has_z | HAS_M * has_m)
    cells = [grid.cells(p) for p in geometry.points]
    if geometry.kind == POINT:
        (x, y), extra = cells[0], unsigned(1) * (has_z + has_m)
        if x < 0 or y < 0:
            raise FormatError(f"{geometry} lies outside the grid")
        return out + unsigned(x + 1) + unsigned(y + 1) + extra
    out += unsigned(len(cells))
    if not cells:
        return out
    if geometry.kind != MULTIPOINT:
        out += unsigned(len(geometry.parts))
    xs, ys = zip(*cells, strict=True)
    out += b"".join(map(unsigned, (min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys))))
    if geometry.kind != MULTIPOINT:
        out += b"".join(unsigned(len(part)) for part in geometry.parts[:-1])
    steps = bytearray()
    before = (0, 0)
    for cell in cells:
        steps += signed(cell[0] - before[0]) + signed(cell[1] - before[1])
        before = cell
    return out + bytes(steps) + bytes(len(cells) * (has_z + has_m))


def read_value(source: Input, f: Field, utf8: bool, strict: bool):
    if f.kind in NUMBERS:
        return source.take(NUMBERS[f.kind])
    if f.kind in TIMES:
        days = source.take("<d")
        try:
            return ole_time(days)
        except (OverflowError, ValueError):
            if strict:
                raise FormatError(f"{f.name} is out of range") from None
            return None
    if f.kind == "uuid":
        return uuid_of(source.bytes(16))
    if f.kind == "other":
        source.at = len(source.data)
        return b""
    raw = source.bytes(source.unsigned())
    if f.kind in ("string", "xml"):
        return raw.decode("utf-8", "replace") if utf8 else raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace")
    if f.kind != "geometry":
        return raw
    try:
        return read_geometry(raw, f.grid)
    except FormatError:
        if strict:
            raise
        return None  # one shape that can't be read doesn't cost the table


def read_row(body: bytes, slot: int, schema: Schema, strict: bool = False) -> list:
    """The values of a row, whose bytes begin after its length."""
    n = sum(f.nullable for f in schema.fields if f.kind != "oid")
    source = Input(body, (n + 7) // 8)
    nulls, seen, values = int.from_bytes(body[: source.at], "little"), 0, []
    for f in schema.fields:
        if f.kind == "oid":
            values.append(slot + 1)
            continue
        null = f.nullable and nulls >> seen & 1
        seen += f.nullable
        values.append(None if null else read_value(source, f, schema.utf8, strict))
    return values


def value_bytes(value, f: Field, schema: Schema) -> bytes:
    sized = lambda raw: unsigned(len(raw)) + raw
    try:
        if f.kind in NUMBERS:
            return struct.pack(NUMBERS[f.kind], value)
        if f.kind in TIMES and isinstance(value, datetime.datetime):
            return struct.pack("<d", ole_days(value))
        if f.kind == "uuid":
            return bytes.fromhex(parse_uuid(value).replace("-", ""))
        if f.kind in ("string", "xml"):
            return sized(value.encode("utf-8" if schema.utf8 else "utf-16-le"))
        if f.kind in ("binary", "raster"):
            return sized(bytes(value))
        if f.kind == "geometry" and isinstance(value, Geometry):
            return sized(write_geometry(value, f.grid, f.has_z or schema.has_z, f.has_m or schema.has_m))
    except (struct.error, TypeError, AttributeError, ValueError) as e:
        raise FormatError(f"{value!r} doesn't fit {f.name} ({f.kind}): {e}") from e
    raise FormatError(f"{value!r} doesn't fit {f.name} ({f.kind})")


def write_row(values: Iterable, schema: Schema) -> bytes:
    """The bytes of a row, with its length. A value that doesn't fit its field is an error, and so is null where none may
    be."""
    nulls, seen, body = 0, 0, bytearray()
    for value, f in zip(values, schema.fields, strict=True):
        if f.kind == "oid":
            continue
        if value is None:
            if not f.nullable:
                raise FormatError(f"{f.name} can't be null")
            nulls |= 1 << seen
        else:
            body += value_bytes(value, f, schema)
        seen += f.nullable
    size = (seen + 7) // 8
    return struct.pack("<I", size + len(body)) + nulls.to_bytes(size, "little") + bytes(body)


def with_extent(schema: Schema, bounds: tuple[float, float, float, float] | None) -> Schema:
    """The schema, its geometry field's extent set to these bounds."""
    if bounds is None or schema.shape is None:
        return schema
    fields = tuple(replace(f, grid=replace(f.grid, extent=bounds)) if f.kind == "geometry" else f for f in schema.fields)
    return replace(schema, fields=fields)
