"""The format as a Spark data source, `gdb`.

    spark.dataSource.register(GdbDataSource)
    spark.read.format("gdb").option("table", "Parcels").load("/data/city.gdb")
    rows.write.format("gdb").option("table", "Parcels").mode("overwrite").save("/data/city.gdb")
    read(spark, "/data/city.gdb", "Parcels").where("OBJECTID in (5, 7)")

A table is read in ranges of slots, each of which reads its own part of the index and of the rows, as Arrow batches. A
schema given to the reader names the columns to read. Where Spark hands filters to Python sources (read() asks for it),
those on OBJECTID leave out the slots that they exclude. Tasks that write make
row files of their own, and the commit joins them into the table, since the format has one file for all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from parcela.functions.geometry import BOUNDS, SHAPE_TYPE, from_row
from parcela.functions.scalars import iso
from parcela.sources.gdb.codec import OBJECT_ID, Field, FormatError, Schema, write_row, write_schema
from parcela.sources.gdb.tables import FIELDS_AT, ITEM_TYPES, Builder, Folder, TableFile, find, index_bytes, table_head, table_name

#: Slots that one task reads.
PARTITION_SLOTS = 100_000
#: Rows of an Arrow batch.
BATCH_ROWS = 2_000
TYPES = {
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "oid": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "xml": T.StringType(),
    "uuid": T.StringType(),
    "datetime": T.TimestampNTZType(),
    "date": T.TimestampNTZType(),
    "time": T.TimestampNTZType(),
    "geometry": SHAPE_TYPE,
}


def struct_of(schema: Schema) -> T.StructType:
    """The Spark schema, with what it can't say in the fields' metadata, and bounds after a geometry."""
    out = []
    for f in schema.fields:
        facts: dict = {"kind": f.kind, "alias": f.alias, "required": f.required, "editable": f.editable, "length": f.length}
        if f.default is not None:
            facts["default"] = iso(f.default) if hasattr(f.default, "year") else f.default
        if f.kind == "geometry":
            facts |= {"srs_wkt": f.srs_wkt, "geometry_type": schema.geometry_type, "grid": [f.grid.x, f.grid.y, f.grid.scale], "has_z": schema.has_z, "has_m": schema.has_m}
        out.append(T.StructField(f.name, TYPES.get(f.kind, T.BinaryType()), f.nullable and f.kind != "oid" or f.kind == "geometry", {k: v for k, v in facts.items() if v is not None}))
        if f.kind == "geometry":
            out += [T.StructField(f"{f.name}_{b}", T.DoubleType()) for b in BOUNDS]
    return T.StructType(out)


def field_of(f: T.StructField) -> Field:
    """A field for a Spark column; its metadata's kind counts, if it has one."""
    facts = f.metadata or {}
    plain = {T.TimestampType: "datetime", T.DateType: "datetime", T.ByteType: "int16", T.BooleanType: "int16", T.BinaryType: "binary"} | {type(t): kind for kind, t in reversed(TYPES.items())} | {T.StringType: "string", T.LongType: "int64", T.TimestampNTZType: "datetime"}
    kind = facts.get("kind") or plain.get(type(f.dataType))
    if kind is None or kind == "geometry" and f.dataType != SHAPE_TYPE and not isinstance(f.dataType, T.StructType):
        raise FormatError(f"columns of type {f.dataType.simpleString()} can't be written: {f.name}")
    return Field(f.name, kind, facts.get("alias", ""), f.nullable, facts.get("required", False), facts.get("editable", True), facts.get("length", 0), srs_wkt=facts.get("srs_wkt", ""))


@dataclass
class Slots(InputPartition):
    first: int
    last: int


class GdbReader(DataSourceReader):
    """Reads the columns of the struct from the slots from `first` on and before `last`, and of these, if `oids` is not
    None, from the range that holds them all in each partition."""

    def __init__(self, path: str, name: str, options: dict, struct: T.StructType | None = None) -> None:
        self.path, self.strict, self.struct = path, options.get("mode", "").upper() == "FAILFAST", struct
        self.step = int(options.get("slotsPerPartition", PARTITION_SLOTS))
        self.number = int(name) if name.isdigit() and options.get("byNumber") else find(path, name).file_id
        self.first, self.last, self.oids = 0, None, None

    def table(self) -> TableFile:
        return TableFile.open(self.path, self.number)

    def partitions(self) -> list[Slots]:
        slots = self.table().slots
        last = slots if self.last is None else min(self.last, slots)
        out = [Slots(first, min(first + self.step, last)) for first in range(self.first, last, self.step)]
        if self.oids is not None:
            wanted = sorted(o - 1 for o in self.oids if self.first < o <= last)
            groups: dict[int, list[int]] = {}
            for slot in wanted:
                groups.setdefault((slot - self.first) // self.step, []).append(slot)
            out = [Slots(g[0], g[-1] + 1) for g in groups.values()]
        return out or [Slots(0, 0)]

    def read(self, partition: Slots) -> Iterator[pa.RecordBatch]:
        table = self.table()
        names = [f.name for f in table.schema.fields]
        at = table.schema.index(table.schema.shape.name) if table.schema.shape else None
        shape, corners = names[at] if at is not None else None, {}
        if shape is not None:
            corners = {f"{shape}_{b}": k for k, b in enumerate(BOUNDS)}
        form = to_arrow_schema(self.struct or struct_of(table.schema))
        rows: list[list] = []

        def column(f: pa.Field) -> pa.Array:
            if f.name in corners and f.name not in names:
                return pa.array([r[at].bounds[corners[f.name]] if r[at] and r[at].bounds else None for r in rows], f.type)
            if f.name == shape:
                return pa.array([r[at] and r[at].row() for r in rows], f.type)
            k = names.index(f.name)
            return pa.array([r[k] for r in rows], f.type)

        for row in table.rows(partition.first, partition.last, self.strict):
            rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([column(f) for f in form], schema=form)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([column(f) for f in form], schema=form)


class FilteringReader(GdbReader):
    """A reader that is handed filters; Spark applies them again to what is read."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == (OBJECT_ID.name,):
                if isinstance(f, (EqualTo, In)):
                    listed = {v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
                    self.oids = listed if self.oids is None else self.oids & listed
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value - isinstance(f, GreaterThanOrEqual))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    last = max(0, f.value - isinstance(f, LessThan))
                    self.last = last if self.last is None else min(self.last, last)
            yield f


@dataclass
class Part(WriterCommitMessage):
    name: str
    slots: bytes
    sizes: bytes
    bounds: tuple[float, float, float, float] | None


class GdbWriter(DataSourceWriter):
    """Rows without OBJECTID are numbered in the order of the parts; with it, they keep it."""

    def __init__(self, path: str, name: str, struct: T.StructType, overwrite: bool) -> None:
        self.path, self.name, self.overwrite, self.struct = path, name, overwrite, struct
        shape = next((f for f in struct.fields if isinstance(f.dataType, T.StructType)), None)
        hidden = {f"{shape.name}_{b}" for b in BOUNDS} if shape else set()
        self.columns = [i for i, f in enumerate(struct.fields) if f.name not in hidden and f.name != "OBJECTID"]
        self.oid = next((i for i, f in enumerate(struct.fields) if f.name == "OBJECTID"), None)
        self.at = struct.fields.index(shape) if shape else None
        kind = ((shape.metadata or {}).get("geometry_type") or "POLYGON") if shape else None
        self.schema = Schema((OBJECT_ID, *[field_of(struct.fields[i]) for i in self.columns]), kind)

    def write(self, rows) -> Part:
        folder, name = Folder(self.path), f"{uuid.uuid4().hex}.rows"
        folder.create()
        slots, sizes, corners = [], [], []
        with folder.system.open_output_stream(folder.path(name)) as out:
            for row in rows:
                shape = from_row(row[self.at]) if self.at is not None else None
                values = [shape if i == self.at else int(row[i]) if isinstance(row[i], bool) else row[i] for i in self.columns]
                blob = write_row([None, *values], self.schema)
                if shape and shape.bounds:
                    corners.append(shape.bounds)
                out.write(blob)
                sizes.append(len(blob))
                slots.append(-1 if self.oid is None else row[self.oid] - 1)
        bounds = (*(min(c[k] for c in corners) for k in (0, 1)), *(max(c[k] for c in corners) for k in (2, 3))) if corners else None
        return Part(name, np.array(slots, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), bounds)

    def commit(self, messages: list[Part | None]) -> None:
        parts, folder = [m for m in messages if m], Folder(self.path)
        slots = np.concatenate([np.frombuffer(m.slots, np.int64) for m in parts] or [np.zeros(0, np.int64)])
        sizes = np.concatenate([np.frombuffer(m.sizes, np.int64) for m in parts] or [np.zeros(0, np.int64)])
        slots = np.arange(len(slots)) if self.oid is None else slots
        if len(np.unique(slots)) < len(slots) or slots.min(initial=0) < 0:
            raise FormatError("object ids must be positive and each used once")
        builder = Builder.open(self.path) if folder.exists(table_name(1)) else Builder.create(self.path)
        known = next((f[1] for f in builder.files if f[2] == self.name), None)
        if known is not None and not self.overwrite:
            raise FormatError(f"there is a table {self.name} already")
        if known is None:
            kind, shape = ("Feature Class", self.schema.shape) if self.at is not None else ("Table", None)
            if shape:
                known = builder.add_feature_class(self.name, self.schema.geometry_type, shape, [f for f in self.schema.fields[1:] if f is not shape], [])
            else:
                known = builder.add_table(self.name, self.schema.fields[1:], [])
            assert kind in ITEM_TYPES
        section = write_schema(self.schema, 3)
        offsets = FIELDS_AT + len(section) + np.cumsum(sizes) - sizes
        total = FIELDS_AT + len(section) + int(sizes.sum())
        file = table_name(known)
        with folder.system.open_output_stream(folder.path(f"{file}.new")) as out:
            out.write(table_head(3, len(slots), int(sizes.max(initial=0)), total) + section)
            for m in parts:
                with folder.open(m.name) as source:
                    while piece := source.read(1 << 22):
                        out.write(piece)
        folder.system.move(folder.path(f"{file}.new"), folder.path(file))
        folder.write(f"{file}x", index_bytes(slots, offsets, int(slots.max(initial=-1)) + 1))
        self.drop(parts)

    def abort(self, messages: list[Part | None]) -> None:
        self.drop([m for m in messages if m])

    def drop(self, parts: list[Part]) -> None:
        folder = Folder(self.path)
        for m in parts:
            folder.system.delete_file(folder.path(m.name))


class GdbDataSource(DataSource):
    """Options: path, table (its name), mode (FAILFAST: shapes that can't be read are an error), slotsPerPartition,
    byNumber (table is then the file's number), and filters (true where spark.sql.python.filterPushdown.enabled is)."""

    @classmethod
    def name(cls) -> str:
        return "gdb"

    def wanted(self) -> tuple[str, str]:
        if "path" not in self.options or "table" not in self.options:
            raise FormatError("the options path and table are needed")
        return self.options["path"], self.options["table"]

    def schema(self) -> T.StructType:
        reader = GdbReader(*self.wanted(), self.options)
        return struct_of(reader.table().schema)

    def reader(self, schema: T.StructType) -> GdbReader:
        kind = FilteringReader if self.options.get("filters", "").lower() == "true" else GdbReader
        return kind(*self.wanted(), self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> GdbWriter:
        return GdbWriter(*self.wanted(), schema, overwrite)


def read(spark: SparkSession, path: str, table: str, columns: tuple[str, ...] | None = None, **options: object) -> DataFrame:
    """A table of a geodatabase, or these columns of it, with filters on OBJECTID handed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GdbDataSource)
    reader = spark.read.format("gdb").options(table=table, filters="true", **options)
    if columns is not None:
        whole = struct_of(GdbReader(path, table, options).table().schema)
        reader = reader.schema(T.StructType([whole[c] for c in columns]))
    return reader.load(path)
