"""The command line: python -m parcela.cli COMMAND DIRECTORY ..., over file geodatabases.

    sample DIR                      writes a small geodatabase
    list DIR                        its tables, feature classes and feature datasets
    describe DIR NAME               fields of a table
    read DIR NAME [--where W]       rows
    insert DIR NAME [--set F=V]... [--point X,Y | --ring "X,Y;X,Y;..."]
    update DIR NAME --set F=V... (--oid N | --oids N,N | --where W)
    delete DIR NAME (--oid N | --oids N,N | --where W) [--dry-run]
    update-attr DIR NAME OID FIELD VALUE
    update-geom DIR NAME OID X Y
"""

from __future__ import annotations

import argparse
import datetime
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.functions.geometry import POINT, POLYGON, Geometry, from_row, parse_xy, point, polygon
from parcela.functions.scalars import iso, parse_value, zero
from parcela.functions.where import plain_number
from parcela.operators.filters import OID, QueryFilter
from parcela.sources.gdb.codec import Field
from parcela.sources.gdb.datasource import GdbDataSource
from parcela.sources.gdb.tables import Builder, TableFile, catalog, find, write_table


def session() -> SparkSession:
    spark = SparkSession.builder.appName("parcela").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.dataSource.register(GdbDataSource)
    return spark


def sample(directory: str) -> None:
    """Two cities in a table, a capital as a point, and a region in the feature dataset Admin."""
    builder = Builder.create(directory)
    shape = Field("SHAPE", "geometry", srs_wkt='GEOGCS["GCS_WGS_1984"]')
    builder.add_table("Cities_Tbl", [Field("Name", "string"), Field("Pop", "int32")], [[1, "Beijing", 2154], [2, "Shanghai", 2424]])
    builder.add_feature_class("Capitals", POINT, shape, [Field("Name", "string")], [[1, point(116.4, 39.9), "Beijing"]])
    builder.add_dataset("Admin")
    builder.add_feature_class("Regions", POLYGON, shape, [Field("Name", "string")], [[1, polygon([(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]), "RegionA"]], dataset="Admin")


def shown(value) -> str:
    if value is None:
        return "<null>"
    if isinstance(value, Geometry):
        return str(value)
    if isinstance(value, (bytes, bytearray)):
        return f"<binary {len(value)} bytes>"
    if isinstance(value, datetime.datetime):
        return iso(value)
    return plain_number(value) if isinstance(value, float) else str(value)


def opened(directory: str, name: str) -> TableFile:
    return TableFile.open(directory, find(directory, name).file_id)


def frame(directory: str, name: str) -> DataFrame:
    return session().read.format("gdb").option("table", name).load(directory)


def chosen(args: argparse.Namespace) -> QueryFilter:
    """The filter of exactly one of --oid, --oids and --where."""
    if args.oid is not None:
        return QueryFilter.by_oid(args.oid)
    if args.oids is not None:
        return QueryFilter.by_oids(int(x) for x in args.oids.split(",") if x.strip())
    return QueryFilter.where(args.where)


def matching_oids(directory: str, name: str, where: QueryFilter) -> set[int]:
    table = opened(directory, name)
    shape = table.schema.shape.name if table.schema.shape else "SHAPE"
    rows = frame(directory, name)
    return {r[0] for r in where.apply(rows, shape=shape).select(F.col(OID)).collect()}


def rewritten(directory: str, name: str, change: Callable[[list[list]], list[list]]) -> None:
    """Writes a table again with changed rows. Empty slots at the end stay, so no object id is given twice."""
    table = opened(directory, name)
    write_table(directory, find(directory, name).file_id, table.schema, change(list(table.rows(strict=True))), table.version, table.slots)


def assignments(given: list[str], fields: tuple[Field, ...]) -> dict[int, object]:
    """Values by the place of their fields, from FIELD=VALUE."""
    out = {}
    for text in given:
        name, equals, value = text.partition("=")
        if not equals:
            raise ValueError(f"--set has the form FIELD=VALUE: {text}")
        at = next((i for i, f in enumerate(fields) if f.name == name), None)
        if at is None:
            raise ValueError(f"there is no field {name}")
        out[at] = parse_value(value, fields[at].kind)
    return out


def given_shape(args: argparse.Namespace) -> Geometry | None:
    if args.point:
        return point(*parse_xy(args.point))
    if args.ring:
        ring = [parse_xy(p.strip()) for p in args.ring.split(";") if p.strip()]
        if len(ring) < 3:
            raise ValueError("--ring needs three points at least")
        return polygon(ring)
    return None


def insert(args: argparse.Namespace) -> str:
    table = opened(args.directory, args.name)
    values, shape, fields = assignments(args.set, table.schema.fields), given_shape(args), table.schema.fields
    oid = table.slots + 1
    row = []
    for i, f in enumerate(fields):
        if i in values:
            row.append(values[i])
        elif f.kind == "geometry" and shape:
            row.append(shape)
        else:
            row.append(f.default if f.default is not None else None if f.nullable else zero(f.kind))
        if f.kind == "oid":
            row[i] = oid
    rewritten(args.directory, args.name, lambda rows: [*rows, row])
    return f"inserted {OID} {oid} into {args.name}"


def change(directory: str, name: str, oids: set[int], values: dict[int, object]) -> str:
    schema = opened(directory, name).schema
    at = schema.index(OID)
    rewritten(directory, name, lambda rows: [[values.get(i, v) if row[at] in oids else v for i, v in enumerate(row)] for row in rows])
    return f"updated {len(oids)} rows of {name}"


def delete(args: argparse.Namespace) -> str:
    oids = matching_oids(args.directory, args.name, chosen(args))
    if args.dry_run:
        return f"{len(oids)} rows of {args.name} would be deleted"
    at = opened(args.directory, args.name).schema.index(OID)
    rewritten(args.directory, args.name, lambda rows: [row for row in rows if row[at] not in oids])
    return f"deleted {len(oids)} rows of {args.name}"


def listing(directory: str) -> list[str]:
    items, out = catalog(directory), []
    rows = lambda i: sum(1 for o in TableFile.open(directory, i.file_id).offsets(0, TableFile.open(directory, i.file_id).slots) if o)
    for title, kind, parent in (("tables", "Table", None), ("feature classes", "FeatureClass", None)):
        out.append(f"{title}:")
        out += [f"  {i.name} ({rows(i)} rows)" for i in items if i.item_type == kind and i.parent_dataset == parent]
    out.append("feature datasets:")
    for d in (i for i in items if i.item_type == "FeatureDataset"):
        out.append(f"  {d.name}")
        out += [f"    {i.name} {i.geometry_type or ''} ({rows(i)} rows)" for i in items if i.parent_dataset == d.name]
    return out


def described(directory: str, name: str) -> list[str]:
    table, item = opened(directory, name), find(directory, name)
    head = [f"{item.item_type} {name}"] + ([f"geometry: {table.schema.geometry_type}", f"spatial reference: {table.schema.shape.srs_wkt}"] if table.schema.shape else [])
    return head + [f"{i}\t{f.name}\t{f.kind}\t{'null' if f.nullable else 'not null'}" for i, f in enumerate(table.schema.fields)]


def rows_shown(directory: str, name: str, where: str | None) -> list[str]:
    table = opened(directory, name)
    shape = table.schema.shape.name if table.schema.shape else "SHAPE"
    found = frame(directory, name)
    if where:
        found = QueryFilter.where(where).apply(found, shape=shape)
    out = []
    for r in found.orderBy(OID).toLocalIterator():
        out.append("  ".join(f"{f.name}={shown(from_row(r[f.name]) if f.kind == 'geometry' else r[f.name])}" for f in table.schema.fields))
    return [*out, f"{len(out)} rows"]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="parcela")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *more: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for arg in ("directory", *more):
            sub.add_argument(arg)
        return sub

    command("sample")
    command("list")
    command("describe", "name")
    command("read", "name").add_argument("--where")
    sub = command("insert", "name")
    sub.add_argument("--set", action="append", default=[])
    shape = sub.add_mutually_exclusive_group()
    shape.add_argument("--point")
    shape.add_argument("--ring")
    for name in ("update", "delete"):
        sub = command(name, "name")
        which = sub.add_mutually_exclusive_group(required=True)
        which.add_argument("--oid", type=int)
        which.add_argument("--oids")
        which.add_argument("--where")
        if name == "update":
            sub.add_argument("--set", action="append", required=True)
        else:
            sub.add_argument("--dry-run", action="store_true")
    command("update-attr", "name", "oid", "field", "value")
    command("update-geom", "name", "oid", "x", "y")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        match args.command:
            case "sample":
                sample(args.directory)
                lines = [f"wrote a sample to {args.directory}"]
            case "list":
                lines = listing(args.directory)
            case "describe":
                lines = described(args.directory, args.name)
            case "read":
                lines = rows_shown(args.directory, args.name, args.where)
            case "insert":
                lines = [insert(args)]
            case "update":
                values = assignments(args.set, opened(args.directory, args.name).schema.fields)
                lines = [change(args.directory, args.name, matching_oids(args.directory, args.name, chosen(args)), values)]
            case "delete":
                lines = [delete(args)]
            case "update-attr":
                values = assignments([f"{args.field}={args.value}"], opened(args.directory, args.name).schema.fields)
                lines = [change(args.directory, args.name, matching_oids(args.directory, args.name, QueryFilter.by_oid(int(args.oid))), values)]
            case _:
                schema, oid = opened(args.directory, args.name).schema, int(args.oid)
                if schema.shape is None or not matching_oids(args.directory, args.name, QueryFilter.by_oid(oid)):
                    raise ValueError(f"{args.name} has no shape with {OID} {oid}")
                lines = [change(args.directory, args.name, {oid}, {schema.index(schema.shape.name): point(float(args.x), float(args.y))})]
    except (ValueError, LookupError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print("\n".join(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
