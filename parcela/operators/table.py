"""Feature tables: searches, and edits as new immutable versions of a DataFrame.

A table is a DataFrame with a column OBJECTID and the next object id to give. Every edit returns a new table; nothing is
changed in place, and object ids are never given twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.functions.geometry import BOUNDS, Geometry, literal, with_bounds
from parcela.operators.filters import OID, QueryFilter
from parcela.sources.shared import scratch

ALL = QueryFilter.all()


class EditError(ValueError):
    """An edit that doesn't fit the table, or the state of a session."""


def has_bounds(rows: DataFrame, shape: str) -> bool:
    return f"{shape}_{BOUNDS[0]}" in rows.columns


@dataclass(frozen=True)
class FeatureTable:
    """rows has OBJECTID; shape names the geometry column of a feature class and is None for a table without one."""

    name: str
    rows: DataFrame
    next_oid: int
    shape: str | None = None
    how: Mapping = field(default_factory=dict)
    version: str | None = None  # that of the workspace's table which this one was made from

    @classmethod
    def of(cls, name: str, rows: DataFrame, shape: str | None = None, **how) -> FeatureTable:
        """A table of these rows; without OBJECTID they are numbered from 1."""
        n = None
        if OID not in rows.columns:
            rows, n = numbered(rows, 1)
        if shape and not has_bounds(rows, shape):
            rows = with_bounds(rows, shape)
        return cls(name, rows, ((rows.agg(F.max(OID)).first()[0] or 0) if n is None else n) + 1, shape, how)

    @property
    def fields(self) -> list[T.StructField]:
        """The fields, without the bounds that stand beside the geometry."""
        hidden = {f"{self.shape}_{b}" for b in BOUNDS} if self.shape else set()
        return [f for f in self.rows.schema.fields if f.name not in hidden]

    @property
    def geometry_type(self) -> str | None:
        return self.metadata.get("geometry_type") if self.shape else None

    @property
    def spatial_reference(self) -> str | None:
        return self.metadata.get("srs_wkt") if self.shape else None

    @property
    def metadata(self) -> dict:
        return self.rows.schema[self.shape].metadata or {} if self.shape else {}

    def filtering(self) -> dict:
        return {"shape": self.shape or "SHAPE", **self.how}

    def count(self, where: QueryFilter = ALL) -> int:
        return self.search(where).count()

    def search(self, where: QueryFilter = ALL, fields: Iterable[str] | None = None) -> DataFrame:
        """The rows that the filter holds for; fields names those to read, of which only these columns are scanned."""
        found = where.apply(self.rows, **self.filtering())
        return found.select(*fields) if fields else found.select(*[f"`{f.name}`" for f in self.fields])

    def cursor(self, where: QueryFilter = ALL) -> Iterator[Row]:
        """The rows in the order of their object ids, one partition at a time."""
        return self.search(where).orderBy(OID).toLocalIterator(prefetchPartitions=True)

    def get(self, oid: int) -> Row | None:
        return self.search(QueryFilter.by_oid(oid)).first()

    def oids(self, where: QueryFilter = ALL) -> DataFrame:
        return self.search(where, [OID]).orderBy(OID)

    def query_oids(self, where: QueryFilter = ALL) -> list[int]:
        return [r[0] for r in self.oids(where).collect()]

    def value(self, name: str, given) -> Column:
        """What is given for a field, as a Column of its type; what doesn't fit the field is an error."""
        found = next((f for f in self.fields if f.name == name), None)
        if found is None:
            raise EditError(f"{self.name} has no field {name}")
        if name == OID:
            raise EditError("object ids can't be set")
        if isinstance(given, Geometry):
            if name != self.shape:
                raise EditError(f"{name} is not the geometry field")
            return literal(given)
        if given is None and not found.nullable:
            raise EditError(f"{name} can't be null")
        return given if isinstance(given, Column) else F.lit(given).cast(found.dataType)

    def updated(self, where: QueryFilter, values: Mapping[str, object]) -> FeatureTable:
        """The table with these values in all rows that the filter holds for. Values may be Columns of the row."""
        holds = F.coalesce(where.condition(self.rows.schema, **self.filtering()), F.lit(False))
        if where.oids is not None and len(where.oids) > 1000:
            marked = self.rows.sparkSession.createDataFrame([(o, True) for o in set(where.oids)], f"{OID} long, `#hit` boolean")
            rows, holds = self.rows.join(marked, OID, "left"), F.coalesce("#hit", F.lit(False))
        else:
            rows = self.rows
        new = {name: F.when(holds, self.value(name, given)).otherwise(F.col(f"`{name}`")) for name, given in values.items()}
        kept = {f.name: f.metadata for f in self.rows.schema.fields}
        columns = [new[c].alias(c, metadata=kept[c]) if c in new else F.col(f"`{c}`") for c in self.rows.columns]
        rows = rows.select(*columns)
        return replace(self, rows=with_bounds(rows, self.shape) if self.shape in values else rows)

    def deleted(self, where: QueryFilter) -> FeatureTable:
        """The table without the rows that the filter holds for; other rows keep their object ids."""
        return replace(self, rows=where.apply(self.rows, negated=True, **self.filtering()))

    def deleted_with_count(self, where: QueryFilter) -> tuple[FeatureTable, int]:
        """deleted(), and how many rows that takes away; ids that no row has, or that are named twice, don't count."""
        return self.deleted(where), self.count(where)

    def deleted_positions(self, positions: Iterable[int]) -> FeatureTable:
        """The table without the rows at these positions (from 0) in the order of object ids; others are an error."""
        wanted = set(positions)
        placed = self.rows.select(OID).repartitionByRange(OID).sortWithinPartitions(OID)
        placed = numbered(placed.select(F.col(OID).alias("#oid")), 0)[0].where(F.col(OID).isin(sorted(wanted)))
        oids = [r["#oid"] for r in placed.collect()]  # one for each position asked for
        if len(oids) < len(wanted):
            raise EditError(f"{self.name} has no row at some of these positions")
        return self.deleted(QueryFilter.by_oids(oids))

    def deleted_row(self, row: Row | Mapping[str, object]) -> FeatureTable:
        """The table without this row, as a search gave it."""
        return self.deleted(QueryFilter.by_oid(row[OID]))

    def inserted(self, rows: DataFrame | Iterable[Mapping[str, object]]) -> FeatureTable:
        """The table with these rows added, under the next object ids. Fields that a mapping lacks get their default."""
        if not isinstance(rows, DataFrame):
            rows = list(rows)
            for r in rows:
                if unknown := r.keys() - {f.name for f in self.fields}:
                    raise EditError(f"{self.name} has no field {', '.join(sorted(unknown))}")
            plain = [self.completed(r) | {OID: oid} for oid, r in enumerate(rows, self.next_oid)]
            schema = T.StructType(list(self.fields))
            new, n = self.rows.sparkSession.createDataFrame([[p[f.name] for f in schema] for p in plain], schema), len(plain)
        else:
            new, n = numbered(rows.drop(OID), self.next_oid)
        if self.shape and not has_bounds(new, self.shape):
            new = with_bounds(new, self.shape)
        return replace(self, rows=self.rows.unionByName(new), next_oid=self.next_oid + n)

    def completed(self, given: Mapping[str, object]) -> dict:
        """A row's values: as given, else the field's default, else null if it may be, else zero or empty."""
        out = {}
        for f in self.fields:
            default = (f.metadata or {}).get("default")
            value = given[f.name] if f.name in given else default if default is not None else None if f.nullable else empty(f)
            out[f.name] = value.row() if isinstance(value, Geometry) else value
        return out

    def copied(self, where: QueryFilter) -> FeatureTable:
        """The table with copies of the rows that the filter holds for, under new object ids."""
        return self.inserted(self.search(where))


def empty(f: T.StructField):
    return "" if isinstance(f.dataType, T.StringType) else b"" if isinstance(f.dataType, T.BinaryType) else 0.0 if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else 0 if isinstance(f.dataType, T.IntegralType) else None


def numbered(rows: DataFrame, first: int) -> tuple[DataFrame, int]:
    """The rows with dense object ids from that one on, in their order, and their number.

    A task numbers the rows of its partition, and the rows are written with these numbers before anything is counted:
    a plan that runs twice may deal its rows to other partitions the second time. What the partitions before hold is
    summed over one row for each of them.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "numbered")
    rows.withColumn("#part", F.spark_partition_id()).withColumn("#at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("#part", T.IntegerType()), T.StructField("#at", T.LongType())])).parquet(path)
    counts = placed.groupBy("#part").agg(F.count(F.lit(1)).alias("#n"), F.min("#at").alias("#begin"))
    before = F.coalesce(F.sum("#n").over(Window.partitionBy(F.lit(0)).orderBy("#part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("#part", "#begin", before.alias("#before"))
    out = placed.join(F.broadcast(starts), "#part")  # a row for each partition
    oid = (F.col("#at") - F.col("#begin") + F.col("#before") + F.lit(first)).cast("long")
    return out.select(F.coalesce(oid, F.lit(0).cast("long")).alias(OID), *[as_before(f) for f in rows.schema.fields]), counts.agg(F.sum("#n")).first()[0] or 0


def as_before(f: T.StructField) -> Column:
    """A column that was written and read again, with its metadata, and not nullable if it wasn't (files forget that)."""
    column, zero = F.col(f"`{f.name}`"), empty(f)
    return (column if f.nullable or zero is None else F.coalesce(column, F.lit(zero).cast(f.dataType))).alias(f.name, metadata=f.metadata)
