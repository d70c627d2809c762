"""Query filters: all rows, rows by object id, by attributes, by geometry, and by both."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.functions.compile import Compiler
from parcela.functions.geometry import Geometry
from parcela.functions.rows import holds
from parcela.functions.spatial import INTERSECTS, RELATIONS, related, spatial_condition
from parcela.functions.where import FilterError, Node, parse

OID = "OBJECTID"
#: Object ids that go into the plan as literals; more are joined as a table.
LISTED_OIDS = 1000


@dataclass(frozen=True)
class Spatial:
    """A relation to a query geometry, with the geometry's bounds checked."""

    relation: str
    geometry: Geometry

    def __post_init__(self) -> None:
        if self.relation not in RELATIONS:
            raise FilterError(f"no relation {self.relation}")
        if self.geometry.bounds is None:
            raise FilterError("a spatial filter needs a geometry with points")

    def __str__(self) -> str:
        return f"SHAPE {self.relation} <filter>"


@dataclass(frozen=True)
class QueryFilter:
    """A filter; oids, node and spatial are None where it doesn't ask for them."""

    oids: tuple[int, ...] | None = None
    single: bool = False
    node: Node | None = None
    spatial: Spatial | None = None

    @classmethod
    def all(cls) -> QueryFilter:
        return cls()

    @classmethod
    def by_oid(cls, oid: int) -> QueryFilter:
        return cls(oids=(oid,), single=True)

    @classmethod
    def by_oids(cls, oids: Iterable[int]) -> QueryFilter:
        return cls(oids=tuple(oids))

    @classmethod
    def where(cls, text: str) -> QueryFilter:
        return cls(node=parse(text))

    @classmethod
    def intersecting(cls, geometry: Geometry) -> QueryFilter:
        return cls.related(INTERSECTS, geometry)

    @classmethod
    def related(cls, relation: str, geometry: Geometry) -> QueryFilter:
        return cls(spatial=Spatial(relation, geometry))

    def and_related(self, relation: str, geometry: Geometry) -> QueryFilter:
        """The filter and a relation, which replaces one that it has; filters by object id can't be combined."""
        if self.oids is not None:
            raise FilterError("a filter by object id can't be combined with a relation")
        return replace(self, spatial=Spatial(relation, geometry))

    @property
    def is_oid_only(self) -> bool:
        return self.node is None and self.spatial is None

    def condition(self, schema: T.StructType, negated: bool = False, strict: bool = False, shape: str = "SHAPE", point: tuple[str, str] | None = None, within: str = "documented") -> Column:
        """The filter, or its opposite, as a Column to filter by."""
        if self.oids is not None:
            if not self.oids:
                return F.lit(negated)
            oid = F.col(OID)
            listed = oid == self.oids[0] if self.single else oid.isin(list(self.oids))
            return ~listed if negated else listed
        terms = []
        if self.node is not None:
            terms.append(Compiler(schema, strict).compile(self.node, negated))
        if self.spatial is not None:
            related = spatial_condition(self.spatial.relation, self.spatial.geometry, shape, point, within)
            terms.append(~F.coalesce(related, F.lit(False)) if negated else related)
        if not terms:
            return F.lit(not negated)
        return terms[0] if len(terms) == 1 else (terms[0] | terms[1]) if negated else (terms[0] & terms[1])

    def apply(self, rows: DataFrame, negated: bool = False, **how) -> DataFrame:
        """The rows that the filter holds for, or with negated those that it doesn't."""
        if self.oids is not None and len(self.oids) > LISTED_OIDS:
            spark = rows.sparkSession
            wanted = spark.createDataFrame([(o,) for o in set(self.oids)], f"{OID} long")
            return rows.join(wanted, OID, "left_anti" if negated else "left_semi")
        return rows.where(self.condition(rows.schema, negated, **how))

    def matches_row(self, row: Mapping[str, object], geometry: Geometry | None = None, within: str = "documented") -> bool:
        """Whether the filter holds for one row (a mapping by field name, with OBJECTID) and its geometry."""
        if self.oids is not None:
            return row.get(OID) in self.oids
        fits = self.spatial is None or related(self.spatial.relation, self.spatial.geometry, geometry, within)
        return fits and (self.node is None or holds(self.node, row))

    def __str__(self) -> str:
        if self.oids is not None:
            return f"{OID} = {self.oids[0]}" if self.single else f"{OID} IN ({','.join(map(str, self.oids))})"
        if self.node is not None and self.spatial is not None:
            return f"({self.node}) AND {self.spatial}"
        return str(self.node or self.spatial or "<all>")
