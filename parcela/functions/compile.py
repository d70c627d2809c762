"""Compiles attribute filters to Column expressions over a schema.

The language is two-valued: a comparison with null is false, so NOT of it is true. NOT is pushed down to the comparisons,
and each is compiled as it stands or negated: `c op v`, or `c IS NULL OR NOT (c op v)`. Both forms reach the Parquet scan
as pushed filters. Types are never an error: a comparison that can't hold for a column's type is a constant. A field that
the schema lacks counts as null, unless strict.
"""

from __future__ import annotations

import datetime
import math
import re
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcela.functions.scalars import iso_text
from parcela.functions.where import Always, And, Compare, FilterError, In, IsNull, Literal, Node, Not, Or, number_in, parse, plain_number

#: A condition on a value that is not null: an expression, or the same answer for all values.
Condition = Column | bool
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
REAL = (T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
EXACT = 1 << 53
EPSILON = 2.220446049250313e-16
DATE, SECOND = re.compile(r"\d{4}-\d\d-\d\d", re.ASCII), re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", re.ASCII)


@F.pandas_udf(T.StringType())
def real_text(values: pd.Series) -> pd.Series:
    return values.map(plain_number, na_action="ignore")


def compared(a, operator: str, b):
    """The comparison of two columns, or of two plain values."""
    return {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[operator]()


def any_of(conditions: list[Condition]) -> Condition:
    if True in [c for c in conditions if isinstance(c, bool)]:
        return True
    rest = [c for c in conditions if not isinstance(c, bool)]
    return reduce(or_, rest) if rest else False


class Compiler:
    """Filters over one schema."""

    def __init__(self, schema: T.StructType, strict: bool = False) -> None:
        self.fields, self.strict = schema.fields, strict

    def field(self, name: str) -> T.StructField | None:
        """The field of exactly this name, or else the first that differs in the case of ASCII letters only."""
        fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
        found = next((f for f in self.fields if f.name == name), None) or next((f for f in self.fields if fold(f.name) == fold(name)), None)
        if found is None and self.strict:
            raise FilterError(f"there is no field {name}")
        return found

    def column(self, field: T.StructField) -> Column:
        return F.col("`" + field.name.replace("`", "``") + "`")

    def compile(self, node: Node | str, negated: bool = False) -> Column:
        """The condition as a Column that is true where it holds; elsewhere it is false or null."""
        if isinstance(node, str):
            node = parse(node)
        match node:
            case Always():
                return F.lit(not negated)
            case And(left, right) | Or(left, right):
                join = and_ if isinstance(node, And) != negated else or_
                return join(self.compile(left, negated), self.compile(right, negated))
            case Not(of):
                return self.compile(of, not negated)
            case IsNull(name, but):
                field = self.field(name)
                wants_null = but == negated
                if field is None:
                    return F.lit(wants_null)
                return self.column(field).isNull() if wants_null else self.column(field).isNotNull()
            case In(name, values, but):
                field = self.field(name)
                condition = False if field is None else self.one_of(field, [v for v in values if v is not None])
                return self.settled(field, condition, None in values, negated != but)
            case Compare(name, operator, value):
                field = self.field(name)
                condition = False if field is None or value is None else self.holds(field, operator, value)
                return self.settled(field, condition, False, negated)
        raise TypeError(node)

    def settled(self, field: T.StructField | None, condition: Condition, null_holds: bool, negated: bool) -> Column:
        """The condition on a value that may be null, for which null_holds is the answer."""
        if field is None:
            return F.lit(null_holds != negated)
        c = self.column(field)
        if isinstance(condition, bool):
            here = condition != negated
            there = null_holds != negated
            return F.lit(here) if here == there else (c.isNotNull() if here else c.isNull())
        condition = ~condition if negated else condition
        return (c.isNull() | condition) if null_holds != negated else condition if not null_holds else (c.isNotNull() & condition)

    def holds(self, field: T.StructField, operator: str, value: Literal) -> Condition:
        c, kind = self.column(field), field.dataType
        if isinstance(value, bool):
            if isinstance(kind, T.BooleanType):
                return compared(c.cast("int"), operator, F.lit(int(value)))
            return compared((c != 0).cast("int"), operator, F.lit(int(value))) if isinstance(kind, (T.ShortType, T.IntegerType)) else False
        number = number_in(value) if isinstance(value, str) else value
        if isinstance(kind, (*WHOLE, *REAL)):
            if number is None:
                return self.as_text(c, kind, operator, value)
            return self.whole(c, kind, operator, number) if isinstance(kind, WHOLE) else self.real(c, kind, operator, float(number))
        if not isinstance(value, str):
            return False
        if isinstance(kind, T.StringType):
            return compared(c, operator, F.lit(value))
        return self.time(c, kind, operator, value) if isinstance(kind, TIMES) else False

    def as_text(self, c: Column, kind: T.DataType, operator: str, value: str) -> Condition:
        """A number against a text that is none: it is never equal, and ordered as text."""
        if operator in ("=", "<>"):
            return operator == "<>"
        text = c.cast("double").cast("decimal(38,0)").cast("string") if isinstance(kind, WHOLE) else F.when(F.isnan(c.cast("double")), F.lit("NaN")).otherwise(real_text(c.cast("double")))
        return compared(text, operator, F.lit(value))

    def whole(self, c: Column, kind: T.DataType, operator: str, number: float) -> Condition:
        if isinstance(number, float) and math.isnan(number):
            return operator in ("<", "<=", "<>")
        if isinstance(number, float) and math.isinf(number):
            return compared(0.0, operator, number)
        if abs(number) >= EXACT and isinstance(kind, T.LongType):
            return compared(c.cast("double"), operator, F.lit(float(number)))
        if number != math.floor(number):
            if operator in ("=", "<>"):
                return operator == "<>"
            operator, number = (">", math.floor(number)) if operator[0] == ">" else ("<", math.ceil(number))
        number, most = int(number), 1 << BITS[type(kind)] - 1
        if not -most <= number < most:
            return compared(0, operator, number)
        return compared(c, operator, F.lit(number).cast(kind))

    def real(self, c: Column, kind: T.DataType, operator: str, number: float) -> Condition:
        """Floats; a value that isn't a number counts as less than any."""
        if math.isnan(number):
            return operator in ("<", "<=", "<>")
        c = c if isinstance(kind, T.DoubleType) else c.cast("double")
        plain = compared(c, operator, F.lit(number))
        if isinstance(kind, T.DecimalType) or operator in ("=", "<>"):
            return plain
        return (plain & ~F.isnan(c)) if operator[0] == ">" else (plain | F.isnan(c))

    def time(self, c: Column, kind: T.DataType, operator: str, value: str) -> Condition:
        """Times against their text YYYY-MM-DD HH:MM:SS[.ffffff], ordered as text."""
        when = moment(value)
        c = c.cast("timestamp_ntz") if isinstance(kind, T.DateType) else c
        literal = lambda: F.lit(when.isoformat(" ")).cast("timestamp_ntz" if isinstance(kind, (T.DateType, T.TimestampNTZType)) else "timestamp")
        if when and DATE.fullmatch(value):  # every time of that day is longer, so greater
            if operator in ("=", "<>"):
                return operator == "<>"
            return c >= literal() if operator[0] == ">" else c < literal()
        if when and SECOND.fullmatch(value):
            return compared(c, operator, literal())
        return compared(iso_text(c), operator, F.lit(value))

    def one_of(self, field: T.StructField, values: list[Literal]) -> Condition:
        c, kind = self.column(field), field.dataType
        if isinstance(kind, T.StringType):
            texts = [v for v in values if isinstance(v, str)]
            return c.isin(texts) if texts else False
        if isinstance(kind, TIMES):
            return any_of([self.holds(field, "=", v) for v in values if isinstance(v, str)])
        if isinstance(kind, T.BooleanType):
            return any_of([self.holds(field, "=", v) for v in values if isinstance(v, bool)])
        if not isinstance(kind, (*WHOLE, *REAL)):
            return False
        conditions: list[Condition] = [self.holds(field, "=", v) for v in values if isinstance(v, bool)]
        numbers = [number_in(v) if isinstance(v, str) else v for v in values if not isinstance(v, bool)]
        numbers = [n for n in numbers if n is not None and math.isfinite(n)]
        if isinstance(kind, WHOLE):
            near = [round(n) for n in numbers if abs(round(n) - n) < EPSILON]
            most = 1 << BITS[type(kind)] - 1
            listed = [n for n in near if -most <= n < most and (abs(n) < EXACT or not isinstance(kind, T.LongType))]
            conditions += [c.isin([F.lit(n).cast(kind) for n in listed])] if listed else []
            conditions += [c.cast("double") == F.lit(float(n)) for n in near if abs(n) >= EXACT and isinstance(kind, T.LongType)]
        else:
            c = c.cast("double")
            listed = [float(n) for n in numbers if abs(n) >= 2]
            conditions += [c.isin(listed)] if listed else []
            conditions += [F.abs(c - F.lit(float(n))) < F.lit(EPSILON) for n in numbers if abs(n) < 2]
        return any_of(conditions)


def moment(text: str) -> datetime.datetime | None:
    """The time that a text of one of the two plain forms names, if there is such a time."""
    if not (DATE.fullmatch(text) or SECOND.fullmatch(text)):
        return None
    try:
        return datetime.datetime.fromisoformat(text)
    except ValueError:
        return None


def condition(text: Node | str, schema: T.StructType, strict: bool = False) -> Column:
    """The filter as a Column to filter by."""
    return Compiler(schema, strict).compile(text)


def truth(text: Node | str, schema: T.StructType, strict: bool = False) -> Column:
    """The filter as a Column that is never null, to select."""
    return F.coalesce(condition(text, schema, strict), F.lit(False))
