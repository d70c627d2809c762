"""Filters on single rows in plain Python, by the same definition that the compiler follows."""

from __future__ import annotations

import datetime
import math
from collections.abc import Mapping

from parcela.functions.compile import EPSILON
from parcela.functions.scalars import iso
from parcela.functions.where import Always, And, Compare, In, IsNull, Literal, Node, Not, Or, number_in, plain_number


def field_value(row: Mapping[str, object], name: str):
    """The value of the field of exactly this name, or else of the first that differs in the case of ASCII letters only."""
    if name in row:
        return row[name]
    fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    return next((v for k, v in row.items() if fold(k) == fold(name)), None)


def number_of(value) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def text_of(value) -> str | None:
    """What a value is compared as with a string; None for geometries and bytes."""
    if isinstance(value, str):
        return value
    if isinstance(value, datetime.datetime):
        return iso(value)
    number = number_of(value)
    return None if number is None else plain_number(number)


def order(value, literal: Literal) -> int | None:
    """-1, 0 or 1 as the value is less than, equal to or greater than the literal; None if they can't be compared."""
    if isinstance(literal, bool):
        truth = value if isinstance(value, bool) else value != 0 if isinstance(value, int) else None
        return None if truth is None else truth - literal
    number, other = number_of(value), number_in(literal) if isinstance(literal, str) else literal
    if number is not None and other is not None:
        other = float(other)
        return -1 if math.isnan(number) or math.isnan(other) else (number > other) - (number < other)
    text = text_of(value)
    if not isinstance(literal, str) or text is None:
        return None
    a, b = text.encode("utf-8", "surrogatepass"), literal.encode("utf-8", "surrogatepass")
    return (a > b) - (a < b)


def listed(value, literal: Literal) -> bool:
    """Whether a value counts as this member of a list: numbers may differ by less than the spacing at 1."""
    number, other = number_of(value), number_in(literal) if isinstance(literal, str) else literal
    if number is not None and other is not None and not isinstance(literal, bool):
        return abs(number - float(other)) < EPSILON
    return literal is not None and order(value, literal) == 0


def holds(node: Node, row: Mapping[str, object]) -> bool:
    """Whether a filter holds for a row. Integers count as short ones for TRUE and FALSE; rows don't tell their width."""
    match node:
        case Always():
            return True
        case And(left, right):
            return holds(left, row) and holds(right, row)
        case Or(left, right):
            return holds(left, row) or holds(right, row)
        case Not(of):
            return not holds(of, row)
        case IsNull(name, negated):
            return (field_value(row, name) is None) != negated
        case In(name, values, negated):
            value = field_value(row, name)
            return (None in values if value is None else any(listed(value, v) for v in values)) != negated
        case Compare(name, operator, literal):
            value = field_value(row, name)
            found = None if value is None or literal is None else order(value, literal)
            return found is not None and {"=": found == 0, "<>": found != 0, "<": found < 0, "<=": found <= 0, ">": found > 0, ">=": found >= 0}[operator]
    raise TypeError(node)
