"""Conversions between values and their texts, OLE dates, UUIDs, and the coordinates' integer grid."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime.datetime(1899, 12, 30)
DAY_MICROS = 86_400_000_000
#: Microseconds from the OLE epoch to the Unix epoch.
UNIX_MICROS = 25_569 * DAY_MICROS
#: Defaults of the grid: origin and scale. Fixed values.
GRID_ORIGIN, GRID_SCALE = -2147483647.0, 1e9


def iso_text(time: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS, and the fraction with six digits if there is one."""
    micros = F.date_format(time, "SSSSSS")
    return F.concat(F.date_format(time, "yyyy-MM-dd HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")))


def ole_to_time(days: Column) -> Column:
    """The time, without zone, of a number of days since 1899-12-30, to the microsecond."""
    micros = F.round(days * F.lit(float(DAY_MICROS))).cast("long") - F.lit(UNIX_MICROS)
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def time_to_ole(time: Column) -> Column:
    """The days since 1899-12-30 of a time without zone (in a session whose zone is UTC)."""
    return (F.unix_micros(time.cast("timestamp")) + F.lit(UNIX_MICROS)) / F.lit(float(DAY_MICROS))


def uuid_text(raw: Column) -> Column:
    """16 bytes in storage order as lower-case text with hyphens."""
    digits = F.lower(F.hex(raw))
    return F.when(raw.isNotNull(), F.concat_ws("-", *[F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def uuid_bytes(text: Column) -> Column:
    """The bytes of a text with exactly 32 hexadecimal digits, whatever stands between them; null for another."""
    digits = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.when(F.length(digits) == 32, F.unhex(digits))


def to_grid(x: Column, origin: float = GRID_ORIGIN, scale: float = GRID_SCALE) -> Column:
    return F.round((x - F.lit(origin)) * F.lit(scale)).cast("long")


def from_grid(g: Column, origin: float = GRID_ORIGIN, scale: float = GRID_SCALE) -> Column:
    return g.cast("double") / F.lit(scale) + F.lit(origin)


def is_dataset_xml(xml: Column) -> Column:
    """Whether a definition describes a table, feature class or feature dataset."""
    return xml.rlike(r"^\s*<(DETable|DEFeatureClass|DEFeatureDataset)")


def xml_wkt(xml: Column) -> Column:
    found = F.regexp_extract(xml, "(?s)<WKT>(.*?)</WKT>", 1)
    return F.when(found != "", found)


def xml_geometry_type(xml: Column) -> Column:
    found = F.regexp_extract(xml, "(?s)<GeometryType>(.*?)</GeometryType>", 1)
    return F.when(found != "", found)


SPARK_TYPES = {"int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "oid": "bigint"}


def typed(text: Column, kind: str) -> Column:
    """parse_value() over a column: NULL in any case is null, and a text that doesn't fit the kind is an error."""
    if kind in SPARK_TYPES:
        form = r"[+]?[0-9]+" if kind == "oid" else r"[+-]?[0-9]+" if kind.startswith("int") else r"(?i)[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)"
        value = F.when(text.rlike(f"^(?:{form})$"), text.try_cast(SPARK_TYPES[kind]))
    elif kind in ("datetime", "date", "time"):
        part = lambda pattern, n: F.coalesce(F.regexp_extract(text, pattern, n).try_cast("int"), F.lit(0))
        day, clock = r"^(\d+)-(\d+)-(\d+)", r"[ T](\d+):(\d+):(\d+)"
        micros = F.rpad(F.substring(F.regexp_extract(text, r"[ T]\d+:\d+:\d+\.(\d+)", 1), 1, 6), 6, "0").try_cast("int")
        whole = F.make_timestamp_ntz(*[part(day, n) for n in (1, 2, 3)], *[part(clock, n) for n in (1, 2)], part(clock, 3).cast("decimal(8,6)"))
        value = F.when(text.rlike(day), F.timestamp_micros(F.unix_micros(whole.cast("timestamp")) + micros).cast("timestamp_ntz"))
    elif kind == "uuid":
        value = uuid_text(uuid_bytes(text))
    else:
        value = text
    null = text.isNull() | (F.lower(text) == "null")
    return F.when(~null, F.coalesce(value, F.raise_error(F.concat(F.lit(f"not a value of kind {kind}: "), text)).cast(SPARK_TYPES.get(kind, "timestamp_ntz" if kind in ("datetime", "date", "time") else "string"))))


def shown_column(value: Column, kind: str) -> Column:
    """A value as the command line shows it."""
    if kind in ("binary", "raster"):
        text = F.concat(F.lit("<binary "), F.length(value).cast("string"), F.lit(" bytes>"))
    elif kind in ("datetime", "date", "time"):
        text = iso_text(value)
    elif kind in ("float32", "float64"):
        from parcela.functions.geometry import number_text

        text = number_text(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("<null>"))


# Plain Python forms, for values that come one at a time (the command line, tests).


def ole_days(time: datetime.datetime) -> float:
    return ((time - EPOCH) // datetime.timedelta(microseconds=1)) / DAY_MICROS


def ole_time(days: float) -> datetime.datetime:
    micros = days * DAY_MICROS
    return EPOCH + datetime.timedelta(microseconds=int(abs(micros) + 0.5) * (1 if micros >= 0 else -1))


def iso(time: datetime.datetime) -> str:
    return f"{time:%Y-%m-%d %H:%M:%S}".zfill(19) + (f".{time.microsecond:06d}" if time.microsecond else "")


def uuid_of(raw: bytes) -> str:
    digits = raw.hex()
    return "-".join((digits[:8], digits[8:12], digits[12:16], digits[16:20], digits[20:]))


def parse_uuid(text: str) -> str:
    digits = re.sub("[^0-9A-Fa-f]", "", text)
    if len(digits) != 32:
        raise ValueError(f"a UUID has 32 hexadecimal digits, not {len(digits)}: {text}")
    return uuid_of(bytes.fromhex(digits))


def parse_time(text: str) -> datetime.datetime:
    """YYYY-MM-DD, with HH:MM:SS[.f] after a space or T; parts of the time that are missing or no numbers are 0."""
    date, _, time = text.replace("T", " ", 1).partition(" ")
    parts = re.fullmatch(r"(-?\d+)-(\d+)-(\d+).*", date)
    if not parts:
        raise ValueError(f"a date has the form YYYY-MM-DD: {text}")
    whole = lambda s: int(s) if s.isdigit() else 0
    hour, minute, second = (time.split(":") + ["", "", ""])[:3]
    second, _, fraction = second.partition(".")
    micros = "".join(c for c in fraction if c.isdigit())[:6].ljust(6, "0")
    return datetime.datetime(*map(int, parts.groups()), whole(hour), whole(minute), whole(second), int(micros))


def parse_value(text: str, kind: str):
    """A value of a field of this kind from its text; NULL in any case is null for every kind."""
    if text.lower() == "null":
        return None
    ranges = {"int16": 16, "int32": 32, "int64": 64}
    if kind in ranges:
        if not re.fullmatch("[+-]?[0-9]+", text) or not -(1 << ranges[kind] - 1) <= int(text) < 1 << ranges[kind] - 1:
            raise ValueError(f"{text!r} is not an {kind}")
        return int(text)
    if kind == "oid":
        if not re.fullmatch("[+]?[0-9]+", text):
            raise ValueError(f"{text!r} is not an object id")
        return int(text)
    if kind in ("float32", "float64"):
        from parcela.functions.where import NUMBER

        if not NUMBER.fullmatch(text):
            raise ValueError(f"{text!r} is not a {kind}")
        return float(text)
    if kind in ("string", "xml"):
        return text
    if kind in ("datetime", "date", "time"):
        return parse_time(text)
    if kind == "uuid":
        return parse_uuid(text)
    raise ValueError(f"values of kind {kind} can't be given as text")


def zero(kind: str):
    """What a field that must not be null holds if nothing is given."""
    if kind in ("int16", "int32", "int64", "oid"):
        return 0
    if kind in ("float32", "float64"):
        return 0.0
    return {"string": "", "xml": "", "datetime": EPOCH, "date": EPOCH, "time": EPOCH, "uuid": uuid_of(bytes(16)), "binary": b"", "raster": b""}.get(kind)
