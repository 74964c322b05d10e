"""The six types: how texts are read as them, how two of them combine, and their Spark forms."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

NULL, INT, FLOAT, DATE, DURATION, STRING = range(6)
NAMES = ("null", "integer", "float", "date", "duration", "string")
SPARK = ("string", "bigint", "double", "timestamp_ntz", "interval day to second", "string")

#: The type of an operation by its operands. Rows: the left operand; columns: the right one, in the order null, integer,
#: float, date, duration, string, each first as a column or expression (c), then as a literal (l). I integer, F float,
#: D date, U duration, S string.
_CHART = """
null c  S S  S S  S S  S S  S S  S S
null l  S S  I I  F F  D D  U U  S S
int c   S I  I I  F F  D I  U U  S I
int l   S I  I I  F F  D I  U U  S S
float c S F  F F  F F  D F  U F  S F
float l S F  F F  F F  D F  U U  S S
date c  S D  D D  D D  D D  D D  D D
date l  S D  I I  F F  D D  D D  S S
dur c   S U  U U  U U  D D  U U  S U
dur l   S U  U U  F U  D D  U U  S S
str c   S S  S S  S S  D S  S S  S S
str l   S S  I S  F S  D S  U S  S S
"""
_CODES = {"I": INT, "F": FLOAT, "D": DATE, "U": DURATION, "S": STRING}
CHART = [[_CODES[x] for x in line.split()[2:]] for line in _CHART.strip().splitlines()]


def combined(left: int, left_literal: bool, right: int, right_literal: bool) -> int:
    return CHART[2 * left + left_literal][2 * right + right_literal]


#: Seconds in the units of a duration; a year is 52 weeks.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "year": 31449600}
_SHORT = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "y": "year"}
_DURATION = re.compile(r"\s*(-?\d*\.?\d+) (seconds?|minutes?|hours?|days?|weeks?|years?|[smhdwy])\s*", re.I)
_COMPOUND = re.compile(r"\s*([+-]?)((?:\d*\.?\d+(?:ms|us|ns|h|m|s))+)\s*")
_COMPOUND_PART = re.compile(r"(\d*\.?\d+)(ms|us|ns|h|m|s)")
_SECONDS = {"h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}

#: Date formats, for literals (Python) and for columns (Spark), in the order in which they are tried. Times are optional.
_DATES = [
    ("%Y-%m-%d", "y-M-d"), ("%m/%d/%Y", "M/d/y"), ("%Y/%m/%d", "y/M/d"), ("%B %d %Y", "MMMM d y"), ("%B %d, %Y", "MMMM d, y"),
    ("%b %d %Y", "MMM d y"), ("%b %d, %Y", "MMM d, y"), ("%d %B %Y", "d MMMM y"), ("%d %b %Y", "d MMM y"), ("%m/%d/%y", "M/d/yy"),
]
_TIMES = [("", ""), (" %H:%M:%S", " H:m:s"), ("T%H:%M:%S", "'T'H:m:s"), (" %H:%M", " H:m"), (" %I:%M:%S %p", " h:m:s a"), (" %I:%M %p", " h:m a")]


def parse_duration(text: str) -> timedelta | None:
    if m := _DURATION.fullmatch(text):
        unit = m[2].lower()
        unit = _SHORT.get(unit, unit.rstrip("s") if len(unit) > 1 else unit)
        return timedelta(seconds=int(float(m[1]) * UNITS[unit]))
    if m := _COMPOUND.fullmatch(text):
        total = sum(float(n) * _SECONDS[u] for n, u in _COMPOUND_PART.findall(m[2]))
        return timedelta(seconds=-total if m[1] == "-" else total)
    return None


def parse_date(text: str) -> datetime | None:
    text = re.sub(r"(\d{2}:\d{2}:\d{2})\.\d+$", r"\1", text.strip())
    if re.fullmatch(r"[12]\d{3}", text):  # a year alone, against a date
        return datetime(int(text), 1, 1)
    for d, _ in _DATES:
        for t, _ in _TIMES:
            try:
                return datetime.strptime(text, d + t)
            except ValueError:
                continue
    return None


def is_null_text(text: str | None) -> bool:
    return text is None or text.strip() == "" or text.strip().lower() == "null"


def _number(text: str, kind: type):
    if "_" in text:
        return None
    try:
        return kind(text)
    except ValueError:
        return None


def infer(text: str | None) -> int:
    """The narrowest type of one text."""
    if is_null_text(text) or text.strip() == "NA":
        return NULL
    text = text.strip()
    if re.fullmatch(r"0\d+", text):
        return STRING
    if (n := _number(text, int)) is not None and -(2**63) <= n < 2**63:
        return INT
    if _number(text, float) is not None:
        return FLOAT
    if parse_duration(text) is not None:
        return DURATION
    return DATE if parse_date(text) is not None else STRING


def literal(text: str, kind: int) -> Column:
    """A literal as one of the types; a text that is none of that type is an error."""
    spark = SPARK[kind]
    if kind != STRING and is_null_text(text):
        return F.lit(None).cast(spark)
    if kind == STRING:
        return F.lit(None).cast("string") if text == "null" else F.lit(text)
    if kind == NULL:
        return F.lit(None).cast(spark)
    value = {INT: lambda: _number(text, int), FLOAT: lambda: _number(text, float), DATE: lambda: parse_date(text), DURATION: lambda: parse_duration(text)}[kind]()
    if value is None:
        raise QueryError(f"could not parse {text!r} as {NAMES[kind]}")
    if kind == DATE:
        return F.lit(value.strftime("%Y-%m-%d %H:%M:%S").zfill(19)).cast(spark)
    return F.lit(value).cast(spark)


def of_spark(kind: str) -> int:
    """The type of a column of a Spark table."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return INT
    if kind in ("float", "double") or kind.startswith("decimal"):
        return FLOAT
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return DATE
    if kind.startswith("interval") and "month" not in kind and "year" not in kind:
        return DURATION
    return STRING


def date_column(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(d + t)).cast("timestamp_ntz") for _, d in _DATES for _, t in _TIMES])


def duration_column(text: Column) -> Column:
    """Durations in either writing; null for other texts."""
    word = r"^\s*(-?\d*\.?\d+) (?i:(second|minute|hour|day|week|year)s?|([smhdwy]))\s*$"
    amount = F.regexp_extract(text, word, 1).try_cast("double")
    unit = F.lower(F.concat(F.regexp_extract(text, word, 2), F.regexp_extract(text, word, 3)))
    table = F.create_map(*[F.lit(x) for k, v in [*UNITS.items(), *((s, UNITS[u]) for s, u in _SHORT.items())] for x in (k, v)])
    plain = F.when(text.rlike(word), F.floor(F.abs(amount) * F.element_at(table, unit)) * F.signum(amount))
    parts = [F.coalesce(F.regexp_extract(text, rf"(\d*\.?\d+){u}(?![a-z])", 1).try_cast("double"), F.lit(0.0)) * s for u, s in _SECONDS.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    compound = F.when(text.rlike(r"^\s*[+-]?(\d*\.?\d+(ms|us|ns|h|m|s))+\s*$"), F.when(text.rlike(r"^\s*-"), -total).otherwise(total))
    return F.make_dt_interval(secs=F.coalesce(plain, compound).cast("decimal(18,6)"))


def shown(value: Column, kind: int) -> Column:
    """A value as text."""
    if kind == FLOAT:
        whole = (value == F.floor(value)) & (F.abs(value) < 1e10)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    if kind == DATE:
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if kind == DURATION:
        return duration_text(value)
    return value.cast("string")


def seconds(value: Column) -> Column:
    """A duration in seconds."""
    return (F.extract(F.lit("DAY"), value) * 86400 + F.extract(F.lit("HOUR"), value) * 3600 + F.extract(F.lit("MINUTE"), value) * 60 + F.extract(F.lit("SECOND"), value)).cast("double")


def duration_text(value: Column) -> Column:
    """Hours, minutes and seconds, like ``26h3m0s``, without leading zero units."""
    s = F.abs(seconds(value))
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, F.round(s - F.floor(s / 60) * 60, 6)
    r = F.when(r == F.floor(r), r.cast("bigint").cast("string")).otherwise(r.cast("string"))
    text = F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.lit(""))
    return F.concat(F.when(seconds(value) < 0, F.lit("-")).otherwise(F.lit("")), text, r, F.lit("s"))


def converted(value: Column, kind: int, to: int) -> Column:
    """A value of one type as another; what cannot be read is null."""
    if kind == to or NULL in (kind, to) and STRING in (kind, to):
        return value
    if kind == NULL:
        kind = STRING
    if to in (STRING, NULL):
        return shown(value, kind)
    if kind in (INT, FLOAT) and to in (INT, FLOAT):
        return value.try_cast(SPARK[to])
    text = F.trim(value if kind == STRING else shown(value, kind))
    if to in (INT, FLOAT):
        return text.try_cast(SPARK[to])
    return date_column(text) if to == DATE else duration_column(text)
