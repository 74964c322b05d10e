"""Syntax trees to Spark columns: names, types and two-valued logic."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.ast import Between, Binary, Call, Case, Chain, Compare, Expr, In, Like, Negate, Not, Pred, Word
from ..plans.parser import AGGREGATES
from ..sources.catalog import Table
from . import types as t
from .crypt import decrypt, encrypt

_NUMBERS = (t.INT, t.FLOAT)


@dataclass
class Typed:
    """An expression with its type; ``to`` gives it as a column of some type."""

    kind: int
    literal: bool
    to: Callable[[int], Column]
    tables: frozenset[int] = frozenset()
    aggregate: bool = False
    plain: bool = False  # holds a column outside an aggregate
    text: str | None = None  # a literal's own text

    @property
    def column(self) -> Column:
        return self.to(self.kind)


@dataclass
class Switches:
    between_inclusive: bool = False
    left_assoc: bool = False
    like_regex: bool = True
    password: str | None = None


@dataclass
class Scope:
    """What an expression can refer to."""

    tables: list[Table]
    numbers_are_columns: bool = False
    switches: Switches = field(default_factory=Switches)
    aggregates: bool = True
    where: str = "here"
    grouped: dict[Expr, str] | None = None  # group expressions and the columns that hold them
    last: Callable[[Column], Column] | None = None  # what stands for a plain column among aggregates
    counter: Column | None = None  # rows so far, for inc()
    notes: list[str] = field(default_factory=list)


# Names.


def find_column(word: Word, scope: Scope) -> tuple[int, int] | None:
    """Table and position of the column that a word names, if it names one."""
    text, table = word.text, 0
    aliased = len(scope.tables) > 1 or bool(scope.tables[0].keys)
    if aliased and "." in text:
        head, _, tail = text.partition(".")
        owner = next((i for i, x in enumerate(scope.tables) if head.lower() in x.keys), None)
        if owner is not None:
            table, text = owner, tail
    columns = scope.tables[table].names
    ordinal = re.fullmatch(r"\d+" if scope.numbers_are_columns else r"(?!)", text) or re.fullmatch(r"c(\d+)", text)
    if ordinal and not word.quoted:
        n = int(ordinal[ordinal.lastindex or 0])
        if not 1 <= n <= len(columns):
            raise QueryError(f"there is no column {n}; the table has {len(columns)}")
        return table, n - 1
    low = text.lower()
    return next(((table, i) for i, c in enumerate(columns) if c.lower() == low), None)


def _word(word: Word, scope: Scope) -> Typed:
    found = find_column(word, scope)
    if found is None:
        if any(word.text.lower() == c.lower() for x in scope.tables[1:] for c in x.names):
            scope.notes.append(f"{word.text!r} is a column of a joined file, but without that file's alias it is a literal")
        return Typed(t.infer(word.text), True, lambda k: t.literal(word.text, k), text=word.text)
    table, i = found
    source = scope.tables[table]
    return Typed(source.types[i], False, lambda k: source.value(i, k), frozenset((table,)), plain=True)


# Expressions.


def typed(e: Expr, scope: Scope) -> Typed:
    if scope.grouped is not None and e in scope.grouped:
        return _group_key(e, scope)
    if isinstance(e, Word):
        return _plain_word(e, scope)
    if isinstance(e, Negate):
        x = typed(e.of, scope)
        if x.kind not in (t.INT, t.FLOAT, t.DURATION):
            raise QueryError(f"minus needs a number or duration, not a {t.NAMES[x.kind]}")
        return _like(x, x.kind, lambda k: t.converted(-x.to(x.kind), x.kind, k) if k not in _NUMBERS + (t.DURATION,) else -x.to(k))
    if isinstance(e, Binary):
        return _binary(e, scope)
    if isinstance(e, Case):
        return _case(e, scope)
    return _aggregate(e, scope) if e.name in AGGREGATES else _function(e, scope)


def _group_key(e: Expr, scope: Scope) -> Typed:
    kind = typed(e, Scope(scope.tables, scope.numbers_are_columns, scope.switches, aggregates=False)).kind
    name = scope.grouped[e]
    return Typed(kind, False, lambda k: t.converted(F.col(name), kind, k), plain=True)


def _plain_word(e: Word, scope: Scope) -> Typed:
    x = _word(e, scope)
    if x.literal or scope.last is None:
        return x
    held = x.to
    return Typed(x.kind, False, lambda k: scope.last(held(k)), x.tables, plain=True)


def _like(x: Typed, kind: int, to: Callable[[int], Column], *more: Typed) -> Typed:
    all_ = (x, *more)
    return Typed(kind, x.literal, to, frozenset().union(*[a.tables for a in all_]), any(a.aggregate for a in all_), any(a.plain for a in all_))


def _unmixed(parts: list[Typed], what: str) -> None:
    if any(p.aggregate for p in parts) and any(p.plain for p in parts):
        raise QueryError(f"{what} mixes an aggregate with something that is neither an aggregate nor a literal")


def _fold(parts: list[Typed]) -> int:
    kind, lit = parts[0].kind, parts[0].literal
    for p in parts[1:]:
        kind, lit = t.combined(kind, lit, p.kind, p.literal), lit and p.literal
    return kind


def _binary(e: Binary, scope: Scope) -> Typed:
    a, b = typed(e.left, scope), typed(e.right, scope)
    _unmixed([a, b], "arithmetic")
    op, x, y = e.op, a.kind, b.kind
    own = (t.DATE, t.DURATION)
    if op in "+-" and {x, y} <= set(own):
        if op == "+" and x == y == t.DATE or op == "-" and x == t.DURATION and y == t.DATE:
            raise QueryError("two dates cannot be added" if op == "+" else "a date cannot be taken from a duration")
        kind = t.DURATION if x == y else t.DATE
        made = lambda: a.to(x) + b.to(y) if op == "+" else a.to(x) - b.to(y)
        return _like(a, kind, lambda k: t.converted(made(), kind, k), b)
    if op in "*/" and t.DURATION in (x, y) and (x in _NUMBERS or y in _NUMBERS):
        if op == "/" and y == t.DURATION:
            raise QueryError("a number cannot be divided by a duration")
        span, factor = (a, b) if x == t.DURATION else (b, a)
        by = lambda: factor.to(t.FLOAT)
        made = lambda: span.to(t.DURATION) * by() if op == "*" else span.to(t.DURATION) / F.nullif(by(), F.lit(0.0))
        return _like(a, t.DURATION, lambda k: t.converted(made(), t.DURATION, k), b)
    kind = t.combined(x, a.literal, y, b.literal)
    if op == "%" and not x == y == kind == t.INT:
        raise QueryError("% needs integers")
    if op in "*/" and not {x, y} <= set(_NUMBERS) or op == "^" and kind not in _NUMBERS:
        raise QueryError(f"{op} needs numbers, not {t.NAMES[x]} and {t.NAMES[y]}")
    if op in "+-" and kind not in (*_NUMBERS, t.STRING):
        raise QueryError(f"{op} cannot take {t.NAMES[x]} and {t.NAMES[y]}")
    a.to(kind), b.to(kind)  # a literal that is none of that type is an error now

    def made_as(k: int) -> Column:
        as_ = k if k in _NUMBERS and kind in _NUMBERS and op in "+-*/" and not (k == t.INT and kind == t.FLOAT) else kind
        if k == t.STRING and op in "+-":
            as_ = t.STRING
        l, r = a.to(as_), b.to(as_)
        if as_ == t.STRING:
            value = F.concat(l, r) if op == "+" else l
        elif op == "/":
            value = _int_divide(l, r) if as_ == t.INT else F.try_divide(l, r)
        elif op == "%":
            value = l % F.nullif(r, F.lit(0).cast("bigint"))
        elif op == "^":
            value = F.pow(l, r).try_cast("bigint") if as_ == t.INT else F.pow(l, r)
        else:
            value = {"+": l.__add__, "-": l.__sub__, "*": l.__mul__}[op](r)
        return t.converted(value, as_, k)

    return _like(a, kind, made_as, b)


def _int_divide(a: Column, b: Column) -> Column:
    """Integer division that truncates; null for a divisor of 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint")))


def _case(e: Case, scope: Scope) -> Typed:
    results = [typed(r, scope) for _, r in e.whens] + ([typed(e.other, scope)] if e.other is not None else [])
    kind = _fold(results)
    if e.of is None:
        tests = [predicate(p, scope) for p, _ in e.whens]
        asked = [x for p, _ in e.whens for x in operands(p, scope)]
    else:
        asked = [typed(e.of, scope), *[typed(v, scope) for v, _ in e.whens]]
        by = _fold(asked)
        tests = [asked[0].to(by).eqNullSafe(v.to(by)) for v in asked[1:]]
    _unmixed([*results, *asked], "case")
    [r.to(kind) for r in results]

    def to(k: int) -> Column:
        out = F.when(tests[0], results[0].to(k))
        for test, r in zip(tests[1:], results[1:], strict=False):
            out = out.when(test, r.to(k))
        return out.otherwise(results[-1].to(k)) if e.other is not None else out

    made = _like(results[0], kind, to, *results[1:], *asked)
    made.literal = False
    return made


#: What a function of a date gives, and its type.
_DATE_PARTS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "year": (t.INT, F.year), "month": (t.INT, F.month), "dayofyear": (t.INT, F.dayofyear), "dayofmonth": (t.INT, F.dayofmonth), "hour": (t.INT, F.hour),
    "week": (t.INT, lambda d: F.floor(F.dayofyear(d) / 7)), "day": (t.INT, lambda d: F.dayofweek(d) - 1), "dayofweek": (t.INT, lambda d: F.dayofweek(d) - 1),
    "monthname": (t.STRING, lambda d: F.date_format(d, "MMMM")), "dayname": (t.STRING, lambda d: F.date_format(d, "EEEE")),
}


def _function(e: Call, scope: Scope) -> Typed:
    if e.name == "inc":
        step = float(e.args[0].text)
        if scope.counter is None:
            raise QueryError(f"inc() cannot be used {scope.where}")
        return Typed(t.FLOAT, False, lambda k: t.converted(F.lit(1.0) + F.lit(step) * scope.counter.cast("double"), t.FLOAT, k), plain=True)
    args = [typed(a, scope) for a in e.args]
    x = args[0]
    if e.name in _DATE_PARTS:
        if x.kind != t.DATE:
            raise QueryError(f"{e.name} needs a date, not a {t.NAMES[x.kind]}")
        kind, part = _DATE_PARTS[e.name]
        made = _like(x, kind, lambda k: t.converted(part(x.to(t.DATE)).cast(t.SPARK[kind]), kind, k))
        made.literal = False
        return made
    if e.name == "abs":
        if x.kind not in (t.INT, t.FLOAT, t.DURATION):
            raise QueryError(f"abs needs a number or duration, not a {t.NAMES[x.kind]}")
        return _like(x, x.kind, lambda k: F.abs(x.to(k)) if k in (t.INT, t.FLOAT, t.DURATION) else t.converted(F.abs(x.to(x.kind)), x.kind, k))
    if e.name == "coalesce":
        _unmixed(args, "coalesce")
        kind = _fold(args)
        return _like(x, kind, lambda k: F.coalesce(*[a.to(k) for a in args]), *args[1:])
    if e.name == "format":
        return x
    password = e.args[1].text if len(e.args) > 1 else scope.switches.password
    if not password:
        raise QueryError(f"{e.name} needs a password, in the query or in the settings")
    work = encrypt if e.name == "encrypt" else decrypt
    made = _like(x, t.STRING, lambda k: t.converted(work(x.to(t.STRING), password), t.STRING, k))
    made.literal = False
    return made


def _aggregate(e: Call, scope: Scope) -> Typed:
    if not scope.aggregates:
        raise QueryError(f"an aggregate cannot be used {scope.where}")
    if e.star:
        return Typed(t.FLOAT, False, lambda k: t.converted(F.count(F.lit(1)).cast("double"), t.FLOAT, k), aggregate=True)
    inner = Scope(scope.tables, scope.numbers_are_columns, scope.switches, False, "inside an aggregate", notes=scope.notes)
    x = typed(e.args[0], inner)
    kinds = {"sum": (t.INT, t.FLOAT, t.DURATION), "avg": (t.INT, t.FLOAT, t.DURATION), "stdev": _NUMBERS, "stdevp": _NUMBERS}
    if e.name in kinds and x.kind not in kinds[e.name]:
        raise QueryError(f"{e.name} cannot take a {t.NAMES[x.kind]}")
    kind = t.FLOAT if e.name in ("count", "stdev", "stdevp") or e.name == "avg" and x.kind == t.INT else x.kind

    def to(k: int) -> Column:
        v = x.to(x.kind)
        if e.name == "count":
            value = (F.count_distinct(v) if e.distinct else F.count(v)).cast("double")
        elif e.name == "sum":
            value = F.sum_distinct(v) if e.distinct else F.sum(v)
        elif e.name in ("min", "max"):
            value = F.min(v) if e.name == "min" else F.max(v)
        elif e.distinct:  # over the distinct values, which are collected as a set by group
            value = _of_set(e.name, F.collect_set(v), x.kind)
        else:
            value = {"avg": F.avg, "stdev": F.stddev_samp, "stdevp": F.stddev_pop}[e.name](v)
        return t.converted(value.cast(t.SPARK[kind]), kind, k)

    return Typed(kind, False, to, x.tables, aggregate=True)


def _of_set(name: str, values: Column, kind: int) -> Column:
    """avg, stdev or stdevp of an array."""
    if kind == t.DURATION:
        values = F.transform(values, t.seconds)
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.nullif(n, F.lit(0))
    if name == "avg":
        return F.make_dt_interval(secs=mean.cast("decimal(18,6)")) if kind == t.DURATION else mean
    squares = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v.cast("double") - mean) * (v.cast("double") - mean))
    return F.sqrt(squares / F.nullif(n - (1 if name == "stdev" else 0), F.lit(0)))


# Predicates: never null.


def operands(p: Pred, scope: Scope) -> list[Typed]:
    if isinstance(p, Chain):
        return operands(p.left, scope) + operands(p.right, scope)
    if isinstance(p, Not):
        return operands(p.of, scope)
    parts = {Compare: lambda: (p.left, p.right), Between: lambda: (p.of, p.low, p.high), Like: lambda: (p.of,), In: lambda: (p.of, *p.items)}[type(p)]()
    return [typed(x, scope) for x in parts]


def compare(op: str, a: Column, b: Column) -> Column:
    """Null equals null and is less than all else."""
    if op == "=":
        return a.eqNullSafe(b)
    if op == "<>":
        return ~a.eqNullSafe(b)
    if op == "<":
        return F.coalesce(a < b, a.isNull() & b.isNotNull())
    if op == ">":
        return F.coalesce(a > b, a.isNotNull() & b.isNull())
    if op == "<=":
        return F.coalesce(a <= b, F.lit(False))
    return F.coalesce(a >= b, a.isNotNull() & b.isNull())


def pushable(op: str, a: Column, b: Column) -> Column:
    """What :func:`compare` comes to in a filter for a ``b`` that is a literal and not null, in a form that scans can use."""
    return {"=": lambda: a == b, ">": lambda: a > b, ">=": lambda: a >= b, "<=": lambda: a <= b, "<": lambda: (a < b) | a.isNull(), "<>": lambda: (a != b) | a.isNull()}[op]()


def like_pattern(pattern: str, regex: bool) -> str:
    if not regex:
        pattern = re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", pattern)
    return "(?is)^" + pattern.replace("%", ".*").replace("_", ".") + "$"


def predicate(p: Pred, scope: Scope, top: bool = False) -> Column:
    """A predicate as a column that is true or false. At the ``top`` of a filter null would do for false."""
    if isinstance(p, Not):
        return ~predicate(p.of, scope)
    if isinstance(p, Chain):
        keep = top and p.op != "xor"  # under "or" too, null or true is true and null or false is not
        a, b = predicate(p.left, scope, keep), predicate(p.right, scope, keep)
        return a & b if p.op == "and" else a | b if p.op == "or" else a != b
    parts = operands(p, scope)
    _unmixed(parts, "a comparison")
    x = parts[0]
    if isinstance(p, Like):
        text = F.coalesce(x.to(t.STRING), F.lit(""))
        if not scope.switches.like_regex and re.fullmatch(r"[^%_\\]*", p.pattern):
            test = F.lower(text) == p.pattern.lower()
        else:
            test = text.rlike(like_pattern(p.pattern, scope.switches.like_regex))
        return ~test if p.negated else test
    kind = _fold(parts)
    cols = [q.to(kind) for q in parts]
    fixed = [q.literal and q.text is not None and not t.is_null_text(q.text) for q in parts[1:]]
    if isinstance(p, Compare):
        simple = top and not p.negated and all(fixed) and not x.literal
        test = pushable(p.op, *cols) if simple else compare(p.op, *cols)
        return ~test if p.negated else test
    if isinstance(p, Between):
        v, a, b = cols
        if top and not p.negated and all(fixed):
            low, high = F.least(a, b), F.greatest(a, b)
            return (v >= low) & (v <= high if scope.switches.between_inclusive else v < high)
        low, high = F.least(a, b), F.greatest(a, b)
        inside = (v >= low) & (v <= high if scope.switches.between_inclusive else v < high)
        known = v.isNotNull() & a.isNotNull() & b.isNotNull()
        return F.coalesce(known & (~inside if p.negated else inside), F.lit(False))
    if top and not p.negated and all(fixed):
        return cols[0].isin(*cols[1:])
    test = cols[0].eqNullSafe(cols[1])
    for c in cols[2:]:
        test = test | cols[0].eqNullSafe(c)
    return ~test if p.negated else test
