"""A parsed query to a DataFrame.

Without groups: scan, joins, where, order, distinct, limit, projection. With groups: scan, joins, where, distinct, groups,
having, order, limit. All physical choices are Catalyst's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import types as t
from ..functions.expressions import Scope, Switches, Typed, find_column, operands, predicate, typed
from ..operators.joins import join
from ..operators.rows import counted, distinct_on, ordered_by
from ..sources.catalog import Catalog
from .ast import Between, Binary, Call, Case, Chain, Compare, Expr, In, Like, Negate, Not, Pred, Query, Selection, Word
from .parser import AGGREGATES


@dataclass
class Planned:
    df: DataFrame
    names: list[str]
    types: list[int]
    notes: list[str] = field(default_factory=list)


def calls(e: Expr | Pred | None) -> list[Call]:
    """All function calls in an expression or predicate, outer ones first."""
    if e is None or isinstance(e, Word):
        return []
    if isinstance(e, Call):
        return [e, *[c for a in e.args for c in calls(a)]]
    if isinstance(e, Case):
        parts = [e.of, e.other, *[x for w in e.whens for x in w]]
    elif isinstance(e, Binary | Chain | Compare):
        parts = [e.left, e.right]
    elif isinstance(e, Between):
        parts = [e.of, e.low, e.high]
    elif isinstance(e, In):
        parts = [e.of, *e.items]
    elif isinstance(e, Negate | Not | Like):
        parts = [e.of]
    return [c for p in parts for c in calls(p)]


def _has(e: Expr | Pred | None, names: frozenset[str] | set[str]) -> bool:
    return any(c.name in names for c in calls(e))


class Planner:
    def __init__(self, query: Query, catalog: Catalog, switches: Switches):
        self.q, self.catalog, self.switches = query, catalog, switches
        self.notes: list[str] = []
        selected = [s.of for s in query.selections]
        self.grouped = bool(query.group) or any(_has(e, AGGREGATES) for e in [*selected, query.having, query.order])
        if query.having is not None and not self.grouped:
            raise QueryError("having needs an aggregate")
        self.counts = any(_has(e, {"inc"}) for e in selected)
        self.distinct = next((s for s in query.selections if s.distinct), None)

    def scope(self, **more) -> Scope:
        return Scope(self.tables, self.q.numbers_are_columns, self.switches, notes=self.notes, **more)

    def plan(self) -> Planned:
        q = self.q
        sources = [q.source, *[j.source for j in q.joins]]
        self.tables = [self.catalog.open(s.path, s.header, i, s.alias) for i, s in enumerate(sources)]
        last = self.grouped and self._needs_last()
        if self.distinct is not None or last:
            self.tables = [x.with_rowid() for x in self.tables]
        tables, self.tables = self.tables, self.tables[:1]
        df = tables[0].df
        for j, new in zip(q.joins, tables[1:], strict=True):
            self.tables = [*self.tables, new]
            df = join(df, j, self.scope(aggregates=False, where="in a join"))
        if q.where is not None:
            df = df.where(predicate(q.where, self.scope(aggregates=False, where="in where"), top=True))
        return self._groups(df) if self.grouped else self._rows(df)

    @property
    def rowid(self) -> Column:
        ids = [F.col(x.rowid) for x in self.tables]
        return ids[0] if len(ids) == 1 else F.struct(*ids)

    # Selections.

    def columns(self) -> list[Selection]:
        """Selections with all columns written out."""
        out = []
        for s in self.q.selections:
            if s.of is not None:
                out.append(s)
                continue
            for i, x in enumerate(self.tables):
                out += [Selection(_At(i, n), name) for n, name in enumerate(x.names)]
        return out

    def typed(self, e: Expr, scope: Scope) -> Typed:
        if isinstance(e, _At):
            source = self.tables[e.table]
            made = Typed(source.types[e.column], False, lambda k: source.value(e.column, k), frozenset((e.table,)), plain=True)
            if scope.last is None:
                return made
            held = made.to
            return Typed(made.kind, False, lambda k: scope.last(held(k)), made.tables, plain=True)
        return typed(e, scope)

    def named(self, selections: list[Selection]) -> list[str]:
        names = []
        for s in selections:
            if s.alias is not None:
                names.append(s.alias)
            elif isinstance(s.of, Word) and (at := find_column(s.of, self.scope())) is not None:
                names.append(self.tables[at[0]].names[at[1]])
            else:
                names.append(f"col{len(names) + 1}")
        return names

    def finish(self, df: DataFrame, selections: list[Selection], cols: list[Typed]) -> Planned:
        """The visible columns of ``df``, which has them as ``o0, o1, ...``."""
        shown = [i for i, s in enumerate(selections) if not s.hidden]
        names = self.named([selections[i] for i in shown])
        out = df.select(*[F.col(f"o{i}").alias(n) for i, n in zip(shown, names, strict=True)])
        return Planned(out, names, [cols[i].kind for i in shown], list(dict.fromkeys(self.notes)))

    # Without groups.

    def _rows(self, df: DataFrame) -> Planned:
        q, scope = self.q, self.scope(where="without an aggregate", counter=F.col("__count"))
        selections = self.columns()
        order = []
        if q.order is not None:
            order = [ordered_by(typed(q.order, self.scope(where="in order by")).column, q.ascending)]
        if self.distinct is not None:
            key = self.typed(self.distinct.of, scope).column
            df = distinct_on(df, key, [*order, self.rowid])
            if q.limit and not order:
                order = [self.rowid.asc()]
        if order:
            df = df.orderBy(*order)
        if q.limit:
            df = df.limit(q.limit)
        if self.counts:
            df = counted(df, order or ([F.monotonically_increasing_id()] if q.limit or q.joins or self.distinct is not None else None))
        cols = [self.typed(s.of, scope) for s in selections]
        out = df.select(*[c.column.alias(f"o{i}") for i, c in enumerate(cols)])
        return self.finish(out, selections, cols)

    # With groups.

    def _needs_last(self) -> bool:
        """Whether a selection or the order is taken from the last row of each group."""
        keys = set(self.q.group)

        def plain(e: Expr | Pred | None) -> bool:
            if e is None or e in keys:
                return False
            if isinstance(e, Word):
                return find_column(e, self.scope()) is not None
            if isinstance(e, Call):
                return e.name not in AGGREGATES and any(plain(a) for a in e.args)
            if isinstance(e, Case):
                return any(plain(x) for x in [e.of, e.other, *[y for w in e.whens for y in w]])
            if isinstance(e, Binary | Chain | Compare):
                return plain(e.left) or plain(e.right)
            if isinstance(e, Between):
                return plain(e.of) or plain(e.low) or plain(e.high)
            if isinstance(e, In):
                return any(plain(x) for x in (e.of, *e.items))
            return plain(e.of)

        return any(s.of is None for s in self.q.selections) or any(plain(e) for e in [*[s.of for s in self.q.selections], self.q.order])

    def _groups(self, df: DataFrame) -> Planned:
        q = self.q
        if self.counts:
            raise QueryError("inc() cannot be used with groups")
        before = self.scope(aggregates=False, where="in group by")
        if self.distinct is not None:
            inner = self.scope(aggregates=False, where="in distinct")
            df = distinct_on(df, self.typed(self.distinct.of, inner).column, [self.rowid])
        keys = {e: f"__g{i}" for i, e in enumerate(dict.fromkeys(q.group))}
        for e, name in keys.items():
            df = df.withColumn(name, typed(e, before).column)
        rowid = self.rowid
        scope = self.scope(grouped=keys, last=lambda c: F.max_by(c, rowid), where="here")
        selections = self.columns()
        cols = [self.typed(s.of, scope) for s in selections]
        made = [c.column.alias(f"o{i}") for i, c in enumerate(cols)]
        if q.having is not None:
            if any(x.plain for x in operands(q.having, scope)):
                raise QueryError("having compares aggregates and literals only")
            made.append(predicate(q.having, scope).alias("__having"))
        if q.order is not None:
            made.append(typed(q.order, scope).column.alias("__order"))
        out = df.groupBy(*keys.values()).agg(*made)
        if q.having is not None:
            out = out.where("__having")
        if q.order is not None:
            out = out.orderBy(ordered_by(F.col("__order"), q.ascending))
        if q.limit:
            out = out.limit(q.limit)
        return self.finish(out, selections, cols)


@dataclass(frozen=True)
class _At:
    """A column by table and position, from ``*``."""

    table: int
    column: int
