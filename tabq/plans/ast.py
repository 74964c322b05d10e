"""Syntax trees. Names are not resolved here: a word may turn out to be a column or a literal."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Word:
    text: str
    quoted: bool = False


@dataclass(frozen=True)
class Binary:
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Negate:
    of: Expr


@dataclass(frozen=True)
class Case:
    """With ``of``, whens hold values; without, predicates."""

    of: Expr | None
    whens: tuple[tuple[Expr | Pred, Expr], ...]
    other: Expr | None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


Expr = Word | Binary | Negate | Case | Call


@dataclass(frozen=True)
class Chain:
    """``and``, ``or`` or ``xor`` of a predicate and all that follows it."""

    op: str
    left: Pred
    right: Pred


@dataclass(frozen=True)
class Not:
    of: Pred


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr
    negated: bool = False


@dataclass(frozen=True)
class Between:
    of: Expr
    low: Expr
    high: Expr
    negated: bool = False


@dataclass(frozen=True)
class Like:
    of: Expr
    pattern: str
    negated: bool = False


@dataclass(frozen=True)
class In:
    of: Expr
    items: tuple[Expr, ...]
    negated: bool = False


Pred = Chain | Not | Compare | Between | Like | In


@dataclass(frozen=True)
class Selection:
    of: Expr | None  # None: all columns
    alias: str | None = None
    distinct: bool = False
    hidden: bool = False


@dataclass(frozen=True)
class Source:
    path: str
    alias: str | None
    header: bool


@dataclass(frozen=True)
class Join:
    source: Source
    how: str
    hint: str | None
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Query:
    selections: tuple[Selection, ...]
    source: Source
    joins: tuple[Join, ...] = ()
    where: Pred | None = None
    group: tuple[Expr, ...] = ()
    having: Pred | None = None
    order: Expr | None = None
    ascending: bool = False
    limit: int = 0
    numbers_are_columns: bool = False
    notes: list[str] = field(default_factory=list, compare=False)
