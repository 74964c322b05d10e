"""Equality joins over expressions of one table each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import types as t
from ..functions.expressions import Scope, typed
from ..plans.ast import Join
from ..sources.catalog import size_of

#: Fixed value: a file up to this size counts as small.
SMALL_BYTES = 100_000_000


def join(df: DataFrame, clause: Join, scope: Scope) -> DataFrame:
    """``df`` joined with the last table of ``scope``. Null keys match nothing.

    ``small`` broadcasts, but only a table whose estimated size is under :data:`SMALL_BYTES`; ``big`` merges sorted
    sides. Without either word, Catalyst and adaptive execution decide.
    """
    new = len(scope.tables) - 1
    sides = [typed(clause.left, scope), typed(clause.right, scope)]
    for side in sides:
        if len(side.tables) != 1:
            raise QueryError("each side of a join condition must use exactly one file")
    used = [next(iter(s.tables)) for s in sides]
    if used.count(new) != 1:
        raise QueryError("one side of a join condition must be the joined file, the other an earlier one")
    kind = t.combined(sides[0].kind, sides[0].literal, sides[1].kind, sides[1].literal)
    right = scope.tables[new].df
    if clause.hint == "small" and size_of(right) <= SMALL_BYTES:
        right = F.broadcast(right)
    elif clause.hint == "big":
        right = right.hint("merge")
    return df.join(right, sides[0].to(kind) == sides[1].to(kind), clause.how)
