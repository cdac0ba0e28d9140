"""Equi-joins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from prepflow.schema import col, name_list, require_columns

# The join words a user may write.
JOIN_KINDS = {
    "inner": "inner",
    "left": "left",
    "right": "right",
    "outer": "full",
    "full": "full",
    "semi": "semi",
    "anti": "anti",
}


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_keys: str | Iterable[str] | None = None,
    right_keys: str | Iterable[str] | None = None,
    how: str = "left",
    suffix: str = "_right",
    hint: str | None = None,
    coalesce_keys: bool = False,
) -> DataFrame:
    """Join on equal keys; null keys never match.

    The key columns of the other side are dropped (of the right table for inner
    and left joins, of the left table for right joins); a full join keeps both,
    or one coalesced set with ``coalesce_keys``.  Right columns whose name is
    taken get ``suffix``.  Without keys the left table is returned unchanged.

    Which side is broadcast is left to Spark, which checks sizes; ``hint`` is
    passed on to the right side for users who know better.

    Every input stands in the plan once, so chained joins grow it by one join
    each.  A key may hold a large part of a table: adaptive execution splits such
    keys of both sides of an inner join and of the side whose rows a left or right
    join keeps.  Semi and anti joins look at distinct keys of the other side, which
    combine before the shuffle.
    """
    left_names, right_names = name_list(left_keys), name_list(right_keys)
    if not left_names or not right_names:
        return left
    if len(left_names) != len(right_names):
        raise ValueError(
            f"join: {len(left_names)} left keys but {len(right_names)} right keys"
        )
    require_columns(left, left_names, "join (left)")
    require_columns(right, right_names, "join (right)")
    kind = JOIN_KINDS.get(how.lower())
    if kind is None:
        raise ValueError(f"join: unknown kind {how!r}; use one of {sorted(JOIN_KINDS)}")

    if kind in ("semi", "anti"):
        return match_only(left, right, left_names, right_names, kind, hint)

    # Both sides get private names, so that equal names and self-joins stay apart.
    l_of = {n: f"__l{i}" for i, n in enumerate(left.columns)}
    r_of = {n: f"__r{i}" for i, n in enumerate(right.columns)}
    l_side = left.select(*(col(n).alias(a) for n, a in l_of.items()))
    r_side = right.select(*(col(n).alias(a) for n, a in r_of.items()))
    if hint:
        r_side = r_side.hint(hint)
    pairs = [(l_of[a], r_of[b]) for a, b in zip(left_names, right_names)]
    equal = all_equal(pairs)

    joined = l_side.join(r_side, equal, kind)

    if kind == "right":
        kept_left = [n for n in left.columns if n not in left_names]
        kept_right = list(right.columns)
    elif kind == "full" and not coalesce_keys:
        kept_left, kept_right = list(left.columns), list(right.columns)
    else:
        kept_left = list(left.columns)
        kept_right = [n for n in right.columns if n not in right_names]

    out = []
    for n in kept_left:
        column = F.col(l_of[n])
        if kind == "full" and coalesce_keys and n in left_names:
            column = F.coalesce(column, F.col(r_of[right_names[left_names.index(n)]]))
        out.append(column.alias(n))
    taken = set(kept_left)
    out += [F.col(r_of[n]).alias(n + suffix if n in taken else n) for n in kept_right]
    return joined.select(*out)


def all_equal(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(a) == F.col(b) for a, b in pairs))


def match_only(
    left: DataFrame,
    right: DataFrame,
    left_names: list[str],
    right_names: list[str],
    kind: str,
    hint: str | None,
) -> DataFrame:
    """Left rows with (semi) or without (anti) a partner."""
    marks = [f"__k{i}" for i in range(len(right_names))]
    keys = right.select(*(col(n).alias(m) for n, m in zip(right_names, marks)))
    keys = keys.filter(reduce(lambda a, b: a & b, (F.col(m).isNotNull() for m in marks))).distinct()
    if hint:
        keys = keys.hint(hint)
    equal = reduce(
        lambda a, b: a & b, (col(n) == F.col(m) for n, m in zip(left_names, marks))
    )
    return left.join(keys, equal, f"left_{kind}")


def null_safe_join(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Inner join of tables that hold one row per key set each; null keys match."""

    def pair(left: DataFrame, right: DataFrame) -> DataFrame:
        marks = {k: f"__k{i}" for i, k in enumerate(keys)}
        renamed = right.withColumnsRenamed(marks)
        same = reduce(
            lambda a, b: a & b, (col(k).eqNullSafe(F.col(m)) for k, m in marks.items())
        )
        return left.join(renamed, same).drop(*marks.values())

    return reduce(pair, frames)
