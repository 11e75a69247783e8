"""Bound queries as DataFrames: filtered scans, a left-deep join from the largest table on, a sort, a projection.

Everything is declarative: Catalyst pushes the filters and the columns into the
scans and picks the joins.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import literal
from ..plans.analyze import Bound, Scope
from ..plans.lang import Col, Compare, Value

OPS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def label(col: Col) -> str:
    """A column's name inside a plan: the table keeps like names apart."""
    return f"{col.table}.{col.name}"


def ref(col: Col) -> Column:
    return F.col(f"`{label(col)}`")


def predicate(c: Compare, scope: Scope) -> Column:
    right = literal(c.right, scope.field(c.left)) if isinstance(c.right, Value) else ref(c.right)
    return OPS[c.op](ref(c.left), right)


def conjunction(conditions: list[Column]) -> Column | None:
    return reduce(operator.and_, conditions) if conditions else None


def scan(df: DataFrame, table: str, conditions: list[Compare], scope: Scope) -> DataFrame:
    """A table with its columns labelled, under all conditions on it alone."""
    out = df.select(*[F.col(f"`{c}`").alias(label(Col(c, table))) for c in df.columns])
    where = conjunction([predicate(c, scope) for c in conditions])
    return out if where is None else out.where(where)


def joined_order(query: Bound, scans: dict[str, DataFrame]) -> list[str]:
    """The largest scan first, so that the others are what a join builds; then, time and again, the table with the most conditions on those before, the largest of several."""
    if len(scans) < 2:
        return list(scans)
    size = {t: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t, df in scans.items()}
    out = [max(query.tables, key=size.get)]
    while len(out) < len(scans):
        met = {t: sum({t} < {c.left.table, c.right.table} <= {t, *out} for c in query.across) for t in query.tables if t not in out}
        out.append(max(met, key=lambda t: (met[t], size[t])))
    return out


def join_tables(query: Bound, frames: dict[str, DataFrame], scope: Scope) -> DataFrame:
    """Inner joins; a condition applies as soon as both its tables are in, any comparison; none is a cross join."""
    scans = {t: scan(frames[t], t, query.local[t], scope) for t in query.tables}
    out, seen, left = None, set(), list(query.across)
    for table in joined_order(query, scans):
        right = scans[table]
        seen.add(table)
        ready = [c for c in left if {c.left.table, c.right.table} <= seen]
        left = [c for c in left if c not in ready]
        on = conjunction([predicate(c, scope) for c in ready])
        out = right if out is None else out.crossJoin(right) if on is None else out.join(right, on, "inner")
    return out


def names_of(query: Bound) -> list[str]:
    """The result's column names: bare where that is unique, else table.column."""
    names = [c.name for c in query.columns]
    return [c.name if names.count(c.name) == 1 or len({x.table for x in query.columns if x.name == c.name}) == 1 else label(c) for c in query.columns]


def build(query: Bound, frames: dict[str, DataFrame], scope: Scope) -> DataFrame:
    """The query's result."""
    out = join_tables(query, frames, scope)
    if query.order:
        col, desc = query.order
        out = out.orderBy(ref(col).desc() if desc else ref(col).asc())
    return out.select(*[ref(c).alias(n) for c, n in zip(query.columns, names_of(query), strict=True)])


def gather(df: DataFrame, column: str, parts: int) -> DataFrame:
    """A scan dealt into ordered ranges of a column, one task each, read in that order."""
    return df.repartitionByRange(parts, column).sortWithinPartitions(column)
