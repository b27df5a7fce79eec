"""Typed object queries and nested selections, both compiled to DataFrame plans."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.plans.ir import Join, QueryIr, compile_query


@dataclass(frozen=True)
class Test:
    """eq, not_eq, contains (substring or member), exists; ``field`` names a column."""

    field: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Both:
    """Boolean combination: op is and, or or not."""

    op: str
    parts: tuple[object, ...]


@dataclass(frozen=True)
class ObjectQuery:
    relation: str
    where: object | None = None
    sort: tuple[tuple[str, bool], ...] = ()  # (field, ascending); missing values last when ascending
    cursor: int = 0
    size: int = 100
    fields: tuple[str, ...] = field(default=())


def condition(test: object, types: Mapping[str, str]) -> Column:
    if isinstance(test, Both):
        parts = [condition(t, types) for t in test.parts]
        if test.op == "not":
            return ~parts[0]
        return reduce(Column.__and__ if test.op == "and" else Column.__or__, parts)
    c = F.col(test.field)
    if test.op == "exists":
        return c.isNotNull()
    if test.op == "eq":
        return c.eqNullSafe(F.lit(test.value))
    if test.op == "not_eq":
        return ~c.eqNullSafe(F.lit(test.value))
    if test.op == "contains":
        held = F.array_contains(c, test.value) if types[test.field].startswith("array") else F.contains(c, F.lit(test.value))
        return F.coalesce(held, F.lit(False))
    raise ValueError(f"unknown test {test.op!r}")


def run_objects(query: ObjectQuery, catalog: Mapping[str, DataFrame]) -> DataFrame:
    df = catalog[query.relation]
    if query.where is not None:
        df = df.where(condition(query.where, dict(df.dtypes)))
    if query.sort:
        df = df.orderBy(*[F.col(f).asc_nulls_last() if up else F.col(f).desc_nulls_first() for f, up in query.sort])
    df = df.select(*query.fields) if query.fields else df
    return df.offset(query.cursor).limit(query.size) if query.cursor else df.limit(query.size)


def selection(root: str, fields: Mapping[str, object], keys: Mapping[str, tuple[str, str]], catalog: Mapping[str, DataFrame]) -> DataFrame:
    """A nested selection: scalar fields of the root, and relations with fields of their own.

    ``fields``: name to None for a scalar, or to a list of the nested relation's
    columns; ``keys``: nested relation to (root column, nested column).
    """
    nested = {n: f for n, f in fields.items() if f is not None}
    joins = tuple(Join("root", keys[n][0], n, keys[n][1]) for n in nested)
    projection = tuple(("root", n) for n, f in fields.items() if f is None) + tuple((n, c) for n, f in nested.items() for c in f)
    return compile_query(QueryIr({"root": root} | {n: n for n in nested}, (), joins, projection), catalog)
