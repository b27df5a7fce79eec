"""A typed relational query IR that compiles to one DataFrame plan.

A query names relations by alias, filters them by predicates, joins them by
equalities, ranks rows and projects columns.  All predicates are conjunctive.
Catalyst picks join order, join methods and pushed-down filters.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Equals:
    alias: str
    column: str
    value: object


@dataclass(frozen=True)
class Range:
    """Numeric bounds; None is open."""

    alias: str
    column: str
    lo: float | None = None
    hi: float | None = None
    lo_inclusive: bool = True
    hi_inclusive: bool = True


@dataclass(frozen=True)
class Prefix:
    alias: str
    column: str
    prefix: str


@dataclass(frozen=True)
class TimeRange:
    """Epoch milliseconds or timestamps, both ends inclusive."""

    alias: str
    column: str
    lo_ms: int
    hi_ms: int


@dataclass(frozen=True)
class GeoWithin:
    alias: str
    min_lat: float
    min_lon: float
    max_lat: float
    max_lon: float
    lat: str = "lat"
    lon: str = "lon"


@dataclass(frozen=True)
class TextMatch:
    """Every word of the query is a word of the column."""

    alias: str
    column: str
    query: str


@dataclass(frozen=True)
class Expand:
    """The row is one typed hop from a node."""

    alias: str
    column: str
    start: str
    edge_type: str | None = None


@dataclass(frozen=True)
class Join:
    left: str
    left_column: str
    right: str
    right_column: str


Predicate = Equals | Range | Prefix | TimeRange | GeoWithin | TextMatch | Expand


@dataclass(frozen=True)
class QueryIr:
    """``relations``: alias to relation name; ``projection``: (alias, column) pairs, empty for all."""

    relations: Mapping[str, str]
    predicates: tuple[Predicate, ...] = ()
    joins: tuple[Join, ...] = ()
    projection: tuple[tuple[str, str], ...] = ()
    score: Column | None = None
    limit: int | None = None
    offset: int = 0
    order_by: tuple[str, ...] = field(default=("score", "id"))


def same_type_equals(column: Column, dtype: str, value: object) -> Column:
    """Type-strict equality: a value of another type never matches."""
    kinds = {bool: ("boolean",), int: ("bigint", "int", "smallint", "tinyint"), float: ("double", "float"), str: ("string",)}
    return column == F.lit(value) if dtype in kinds.get(type(value), ()) else F.lit(False)


def millis(column: Column, dtype: str) -> Column:
    return F.unix_millis(column.cast("timestamp")) if dtype.startswith(("timestamp", "date")) else column.cast("bigint")


def condition(p: Predicate, df: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``df`` filtered by one predicate on its own columns."""
    types = dict(df.dtypes)
    if isinstance(p, Equals):
        return df.where(same_type_equals(F.col(p.column), types[p.column], p.value))
    if isinstance(p, Range):
        if types[p.column] in ("string", "boolean"):
            return df.where(F.lit(False))
        out = df.where(F.col(p.column).isNotNull())
        if p.lo is not None:
            out = out.where(F.col(p.column) >= p.lo if p.lo_inclusive else F.col(p.column) > p.lo)
        if p.hi is not None:
            out = out.where(F.col(p.column) <= p.hi if p.hi_inclusive else F.col(p.column) < p.hi)
        return out
    if isinstance(p, Prefix):
        return df.where(F.col(p.column).startswith(p.prefix))
    if isinstance(p, TimeRange):
        if types[p.column].startswith("timestamp"):  # plain comparison with literals reaches the scan
            lo, hi = (F.timestamp_millis(F.lit(v)).cast(types[p.column]) for v in (p.lo_ms, p.hi_ms))
            return df.where((F.col(p.column) >= lo) & (F.col(p.column) <= hi))
        return df.where(F.col(p.column).between(p.lo_ms, p.hi_ms))
    if isinstance(p, GeoWithin):
        return df.where(F.col(p.lat).between(p.min_lat, p.max_lat) & F.col(p.lon).between(p.min_lon, p.max_lon))
    if isinstance(p, TextMatch):
        from lodestrata.operators.text import filter_tokens, words_of

        return df.where(reduce(Column.__and__, [F.array_contains(words_of(F.col(p.column)), w) for w in filter_tokens(p.query)], F.lit(True)))
    if isinstance(p, Expand):
        if edges is None:
            raise ValueError("Expand needs the edges of a graph")
        hop = edges.where(F.col("from_id") == p.start)
        hop = hop if p.edge_type is None else hop.where(F.col("type") == p.edge_type)
        return df.join(hop.select(F.col("to_id").alias(p.column)).distinct(), p.column, "left_semi")
    raise TypeError(f"unknown predicate {p!r}")


def compile_query(ir: QueryIr, catalog: Mapping[str, DataFrame], edges: DataFrame | None = None) -> DataFrame:
    """The plan of a query; columns are named alias_column, and rows are ordered by score, then id."""
    if len(ir.relations) > 1 and len(ir.joins) < len(ir.relations) - 1:
        raise ValueError("every relation must be joined to another")
    parts: dict[str, DataFrame] = {}
    for alias, name in ir.relations.items():
        df = catalog[name]
        for p in ir.predicates:
            if p.alias == alias:
                df = condition(p, df, edges)
        parts[alias] = df.select([F.col(c).alias(f"{alias}_{c}") for c in df.columns])
    order = list(ir.relations)
    placed, out = {order[0]}, parts[order[0]]
    waiting = list(ir.joins)
    while waiting:
        ready = next((j for j in waiting if j.left in placed or j.right in placed), None)
        if ready is None:
            raise ValueError("a join names relations that nothing connects")
        waiting.remove(ready)
        left, right = F.col(f"{ready.left}_{ready.left_column}"), F.col(f"{ready.right}_{ready.right_column}")
        if {ready.left, ready.right} <= placed:
            out = out.where(left == right)
            continue
        new = ready.right if ready.left in placed else ready.left
        types = dict(out.dtypes) | dict(parts[new].dtypes)
        if types[f"{ready.left}_{ready.left_column}"] != types[f"{ready.right}_{ready.right_column}"]:
            left, right = left.cast("string"), right.cast("string")  # keys of different types compare as text
        out = out.join(parts[new], left == right)
        placed.add(new)
    if ir.score is not None:
        out = out.withColumn("score", ir.score)
    if ir.projection:
        extra = ["score"] if ir.score is not None else []
        chosen = [f"{a}_{c}" for a, c in ir.projection]
        out = out.select(*chosen, *extra)
    if ir.score is not None:
        ids = [c for c in out.columns if c.endswith("_id")]
        out = out.orderBy(F.col("score").desc(), *ids)
    if ir.offset:
        out = out.offset(ir.offset)
    return out if ir.limit is None else out.limit(ir.limit)
