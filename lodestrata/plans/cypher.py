"""A graph pattern language: MATCH ... [WHERE] [WITH] RETURN ... [ORDER BY] [SKIP] [LIMIT].

Patterns are chains of nodes (v:Label {k: value}) and typed hops -[:T]->,
<-[:T]- or -[:T*lo..hi]->.  They compile to joins of the nodes and edges
frames; aggregates group by the other returned items.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.graph import bfs
from lodestrata.operators.model import DEFAULT_LIMIT, has_label, property_of, visible

_TOKEN = re.compile(
    r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+\.\d+|\d+)|(?P<name>[A-Za-z_]\w*)|(?P<par>\$\w+)|(?P<op><=|>=|<>|->|<-|\.\.|[-\[\](){}:,.*=<>+]))"
)
_AGGREGATES = {"count", "sum", "avg", "min", "max"}
MAX_OPEN_HOPS = 8


@dataclass
class NodePattern:
    name: str
    label: str | None = None
    properties: dict[str, object] = field(default_factory=dict)


@dataclass
class HopPattern:
    kind: str | None
    direction: str
    lo: int = 1
    hi: int = 1


@dataclass
class Item:
    text: str
    name: str
    aggregate: str | None
    binding: str | None
    prop: str | None
    distinct: bool = False


class _Parser:
    def __init__(self, text: str, params: dict[str, object]):
        self.tokens: list[str] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at : at + 20]!r}")
            self.tokens.append(m.group().strip())
            at = m.end()
        self.at, self.params, self.unnamed = 0, params, 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def word(self, *words: str) -> bool:
        """Take these keywords if they come next."""
        if [self.peek(k).upper() for k in range(len(words))] == list(words):
            self.at += len(words)
            return True
        return False

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if expected is not None and token != expected:
            raise ValueError(f"expected {expected!r}, found {token!r}")
        self.at += 1
        return token

    def value(self) -> object:
        token = self.take()
        if token.startswith("$"):
            return self.params[token[1:]]
        if token[0] in "'\"":
            return re.sub(r"\\(.)", r"\1", token[1:-1])
        if token.lower() in ("true", "false"):
            return token.lower() == "true"
        if token == "-":
            return -self.value()
        return float(token) if "." in token else int(token)

    def node(self) -> NodePattern:
        self.take("(")
        name = self.take() if re.match(r"[A-Za-z_]", self.peek()) else None
        if name is None:
            self.unnamed += 1
            name = f"_n{self.unnamed}"
        out = NodePattern(name)
        if self.peek() == ":":
            self.take()
            out.label = self.take()
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                key = self.take()
                self.take(":")
                out.properties[key] = self.value()
                if self.peek() == ",":
                    self.take()
            self.take("}")
        self.take(")")
        return out

    def hop(self) -> HopPattern:
        direction = "in" if self.peek() == "<-" else "out"
        self.take()
        kind, lo, hi = None, 1, 1
        if self.peek() == "[":
            self.take()
            if re.match(r"[A-Za-z_]", self.peek()):
                self.take()
            if self.peek() == ":":
                self.take()
                kind = self.take()
            if self.peek() == "*":
                self.take()
                lo, hi = 1, MAX_OPEN_HOPS
                if self.peek().isdigit():
                    lo = hi = int(self.take())
                if self.peek() == "..":
                    self.take()
                    hi = int(self.take()) if self.peek().isdigit() else MAX_OPEN_HOPS
            self.take("]")
        self.take("-" if direction == "in" else "->")
        return HopPattern(kind, direction, lo, hi)

    def item(self) -> Item:
        start = self.at
        name = self.take()
        aggregate, binding, prop, distinct = None, None, None, False
        if name.lower() in _AGGREGATES and self.peek() == "(":
            aggregate = name.lower()
            self.take("(")
            distinct = self.word("DISTINCT")
            if self.peek() == "*":
                self.take()
            else:
                binding = self.take()
                if self.peek() == ".":
                    self.take()
                    prop = self.take()
            self.take(")")
        else:
            binding = name
            if self.peek() == ".":
                self.take()
                prop = self.take()
        text = "".join(self.tokens[start : self.at])
        alias = self.take() if self.word("AS") else re.sub(r"\W+", "_", text).strip("_")
        return Item(text, alias, aggregate, binding, prop, distinct)

    def items(self) -> list[Item]:
        out = [self.item()]
        while self.peek() == ",":
            self.take()
            out.append(self.item())
        return out


def _candidates(nodes: DataFrame, pattern: NodePattern) -> DataFrame:
    out = nodes if pattern.label is None else nodes.where(has_label(pattern.label))
    for key, value in pattern.properties.items():
        out = out.where((F.col("id") if key == "id" else property_of(key)) == _text(value))
    return out.select(F.col("id").alias(f"{pattern.name}.id"), F.col("properties").alias(f"{pattern.name}.properties"))


def _text(value: object) -> object:
    return str(value).lower() if isinstance(value, bool) else str(value) if not isinstance(value, str) else value


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _read(binding: str, prop: str | None) -> Column:
    if prop is None or prop == "id":
        return _q(f"{binding}.id")
    return F.get_json_object(_q(f"{binding}.properties"), f"$.{prop}")


def _hops(edges: DataFrame, hop: HopPattern, sources: DataFrame) -> DataFrame:
    """(from, to) pairs of a hop; a range of lengths is a breadth-first search with one shortest path per pair."""
    live = edges if hop.kind is None else edges.where(F.col("type") == hop.kind)
    here, there = ("from_id", "to_id") if hop.direction == "out" else ("to_id", "from_id")
    pairs = live.select(F.col(here).alias("src"), F.col(there).alias("dst"))
    if (hop.lo, hop.hi) == (1, 1):
        return pairs
    seen = sources.select(F.col("id").alias("start"), F.col("id")).withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, hop.hi + 1):
        step = frontier.select("start", F.col("id").alias("src")).join(pairs, "src").select("start", F.col("dst").alias("id")).distinct()
        frontier = step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen.where(F.col("depth") >= hop.lo).select(F.col("start").alias("src"), F.col("id").alias("dst"))


def _compare(left: Column, op: str, value: object) -> Column:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        left, right = left.cast("double"), F.lit(float(value))
    else:
        right = F.lit(_text(value))
    return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _aggregate(item: Item) -> Column:
    if item.aggregate == "count":
        if item.binding is None:
            return F.count(F.lit(1))
        value = _read(item.binding, item.prop)
        return F.count_distinct(value) if item.distinct else F.count(value)
    value = _read(item.binding, item.prop)
    number = value.try_cast("double")
    return {"sum": F.sum(number), "avg": F.avg(number), "min": F.min(number), "max": F.max(number)}[item.aggregate]


def _project(df: DataFrame, items: list[Item]) -> DataFrame:
    keys = [_read(i.binding, i.prop).alias(i.name) for i in items if not i.aggregate]
    totals = [_aggregate(i).alias(i.name) for i in items if i.aggregate]
    if not totals:
        return df.select(*keys)
    out = df.groupBy(*keys).agg(*totals) if keys else df.agg(*totals)
    return out.select(*[_q(i.name) for i in items])


def match(p: _Parser, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The bindings of a MATCH clause whose keyword has been read, with its WHERE."""
    first = p.node()
    df = _candidates(nodes, first)
    last = first
    while p.peek() in ("-", "<-"):
        hop = p.hop()
        right = p.node()
        pairs = _hops(edges, hop, df.select(_q(f"{last.name}.id").alias("id")).distinct())
        step = pairs.join(_candidates(nodes, right), F.col("dst") == _q(f"{right.name}.id"))
        df = df.join(step, _q(f"{last.name}.id") == F.col("src")).drop("src", "dst")
        last = right
    if p.word("WHERE"):
        conditions = []
        while True:
            binding = p.take()
            p.take(".")
            prop, op = p.take(), p.take()
            conditions.append(_compare(_read(binding, prop), op, p.value()))
            if not p.word("AND"):
                break
        df = df.where(reduce(Column.__and__, conditions))
    return df


def run(text: str, nodes: DataFrame, edges: DataFrame, params: dict[str, object]) -> DataFrame:
    """Compile a statement that reads; clauses outside the subset raise ValueError."""
    p = _Parser(text, params)
    if not p.word("MATCH"):
        raise ValueError("a statement begins with MATCH")
    df = match(p, visible(nodes), visible(edges))
    renamed: dict[str, str] = {}
    if p.word("WITH"):
        items = p.items()
        df = _project(df, items)
        renamed = {i.name: i.name for i in items}
        if p.word("WHERE"):
            name, op = p.take(), p.take()
            df = df.where(_compare(_q(renamed[name]), op, p.value()))
    if not p.word("RETURN"):
        raise ValueError("RETURN is missing, or a clause is not supported")
    if renamed:
        names = [p.item() for _ in range(1)]
        while p.peek() == ",":
            p.take()
            names.append(p.item())
        df = df.select(*[_q(i.binding).alias(i.name) for i in names])
        items = names
    else:
        items = p.items()
        df = _project(df, items)
    if p.word("ORDER", "BY"):
        order = []
        while True:
            start = p.at
            p.take()
            if p.peek() == ".":
                p.take()
                p.take()
            spelled = "".join(p.tokens[start : p.at])
            name = next((i.name for i in items if i.name == spelled or i.text == spelled), None)
            if name is None:
                raise ValueError(f"ORDER BY names {spelled!r}, which is not returned")
            order.append(_q(name).desc_nulls_last() if p.word("DESC") else _q(name).asc_nulls_first())
            p.word("ASC")
            if p.peek() != ",":
                break
            p.take()
        df = df.orderBy(*order)
    if p.word("SKIP"):
        df = df.offset(int(p.value()))
    limit = int(p.value()) if p.word("LIMIT") else DEFAULT_LIMIT
    if p.at < len(p.tokens):
        raise ValueError(f"unsupported clause at {p.peek()!r}")
    return df if all(i.aggregate for i in items) else df.limit(limit)


__all__ = ["run", "bfs"]
