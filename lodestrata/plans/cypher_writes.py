"""Statements of the pattern language that write: CREATE, MERGE, and MATCH with SET, DELETE or CREATE.

Each gives the new nodes and edges.  A node that is created without an id is
named by the digest of its label and properties; an edge by its type and ends.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.model import visible
from lodestrata.plans.cypher import NodePattern, _candidates, _Parser, _q, _text, match


def _node_id(pattern: NodePattern) -> str:
    if "id" in pattern.properties:
        return str(pattern.properties["id"])
    told = json.dumps([pattern.label, pattern.properties], sort_keys=True, ensure_ascii=False)
    return f"{pattern.label or 'node'}:{hashlib.sha256(told.encode()).hexdigest()[:16]}"


def _rows(base: DataFrame, rows: list[dict[str, object]]) -> DataFrame:
    return base.sparkSession.createDataFrame([tuple(r.get(c) for c in base.columns) for r in rows], base.schema)


def _new_node(pattern: NodePattern) -> dict[str, object]:
    properties = {k: v for k, v in pattern.properties.items() if k != "id"}
    return {
        "id": _node_id(pattern),
        "labels": [pattern.label] if pattern.label else [],
        "properties": json.dumps(properties, ensure_ascii=False),
        "version": 1,
        "tombstone": False,
    }


def _new_edge(kind: str, a: str, b: str) -> dict[str, object]:
    return {"id": f"{kind}|{a}|{b}", "from_id": a, "to_id": b, "type": kind, "tombstone": False}


def _with_properties(values: dict[str, object]) -> Column:
    """The properties with some of them set."""
    old = F.coalesce(F.from_json("properties", "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~k.isin(list(values)))
    return F.to_json(F.map_concat(kept, F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, str(_text(v)))])))


def _assignments(p: _Parser, name: str | None = None) -> tuple[str, dict[str, object]]:
    """(binding, values) of v.k = value, ...; one binding is set at a time."""
    out: dict[str, object] = {}
    while True:
        binding = p.take()
        if name is not None and binding != name:
            raise ValueError(f"SET names {binding!r}, not {name!r}")
        name = binding
        p.take(".")
        key = p.take()
        if key == "id":
            raise ValueError("an id does not change")
        p.take("=")
        out[key] = p.value()
        if p.peek() != ",":
            return name, out
        p.take()


def _set(nodes: DataFrame, ids: DataFrame, values: dict[str, object]) -> DataFrame:
    """Nodes with values set where ids (id) names them, their versions grown."""
    marked = nodes.join(ids.select(F.col("id").alias("_hit")).distinct(), F.col("id") == F.col("_hit"), "left")
    hit = F.col("_hit").isNotNull()
    changed = marked.withColumn("properties", F.when(hit, _with_properties(values)).otherwise(F.col("properties")))
    return changed.withColumn("version", F.when(hit, F.col("version") + 1).otherwise(F.col("version"))).select(*nodes.columns)


def _delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame, detach: bool) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    live = visible(edges)
    first = live.join(gone, F.col("from_id") == F.col("_gone"), "left_semi").select("id")
    touched = first.unionByName(live.join(gone, F.col("to_id") == F.col("_gone"), "left_semi").select("id")).distinct()
    if not detach and not touched.isEmpty():
        raise ValueError("a node with edges is deleted with DETACH DELETE")
    dead = nodes.join(gone, F.col("id") == F.col("_gone"), "left")
    out = dead.withColumn("tombstone", F.coalesce("tombstone", F.lit(False)) | F.col("_gone").isNotNull()).select(*nodes.columns)
    cut = edges.join(touched.select(F.col("id").alias("_cut")), F.col("id") == F.col("_cut"), "left")
    return out, cut.withColumn("tombstone", F.coalesce("tombstone", F.lit(False)) | F.col("_cut").isNotNull()).select(*edges.columns)


def _create(p: _Parser, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of new nodes and edges; a name that comes again stands for the same node."""
    made: dict[str, NodePattern] = {}
    links: list[dict[str, object]] = []
    while True:
        left = p.node()
        left = made.setdefault(left.name, left)
        while p.peek() in ("-", "<-"):
            hop = p.hop()
            if hop.kind is None or (hop.lo, hop.hi) != (1, 1):
                raise ValueError("an edge is created with one type and one hop")
            right = p.node()
            right = made.setdefault(right.name, right)
            a, b = (left, right) if hop.direction == "out" else (right, left)
            links.append(_new_edge(hop.kind, _node_id(a), _node_id(b)))
            left = right
        if p.peek() != ",":
            break
        p.take()
    new = _rows(nodes, [_new_node(n) for n in made.values()])
    clash = new.join(visible(nodes).select("id"), "id", "left_semi").limit(1)
    if not clash.isEmpty():
        raise ValueError("a node of that id is there already")
    return nodes.unionByName(new), edges.unionByName(_rows(edges, links)) if links else edges


def _merge(p: _Parser, nodes: DataFrame) -> DataFrame:
    pattern = p.node()
    on: dict[str, dict[str, object]] = {"CREATE": {}, "MATCH": {}}
    while p.word("ON"):
        when = p.take().upper()
        if when not in on or not p.word("SET"):
            raise ValueError("MERGE takes ON CREATE SET and ON MATCH SET")
        on[when] |= _assignments(p, pattern.name)[1]
    found = _candidates(visible(nodes), pattern).select(_q(f"{pattern.name}.id").alias("id"))
    if found.limit(1).isEmpty():
        pattern.properties |= on["CREATE"]
        return nodes.unionByName(_rows(nodes, [_new_node(pattern)]))
    return _set(nodes, found, on["MATCH"]) if on["MATCH"] else nodes


def execute(text: str, nodes: DataFrame, edges: DataFrame, params: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges after a statement that writes; clauses outside the subset raise ValueError."""
    p = _Parser(text, params)
    if p.word("CREATE"):
        nodes, edges = _create(p, nodes, edges)
    elif p.word("MERGE"):
        nodes = _merge(p, nodes)
    elif p.word("MATCH"):
        found = match(p, visible(nodes), visible(edges))
        if p.word("SET"):
            name, values = _assignments(p)
            nodes = _set(nodes, found.select(_q(f"{name}.id").alias("id")), values)
        elif p.word("DETACH", "DELETE") or p.word("DELETE"):
            detach = p.tokens[p.at - 2].upper() == "DETACH"
            nodes, edges = _delete(nodes, edges, found.select(_q(f"{p.take()}.id").alias("id")), detach)
        elif p.word("CREATE"):
            left, hop, right = p.node(), p.hop(), p.node()
            if hop.kind is None:
                raise ValueError("an edge is created with a type")
            a, b = (left, right) if hop.direction == "out" else (right, left)
            pairs = found.select(_q(f"{a.name}.id").alias("from_id"), _q(f"{b.name}.id").alias("to_id")).distinct()
            new = pairs.select(F.concat_ws("|", F.lit(hop.kind), "from_id", "to_id").alias("id"), "from_id", "to_id", F.lit(hop.kind).alias("type"), F.lit(False).alias("tombstone"))
            new = new.join(visible(edges).select("id"), "id", "left_anti")
            edges = edges.unionByName(new, allowMissingColumns=True)
        else:
            raise ValueError("MATCH is followed by SET, DELETE, DETACH DELETE or CREATE")
    else:
        raise ValueError("a statement that writes begins with CREATE, MERGE or MATCH")
    if p.at < len(p.tokens):
        raise ValueError(f"unsupported clause at {p.peek()!r}")
    return nodes, edges
