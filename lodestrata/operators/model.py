"""The property-graph data model on DataFrames.

nodes: id STRING, labels ARRAY<STRING>, properties STRING (JSON), version
BIGINT, tombstone BOOLEAN, expires_at_ms BIGINT.
edges: id STRING, from_id STRING, to_id STRING, type STRING, properties
STRING, confidence DOUBLE, tombstone BOOLEAN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 100


def visible(df: DataFrame, now_ms: int | None = None, include_expired: bool = False) -> DataFrame:
    """Rows that are neither deleted nor, unless asked for, expired at ``now_ms``."""
    out = df.where(~F.coalesce("tombstone", F.lit(False))) if "tombstone" in df.columns else df
    if not include_expired and now_ms is not None and "expires_at_ms" in df.columns:
        out = out.where(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms))
    return out


def has_label(label: str) -> Column:
    return F.array_contains("labels", label)


def property_of(name: str) -> Column:
    """A JSON property as text; null if it is missing."""
    return F.get_json_object("properties", f"$.{name}")


def query_nodes(
    nodes: DataFrame,
    label: str | None = None,
    equals: dict[str, object] | None = None,
    limit: int | None = DEFAULT_LIMIT,
    now_ms: int | None = None,
    include_expired: bool = False,
) -> DataFrame:
    """Nodes of a label whose properties all have the given values, in order of id."""
    out = visible(nodes, now_ms, include_expired)
    if label is not None:
        out = out.where(has_label(label))
    for name, value in (equals or {}).items():
        text = str(value).lower() if isinstance(value, bool) else str(value)
        out = out.where(property_of(name) == text)
    out = out.orderBy("id")
    return out if limit is None else out.limit(limit)


def lookup(df: DataFrame, key: str, now_ms: int | None = None, include_expired: bool = False) -> DataFrame:
    """The visible record with an id."""
    return visible(df, now_ms, include_expired).where(F.col("id") == key)


def label_postings(nodes: DataFrame) -> DataFrame:
    """(label, id) of every visible node."""
    return visible(nodes).select(F.explode("labels").alias("label"), "id")


def property_postings(nodes: DataFrame) -> DataFrame:
    """(property, value, id) of every scalar property of visible nodes."""
    parsed = visible(nodes).select("id", F.explode(F.from_json("properties", "map<string,string>")).alias("property", "value"))
    return parsed.where("value is not null").select("property", "value", "id")


def confidence() -> Column:
    """An edge's confidence; one without counts as 1."""
    return F.coalesce("confidence", F.lit(1.0))


def relations(nodes: DataFrame, edges: DataFrame, label_columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """One flat relation per lower-cased label with the named properties, and one per lower-cased edge type.

    The labels are given, as a plan cannot depend on the data.
    """
    out = {"nodes": visible(nodes).select("id", "labels", "version"), "edges": visible(edges).select("id", "from_id", "to_id", "type", confidence().alias("confidence"))}
    for label, names in label_columns.items():
        out[label.lower()] = visible(nodes).where(has_label(label)).select("id", *[property_of(n).alias(n) for n in names])
    return out


def edge_relation(edges: DataFrame, kind: str) -> DataFrame:
    return visible(edges).where(F.col("type") == kind).select("id", "from_id", "to_id", confidence().alias("confidence"))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no visible node; the report names the missing ends."""
    ids = visible(nodes).select(F.col("id").alias("node"))
    live = visible(edges)
    left = live.join(ids, live["from_id"] == ids["node"], "left_anti").select("id", F.lit("from").alias("missing"), F.col("from_id").alias("node"))
    right = live.join(ids, live["to_id"] == ids["node"], "left_anti").select("id", F.lit("to").alias("missing"), F.col("to_id").alias("node"))
    return left.unionByName(right)


def content_hash(*names: str) -> Column:
    """A stable digest of the named columns in order of name."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): visible nodes by label and edges by type."""
    labels = label_postings(nodes).groupBy(F.col("label").alias("name")).count().select(F.lit("label").alias("kind"), "name", F.col("count").alias("n"))
    types = visible(edges).groupBy(F.col("type").alias("name")).count().select(F.lit("type").alias("kind"), "name", F.col("count").alias("n"))
    return labels.unionByName(types)


def resolve_identities(rows: DataFrame, keys: list[str], id_column: str) -> tuple[DataFrame, DataFrame]:
    """(winners, problems): the least id of each composite key, and the keys that several ids share."""
    groups = rows.groupBy(*keys).agg(F.min(id_column).alias(id_column), F.count_distinct(id_column).alias("n_ids"))
    return groups.select(*keys, id_column), groups.where("n_ids > 1").select(*keys, "n_ids")


def star_graph(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The star schema as a property graph: one node per row of its entities, one edge per foreign key."""

    def nodes_of(df: DataFrame, label: str, key: str, prefix: str, **properties: Column | str) -> DataFrame:
        json = F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in properties.items()]))
        return df.select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"),
            F.array(F.lit(label)).alias("labels"),
            json.alias("properties"),
            F.lit(1).cast("long").alias("version"),
            F.lit(False).alias("tombstone"),
            F.lit(None).cast("long").alias("expires_at_ms"),
        )

    def edges_of(df: DataFrame, kind: str, left: str, lp: str, right: str, rp: str, trust: Column | None = None) -> DataFrame:
        a, b = F.concat(F.lit(lp), F.col(left).cast("string")), F.concat(F.lit(rp), F.col(right).cast("string"))
        return df.select(
            F.concat_ws("|", F.lit(kind), a, b).alias("id"),
            a.alias("from_id"),
            b.alias("to_id"),
            F.lit(kind).alias("type"),
            (trust if trust is not None else F.lit(None)).cast("double").alias("confidence"),
            F.lit(False).alias("tombstone"),
        )

    t = tables
    nodes = (
        nodes_of(t["region"], "Region", "r_regionkey", "r", name="r_name")
        .unionByName(nodes_of(t["nation"], "Nation", "n_nationkey", "n", name="n_name"))
        .unionByName(nodes_of(t["customer"], "Customer", "c_custkey", "c", name="c_name", segment="c_mktsegment", balance="c_acctbal"))
        .unionByName(nodes_of(t["supplier"], "Supplier", "s_suppkey", "s", name="s_name", balance="s_acctbal"))
        .unionByName(nodes_of(t["part"], "Part", "p_partkey", "p", name="p_name", brand="p_brand", size="p_size"))
        .unionByName(nodes_of(t["orders"], "Order", "o_orderkey", "o", status="o_orderstatus", priority="o_orderpriority"))
    )
    lines = t["lineitem"]
    parts = lines.groupBy("l_orderkey", "l_partkey").agg(F.round(1 - F.min("l_discount"), 4).alias("trust"))
    suppliers = lines.groupBy("l_orderkey", "l_suppkey").agg(F.round(1 - F.min("l_discount"), 4).alias("trust"))
    edges = (
        edges_of(t["nation"], "IN_REGION", "n_nationkey", "n", "n_regionkey", "r")
        .unionByName(edges_of(t["customer"], "IN_NATION", "c_custkey", "c", "c_nationkey", "n"))
        .unionByName(edges_of(t["supplier"], "IN_NATION", "s_suppkey", "s", "s_nationkey", "n"))
        .unionByName(edges_of(t["orders"], "PLACED_BY", "o_orderkey", "o", "o_custkey", "c"))
        .unionByName(edges_of(parts, "CONTAINS", "l_orderkey", "o", "l_partkey", "p", F.col("trust")))
        .unionByName(edges_of(suppliers, "SUPPLIED_BY", "l_orderkey", "o", "l_suppkey", "s", F.col("trust")))
    )
    return nodes, edges
