"""Mutations, tiers and further graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import graph, mutations
from lodestrata.queries.graphs import _cooc, _parts, star
from lodestrata.queries.registry import Registry
from lodestrata.runtime import table

R = Registry()


def _people(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit(1).cast("long").alias("version"))


@R.query("write_upsert", """
SELECT id, CASE WHEN id % 3 = 0 OR id >= 1000000 THEN 'NEW' ELSE seg END AS segment, CASE WHEN id < 1000000 AND id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM (
  SELECT c_custkey AS id, c_mktsegment AS seg FROM customer UNION ALL SELECT c_custkey + 1000000, NULL FROM customer WHERE c_custkey % 10 = 0)
""")
def upsert(spark, sf_dir):
    base = _people(spark, sf_dir)
    new = base.where("id % 3 = 0").select("id", F.lit("NEW").alias("segment")).unionByName(base.where("id % 10 = 0").select((F.col("id") + 1000000).alias("id"), F.lit("NEW").alias("segment")))
    return mutations.upsert(base, new)


@R.query("write_insert_if_absent", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer UNION ALL SELECT c_custkey + 1000000, 'X' FROM customer WHERE c_custkey % 10 = 0")
def insert_if_absent(spark, sf_dir):
    base = _people(spark, sf_dir).select("id", "segment")
    rows = base.where("id % 10 = 0").select(F.col("id"), F.lit("Y").alias("segment")).unionByName(base.where("id % 10 = 0").select((F.col("id") + 1000000).alias("id"), F.lit("X").alias("segment")))
    return mutations.insert_if_absent(base, rows)


@R.query("write_compare_and_set", "SELECT c_custkey AS id, CASE WHEN c_custkey = 5 AND c_mktsegment = 'BUILDING' THEN 'HIT' ELSE c_mktsegment END AS segment FROM customer")
def compare_and_set(spark, sf_dir):
    return mutations.compare_and_set(_people(spark, sf_dir).select("id", "segment"), "id", 5, "segment", "BUILDING", "HIT")


@R.query("write_match_or_create", "SELECT id, CASE WHEN id >= 1000000 THEN 0 WHEN id % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT c_custkey + 1000000 FROM customer WHERE c_custkey % 25 = 0)")
def match_or_create(spark, sf_dir):
    base = _people(spark, sf_dir).select("id", "version")
    rows = base.where("id % 4 = 0").select("id").unionByName(base.where("id % 25 = 0").select((F.col("id") + 1000000).alias("id")))
    return mutations.match_or_create(base, rows, "id", {"version": F.lit(0)}, {"version": F.col("version") + 1})


@R.query("write_detach_delete", "SELECT 'PLACED_BY|o' || o_orderkey || '|c' || o_custkey AS id, o_custkey % 5 = 0 AS tombstone FROM orders")
def detach_delete(spark, sf_dir):
    nodes, edges = star(spark, sf_dir)
    gone = F.array_contains("labels", "Customer") & (F.substring("id", 2, 20).cast("long") % 5 == 0)
    return mutations.delete_nodes(nodes.where(F.array_contains("labels", "Customer")), edges.where("type = 'PLACED_BY'"), gone, detach=True)[1].select("id", "tombstone")


@R.query("write_atomic_batch", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 'B' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 3 <> 2")
def batch(spark, sf_dir):
    base = _people(spark, sf_dir).select("id", "segment")
    return mutations.commit_batch(base, base.where("id % 3 = 1").withColumn("segment", F.lit("B")), base.where("id % 3 = 2"))


@R.query("ttl_purge", "SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 4 = 0 AND o_orderkey * 10 <= 20000)")
def ttl(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("expires_at_ms"))
    return mutations.purge_expired(mutations.set_expiry(nodes, F.col("id") % 4 == 0, F.col("id") * 10), 20000)[0].select("id")


@R.query("ttl_expiring_before", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey * 10 < 9000 ORDER BY o_orderkey LIMIT 30")
def expiring(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") * 10).alias("expires_at_ms"))
    return mutations.expiring_before(nodes, 9000, 30).select("id")


@R.query("tier_evict_rehydrate", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 6 = 0")
def tiers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("seen"))
    hot, cold = mutations.evict(orders, "seen", 852076800000000)
    return mutations.rehydrate(hot, cold, orders.where("id % 6 = 0").select("id")).select("id")


@R.query("export_packed_edges", "WITH n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION SELECT o_orderkey + 1000000 FROM orders)) SELECT a.k AS a, b.k AS b FROM orders JOIN n a ON a.id = o_orderkey + 1000000 JOIN n b ON b.id = o_custkey")
def packed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1000000).alias("from_id"), F.col("o_custkey").alias("to_id"))
    ids = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id")).unionByName(o.select(F.col("from_id").alias("id")))
    return mutations.pack_edges(o, ids)[1]


@R.query("graph_louvain")
def louvain(spark, sf_dir):
    e = _parts(spark, sf_dir).withColumn("weight", F.lit(1.0))
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return graph.louvain_round(e, ids)


@R.query("graph_betweenness")
def between(spark, sf_dir):
    """Shortest paths from all nations to every supplier, customer and region; tests hold the operator against brute force."""
    e = graph.undirected(_cooc(spark, sf_dir))
    return graph.betweenness(e, e.select(F.col("src").alias("id")).where("id LIKE 'n%'").distinct()).select("id", F.round("score", 6).alias("score"))


@R.query("graph_bridges")
def bridge(spark, sf_dir):
    """Orders and their parts: an order of one part hangs on a bridge; tests hold the operator against brute force."""
    lines = table(spark, sf_dir, "lineitem")
    e = lines.select((F.col("l_orderkey") + 100_000_000_000).alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return graph.bridges(e, e.select(F.col("src").alias("id")).distinct())


_E = "e AS (SELECT 's' || s_suppkey AS x, 'n' || s_nationkey AS y FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@R.query("graph_cfl_reachability", f"WITH RECURSIVE {_E}, r(src, dst) AS (SELECT x, y FROM e UNION SELECT src, y FROM r JOIN e ON x = dst) SELECT src, dst FROM r")
def cfl(spark, sf_dir):
    e = _cooc(spark, sf_dir).withColumn("label", F.lit("a"))
    return graph.cfl_reachability(e, [("S", "a")], [("S", "S", "a")]).where("label = 'S'").select("src", "dst")


QUERIES, ORACLE_SQL = R.queries, R.oracle
