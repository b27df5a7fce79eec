"""Graph, pattern and rule queries over the star schema as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import graph, model, rules
from lodestrata.operators.packs import pairs_within
from lodestrata.plans.engine import Engine
from lodestrata.queries.registry import Registry
from lodestrata.runtime import table

R = Registry()
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def star(spark, sf_dir):
    return model.star_graph({n: table(spark, sf_dir, n) for n in _TABLES})


def engine(spark, sf_dir) -> Engine:
    nodes, edges = star(spark, sf_dir)
    return Engine(spark, nodes=nodes, edges=edges)


@R.query("graph_node_scan", "SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY id LIMIT 100")
def node_scan(spark, sf_dir):
    return engine(spark, sf_dir).query({"kind": "node_match", "label": "Customer", "properties": {"segment": "BUILDING"}}).select("id")


@R.query("graph_point_lookup", "SELECT 'n3' AS id, n_name AS name FROM nation WHERE n_nationkey = 3")
def point_lookup(spark, sf_dir):
    return model.lookup(star(spark, sf_dir)[0], "n3").select("id", model.property_of("name").alias("name"))


@R.query("graph_label_postings", "SELECT 'Nation' AS label, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders")
def label_postings(spark, sf_dir):
    return model.label_postings(star(spark, sf_dir)[0]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@R.query("graph_property_postings", "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1")
def property_postings(spark, sf_dir):
    return model.property_postings(star(spark, sf_dir)[0]).where("property = 'segment'").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@R.query("graph_stats", """
SELECT 'label' AS kind, 'Nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'label', 'Region', count(*) FROM region
UNION ALL SELECT 'label', 'Customer', count(*) FROM customer UNION ALL SELECT 'label', 'Supplier', count(*) FROM supplier
UNION ALL SELECT 'label', 'Part', count(*) FROM part UNION ALL SELECT 'label', 'Order', count(*) FROM orders
UNION ALL SELECT 'type', 'IN_REGION', count(*) FROM nation
UNION ALL SELECT 'type', 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
UNION ALL SELECT 'type', 'PLACED_BY', count(*) FROM orders
UNION ALL SELECT 'type', 'CONTAINS', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
UNION ALL SELECT 'type', 'SUPPLIED_BY', count(*) FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
""")
def stats(spark, sf_dir):
    return model.graph_stats(*star(spark, sf_dir))


@R.query("graph_dangling_edges", """
SELECT DISTINCT 'CONTAINS|o' || l_orderkey || '|p' || l_partkey AS id, 'to' AS missing FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 40 WHERE p_partkey IS NULL
""")
def dangling(spark, sf_dir):
    nodes, edges = star(spark, sf_dir)
    fewer = nodes.where(~model.has_label("Part") | (model.property_of("size").cast("int") < 40))
    return model.dangling_edges(fewer, edges.where("type = 'CONTAINS'")).select("id", "missing").distinct()


@R.query("graph_identity_problems", "SELECT c_mktsegment, c_nationkey, count(DISTINCT c_custkey) AS n_ids FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_custkey) > 1")
def identity_problems(spark, sf_dir):
    return model.resolve_identities(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey")[1]


@R.query("graph_neighbors", "SELECT 'PLACED_BY|o' || o_orderkey || '|c' || o_custkey AS edge_id, 'o' || o_orderkey AS neighbor FROM orders WHERE o_custkey = 7")
def neighbors(spark, sf_dir):
    return graph.neighbors(star(spark, sf_dir)[1], "c7", "in", "PLACED_BY")


@R.query("graph_chain", """
SELECT DISTINCT 'c' || c_custkey AS start, 'p' || l_partkey AS end FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
""")
def chain(spark, sf_dir):
    nodes, edges = star(spark, sf_dir)
    return graph.chain(edges, nodes.where(model.has_label("Customer")), [("PLACED_BY", "in"), ("CONTAINS", "out")])


@R.query("cypher_filter_order", "SELECT c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY 1 DESC LIMIT 5 OFFSET 2")
def cypher_filter(spark, sf_dir):
    return engine(spark, sf_dir).cypher("MATCH (c:Customer {segment: 'BUILDING'}) RETURN c.name AS name, c.segment AS segment ORDER BY c.name DESC SKIP 2 LIMIT 5")


@R.query("cypher_edge_aggregate", "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def cypher_aggregate(spark, sf_dir):
    return engine(spark, sf_dir).cypher("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, count(*) AS customers ORDER BY nation LIMIT 1000")


@R.query("cypher_two_hops", "SELECT r_name AS region, count(DISTINCT s_suppkey) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def cypher_two_hops(spark, sf_dir):
    return engine(spark, sf_dir).cypher("MATCH (s:Supplier)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(DISTINCT s.id) AS suppliers")


@R.query("cypher_incoming_where", "SELECT 'o' || o_orderkey AS o FROM orders WHERE o_custkey = 11 AND o_orderstatus = 'F'")
def cypher_incoming(spark, sf_dir):
    return engine(spark, sf_dir).cypher("MATCH (c:Customer {id: 'c11'})<-[:PLACED_BY]-(o:Order) WHERE o.status = $s RETURN o.id AS o LIMIT 1000", {"s": "F"})


@R.query("cypher_with_filter", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1 HAVING count(*) > 5")
def cypher_with(spark, sf_dir):
    return engine(spark, sf_dir).cypher("MATCH (c:Customer) WHERE c.balance >= 0 WITH c.segment AS segment, count(*) AS n WHERE n > 5 RETURN segment, n")


@R.query("cypher_variable_length", """
SELECT 'n' || n_nationkey AS target FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 5)
UNION SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 5)
""")
def cypher_variable(spark, sf_dir):
    return engine(spark, sf_dir).cypher("MATCH (c:Customer {id: 'c5'})-[*1..3]->(x) RETURN x.id AS target")


def _cooc(spark, sf_dir) -> DataFrame:
    """Supplier - nation - region - customer edges, a small graph of numbers."""
    _, edges = star(spark, sf_dir)
    return edges.where("type IN ('IN_NATION', 'IN_REGION')").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))


def _bipartite(spark, sf_dir) -> DataFrame:
    """Customers and the suppliers of their orders, as undirected pairs of numbers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 100_000_000).alias("dst")).distinct()


_BI = "bi AS (SELECT DISTINCT o_custkey AS src, l_suppkey + 100000000 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey), both_ways AS (SELECT src, dst FROM bi UNION SELECT dst, src FROM bi)"


@R.query("graph_bfs_depths", f"""
WITH RECURSIVE {_BI}, r(id, depth) AS (
  SELECT CAST(min(src) AS BIGINT), 0 FROM bi UNION SELECT dst, depth + 1 FROM r JOIN both_ways ON src = id WHERE depth < 4)
SELECT id, min(depth) AS depth FROM r GROUP BY id
""")
def bfs_depths(spark, sf_dir):
    both = graph.undirected(_bipartite(spark, sf_dir))
    return graph.bfs(both, _bipartite(spark, sf_dir).agg(F.min("src").alias("id")), 4)


@R.query("graph_components", f"""
WITH RECURSIVE {_BI}, r(id, root) AS (SELECT src, src FROM both_ways UNION SELECT dst, root FROM r JOIN both_ways ON src = id)
SELECT id, min(root) AS component FROM r GROUP BY id
""")
def connected(spark, sf_dir):
    e = _bipartite(spark, sf_dir)
    return graph.components(e, e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct())


def _ranks_sql(rounds: int) -> str:
    ctes = ["e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)",
            "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)", "deg AS (SELECT src, count(*) AS d FROM e GROUP BY 1)", "k AS (SELECT count(*) AS n FROM v)", "r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM v, k)"]
    for i in range(rounds):
        ctes.append(f"d{i} AS (SELECT coalesce(sum(rank), 0) AS dm FROM r{i} WHERE id NOT IN (SELECT src FROM deg))")
        ctes.append(f"m{i} AS (SELECT e.dst AS id, sum(rank / d) AS mass FROM e JOIN deg ON deg.src = e.src JOIN r{i} ON r{i}.id = e.src GROUP BY 1)")
        ctes.append(f"r{i + 1} AS (SELECT v.id, 0.15 / n + 0.85 * dm / n + 0.85 * coalesce(mass, 0) AS rank FROM v CROSS JOIN k CROSS JOIN d{i} LEFT JOIN m{i} ON m{i}.id = v.id)")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT id, round(rank, 9) AS rank FROM r{rounds}"


@R.query("graph_pagerank", _ranks_sql(3))
def pagerank(spark, sf_dir):
    e = _cooc(spark, sf_dir)
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return graph.pagerank(e, nodes, 3).select("id", F.round("rank", 9).alias("rank"))


@R.query("graph_personalized_pagerank")
def ppr(spark, sf_dir):
    """Forward push from one node; tests hold it against the power iteration within the tolerance."""
    both = graph.undirected(_bipartite(spark, sf_dir)).withColumn("weight", F.lit(1.0))
    seeds = _bipartite(spark, sf_dir).agg(F.min("src").alias("id")).withColumn("weight", F.lit(1.0))
    return graph.personalized_pagerank(both, seeds, epsilon=1e-3).select("id", F.round("score", 6).alias("score"))


def _lpa_sql(rounds: int) -> str:
    ctes = [_BI, "l0 AS (SELECT DISTINCT src AS id, src AS label FROM both_ways)"]
    for i in range(rounds):
        ctes.append(f"c{i} AS (SELECT src AS id, label, count(*) AS n FROM both_ways JOIN l{i} ON l{i}.id = dst GROUP BY 1, 2)")
        ctes.append(f"l{i + 1} AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS k FROM c{i}) WHERE k = 1)")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT id, label FROM l{rounds}"


@R.query("graph_label_propagation", _lpa_sql(3))
def lpa(spark, sf_dir):
    e = _bipartite(spark, sf_dir)
    return graph.label_propagation(e, e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct(), 3)


_CO = "co AS (SELECT DISTINCT a.l_partkey AS x, b.l_partkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"


def _pairs(spark, sf_dir) -> DataFrame:
    """Pairs of parts that one order holds, once for each order."""
    return pairs_within(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def _parts(spark, sf_dir) -> DataFrame:
    """Pairs of parts that one order holds."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return lines.join(other, "l_orderkey").where("l_partkey < dst").select(F.col("l_partkey").alias("src"), "dst").distinct()


@R.query("graph_triangles", f"WITH {_CO} SELECT a.x AS a, a.y AS b, b.y AS c FROM co a JOIN co b ON a.y = b.x JOIN co d ON d.x = a.x AND d.y = b.y")
def triangles(spark, sf_dir):
    return graph.triangles(_pairs(spark, sf_dir))


@R.query("graph_walk_counts", f"WITH {_CO} SELECT c.y AS id, CAST(count(*) AS BIGINT) AS walks FROM co a JOIN co b ON a.y = b.x JOIN co c ON b.y = c.x GROUP BY 1")
def walks(spark, sf_dir):
    e = _parts(spark, sf_dir)
    return graph.walk_counts(e, e.select(F.col("src").alias("id")).distinct(), 3).select("id", F.col("walks").cast("long").alias("walks"))


@R.query("graph_k_truss")
def truss(spark, sf_dir):
    return graph.k_truss(_pairs(spark, sf_dir), 4)


@R.query("graph_strong_components")
def scc(spark, sf_dir):
    """Order follow-ups that lead back: conversations' turns as a directed graph of roles and ids."""
    e = _parts(spark, sf_dir)
    directed = e.unionByName(e.where("(src + dst) % 3 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return graph.strongly_connected(directed, e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct())


@R.query("graph_structural_knn", f"""
WITH {_CO}, s AS (SELECT x, y FROM co UNION SELECT y, x FROM co), d AS (SELECT x AS id, count(*) AS d FROM s GROUP BY 1),
n AS (SELECT a.y AS u, b.y AS v, count(*) AS n FROM s a JOIN s b ON a.x = b.x AND a.y <> b.y GROUP BY 1, 2)
SELECT u, v, round(score, 9) AS score, rank FROM (SELECT u, v, n / sqrt(du.d::DOUBLE * dv.d) AS score,
  row_number() OVER (PARTITION BY u ORDER BY n / sqrt(du.d::DOUBLE * dv.d) DESC, v) AS rank
  FROM n JOIN d du ON du.id = u JOIN d dv ON dv.id = v) WHERE rank <= 3
""")
def structural(spark, sf_dir):
    return graph.structural_knn(_pairs(spark, sf_dir), 3).select("u", "v", F.round("score", 9).alias("score"), "rank")


@R.query("graph_weighted_paths", f"""
WITH RECURSIVE {_CO}, s AS (SELECT x, y, 1 + (x + y) % 5 AS w FROM co UNION SELECT y, x, 1 + (x + y) % 5 FROM co),
r(id, cost, hops) AS (SELECT CAST(min(x) AS BIGINT), 0, 0 FROM s UNION SELECT y, cost + w, hops + 1 FROM r JOIN s ON x = id WHERE hops < 6 AND cost + w <= 8)
SELECT id, CAST(min(cost) AS DOUBLE) AS cost FROM r GROUP BY id HAVING min(cost) <= 6
""")
def weighted(spark, sf_dir):
    e = _parts(spark, sf_dir).withColumn("weight", (1 + (F.col("src") + F.col("dst")) % 5).cast("double"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    first = e.agg(F.min("src")).first()[0]
    return graph.shortest_path_costs(both, first).where("cost <= 6")


@R.query("graph_induced_subgraph", f"WITH {_CO} SELECT x AS src, y AS dst FROM co WHERE x % 2 = 0 AND y % 2 = 0")
def induced(spark, sf_dir):
    e = _parts(spark, sf_dir)
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).where("id % 2 = 0").distinct()
    return graph.induced(e, ids).select("src", "dst")


# Rules: orders are claims, suppliers their sources, lines dependencies, customers objects.


def _claims(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "refuted").otherwise("open").alias("status"))


def _supports(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("claim"), F.col("l_suppkey").alias("source"))


def _depends(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("on"))


@R.query("rule_unsupported_claim", "SELECT 'unsupported_claim' AS rule, CAST(o_orderkey AS VARCHAR) AS subject, 1.0::DOUBLE AS confidence FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('N', 'R'))")
def unsupported(spark, sf_dir):
    return rules.unsupported_claims(_claims(spark, sf_dir), _supports(spark, sf_dir), _depends(spark, sf_dir))


@R.query("rule_dependent_claim", "SELECT 'dependent_claim' AS rule, CAST(l_orderkey AS VARCHAR) AS subject, 1.0::DOUBLE AS confidence FROM lineitem WHERE l_returnflag = 'R'")
def dependent(spark, sf_dir):
    return rules.dependent_claims(_depends(spark, sf_dir))


@R.query("rule_reused_source", "SELECT 'source_reused_support' AS rule, CAST(l_suppkey AS VARCHAR) AS subject, 0.8::DOUBLE AS confidence FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) >= 2")
def reused(spark, sf_dir):
    return rules.reused_sources(_supports(spark, sf_dir))


@R.query("rule_duplicate_entity", "SELECT 'likely_duplicate_entity' AS rule, lower(p_brand) AS subject, 0.7::DOUBLE AS confidence FROM part GROUP BY lower(p_brand) HAVING count(DISTINCT p_partkey) >= 2")
def duplicates(spark, sf_dir):
    return rules.duplicate_entities(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.upper("p_brand"), F.lit("  ")).alias("title")))


@R.query("rule_long_path", "SELECT 'evidence_path_too_long' AS rule, CAST(l_orderkey AS VARCHAR) AS subject, 0.9::DOUBLE AS confidence FROM lineitem GROUP BY l_orderkey HAVING count(*) > 3")
def long_path(spark, sf_dir):
    return rules.long_paths(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("path_length")))


@R.query("rule_no_independent_support", "SELECT 'claim_has_no_independent_support' AS rule, CAST(o_orderkey AS VARCHAR) AS subject, 0.85::DOUBLE AS confidence FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'N' GROUP BY o_orderkey HAVING count(DISTINCT l_suppkey) < 2")
def no_independent(spark, sf_dir):
    return rules.dependent_on_few_sources(_supports(spark, sf_dir), _claims(spark, sf_dir))


@R.query("rule_tension", "SELECT 'object_in_unresolved_tension_neighborhood' AS rule, CAST(id AS VARCHAR) AS subject, 0.8::DOUBLE AS confidence FROM (SELECT l_partkey AS id FROM lineitem WHERE l_linestatus = 'O' UNION SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O')")
def tension(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("right"), F.when(F.col("l_linestatus") == "O", "contested").otherwise("settled").alias("state"))
    return rules.in_tension(t)


@R.query("rule_flagged_facts", "SELECT 'context_atom_tainted_by_generated_artifact' AS rule, CAST(event_id AS VARCHAR) AS subject, 0.9::DOUBLE AS confidence FROM events WHERE value > 90")
def flagged(spark, sf_dir):
    return rules.flagged(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") > 90).alias("generated")), "context_atom_tainted_by_generated_artifact", "generated", 0.9)


@R.query("rule_failing_pattern", "SELECT 'code_symbol_touched_by_failing_postmortem_pattern' AS rule, CAST(p_partkey AS VARCHAR) AS subject, 0.85::DOUBLE AS confidence FROM part WHERE p_size > 45")
def failing(spark, sf_dir):
    return rules.flagged(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") > 45).alias("failing")), "code_symbol_touched_by_failing_postmortem_pattern", "failing", 0.85)


@R.query("rule_private_export", "SELECT DISTINCT 'private_source_reaches_export_candidate' AS rule, CAST(l_orderkey AS VARCHAR) AS subject, 0.95::DOUBLE AS confidence FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'N' AND s_acctbal < 0 AND s_nationkey % 2 = 0")
def private_export(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") < 0).alias("private"), (F.col("s_nationkey") % 2 == 0).alias("exportable"))
    return rules.private_exports(s, _supports(spark, sf_dir))


@R.query("rule_grounded_status", f"""
WITH {_CO}, a AS (SELECT x AS src, y AS dst FROM co WHERE (x + y) % 2 = 0 UNION SELECT y, x FROM co WHERE (x + y) % 4 = 0),
n AS (SELECT dst AS id, count(*) AS k FROM a GROUP BY 1), m AS (SELECT DISTINCT a.src AS id FROM a JOIN a b ON a.src = b.dst AND a.dst = b.src)
SELECT s_suppkey AS id, coalesce(k, 0) AS attacks, CASE WHEN m.id IS NOT NULL THEN 'undecided' WHEN coalesce(k, 0) > 0 THEN 'out' ELSE 'in' END AS grounded
FROM supplier LEFT JOIN n ON n.id = s_suppkey LEFT JOIN m ON m.id = s_suppkey
""")
def grounded(spark, sf_dir):
    e = _parts(spark, sf_dir)
    attacks = e.where("(src + dst) % 2 = 0").unionByName(e.where("(src + dst) % 4 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return rules.grounded_status(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), attacks)


@R.query("rule_support_closure", """
WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS src, s_suppkey + 1 AS dst, 0.9::DOUBLE AS c FROM supplier WHERE s_suppkey % 8 <> 0),
r(src, dst, hops, c) AS (SELECT src, dst, 1, c FROM e UNION ALL SELECT r.src, e.dst, hops + 1, r.c * e.c * 0.9 FROM r JOIN e ON r.dst = e.src)
SELECT src, dst, hops, round(c, 9) AS confidence FROM r WHERE hops > 1
""")
def closure(spark, sf_dir):
    e = table(spark, sf_dir, "supplier").where("s_suppkey % 8 <> 0").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"), F.lit(0.9).alias("confidence"))
    return rules.support_closure(e).withColumn("confidence", F.round("confidence", 9))


@R.query("rule_reliability", """
SELECT l_suppkey AS id, round((g + 1) / (g + b + 2), 9) AS mean, round((g + 1) * (b + 1) / ((g + b + 2) * (g + b + 2) * (g + b + 3)), 9) AS variance
FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'N')::DOUBLE AS g, count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS b FROM lineitem GROUP BY 1)
""")
def reliability(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count_if(F.col("l_returnflag") == "N").alias("g"), F.count_if(F.col("l_returnflag") == "R").alias("b"))
    return rules.reliability(t, "g", "b").select("id", F.round("mean", 9).alias("mean"), F.round("variance", 9).alias("variance"))


@R.query("rule_same_as_collapse", f"""
WITH RECURSIVE {_CO}, s AS (SELECT x, y FROM co WHERE (x + y) % 7 < 2 UNION SELECT y, x FROM co WHERE (x + y) % 7 < 2),
r(id, root) AS (SELECT x, x FROM s UNION SELECT y, root FROM r JOIN s ON x = id) SELECT id, min(root) AS canonical FROM r GROUP BY id
""")
def same_as(spark, sf_dir):
    e = _parts(spark, sf_dir).withColumn("confidence", F.when((F.col("src") + F.col("dst")) % 7 < 2, 0.95).otherwise(0.5))
    pairs = e.withColumn("source", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return rules.collapse_same(pairs, 0.9)


QUERIES, ORACLE_SQL = R.queries, R.oracle
