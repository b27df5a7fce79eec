"""Queries of knowledge retrieval, matrices, rule sets, catalogs, features and statements that write."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import catalog, datalog, features, knowledge, matrix
from lodestrata.operators.model import has_label, label_postings, property_postings
from lodestrata.plans.engine import Engine
from lodestrata.queries.graphs import engine, star
from lodestrata.queries.registry import Registry
from lodestrata.runtime import table

R = Registry()

_TRUSTED = "t AS (SELECT 'o' || l_orderkey AS f, 'p' || l_partkey AS g, round(1 - min(l_discount), 4) AS c FROM lineitem GROUP BY 1, 2)"


@R.query("graph_confidence_expand", f"""
WITH RECURSIVE {_TRUSTED}, e AS (SELECT f AS x, g AS y FROM t WHERE c >= 0.99 UNION SELECT g, f FROM t WHERE c >= 0.99),
r(id, depth) AS (SELECT 'p1', 0 UNION SELECT y, depth + 1 FROM r JOIN e ON x = id WHERE depth < 4)
SELECT id, min(depth) AS depth FROM r GROUP BY id
""")
def confident(spark, sf_dir):
    seeds = spark.range(1).select(F.lit("p1").alias("id"))
    return knowledge.expand(star(spark, sf_dir)[1], seeds, 4, "both", 0.99, ["CONTAINS"])


@R.query("graph_impact", """
WITH a AS (SELECT 'n' || n_nationkey AS id, n_nationkey AS k FROM nation WHERE n_regionkey = 2)
SELECT 'r2' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM a
UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN a ON c_nationkey = k UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier JOIN a ON s_nationkey = k
""")
def impact(spark, sf_dir):
    """What depends on a region, two hops against the edges."""
    return knowledge.expand(star(spark, sf_dir)[1], spark.range(1).select(F.lit("r2").alias("id")), 2, "in")


@R.query("graph_typed_reachable", """
SELECT 'c5' AS id UNION ALL SELECT 'n' || c_nationkey FROM customer WHERE c_custkey = 5
""")
def typed(spark, sf_dir):
    seeds = spark.range(1).select(F.lit("c5").alias("id"))
    return knowledge.expand(star(spark, sf_dir)[1], seeds, None, "out", types=["IN_NATION"]).select("id")


@R.query("graph_explain_edge", "SELECT 'PLACED_BY|o' || o_orderkey || '|c' || o_custkey AS id, 'PLACED_BY' AS type FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def explained(spark, sf_dir):
    first = table(spark, sf_dir, "orders").agg(F.min(F.struct("o_orderkey", "o_custkey")).alias("m")).first()["m"]
    return knowledge.explain(star(spark, sf_dir)[1], f"c{first['o_custkey']}", f"o{first['o_orderkey']}").select("id", "type")


def _places(spark, sf_dir):
    """Customers, their nations and regions as weighted edges that hold for a while."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    own = c.select(F.concat(F.lit("c"), k).alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit(1.0).alias("weight"), (k % 50).alias("valid_from"), F.when(k % 3 != 0, k % 50 + 20).alias("valid_to"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit(1.0).alias("weight"))
    return own, own.unionByName(n.withColumn("valid_from", F.lit(None).cast("long")).withColumn("valid_to", F.lit(None).cast("long")))


def _ranks(condition: str, seeds: str = "1 = 1") -> str:
    """Scores of a push over the three levels: each level keeps 0.15 of what reaches it."""
    return f"""WITH s AS (SELECT * FROM customer WHERE {seeds}), w AS (SELECT 1.0::DOUBLE / count(*) AS w FROM s),
u AS (SELECT c_custkey, c_nationkey, {condition} AS ok FROM s)
SELECT 'c' || c_custkey AS id, round(0.15 * w, 9) AS score FROM u, w
UNION ALL SELECT 'n' || c_nationkey, round(0.15 * 0.85 * count(*) * any_value(w), 9) FROM u, w WHERE ok GROUP BY c_nationkey
UNION ALL SELECT 'r' || n_regionkey, round(0.15 * 0.85 * 0.85 * count(*) * any_value(w), 9) FROM u JOIN nation ON n_nationkey = c_nationkey, w WHERE ok GROUP BY n_regionkey"""


@R.query("graph_filtered_ranks", _ranks("true", "c_acctbal >= 0"))
def filtered(spark, sf_dir):
    """Customers in debt neither seed nor pass anything on."""
    _, edges = _places(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    ids = edges.select(F.col("dst").alias("id")).unionByName(c.where("c_acctbal >= 0").select(F.concat(F.lit("c"), "c_custkey").alias("id")))
    seeds = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit(1.0).alias("weight"))
    return knowledge.filtered_ranks(edges, seeds, ids, epsilon=0.0).select("id", F.round("score", 9).alias("score"))


@R.query("graph_ranks_at", _ranks("c_custkey % 50 <= 30 AND (c_custkey % 3 = 0 OR c_custkey % 50 + 20 > 30)"))
def valid_time(spark, sf_dir):
    own, edges = _places(spark, sf_dir)
    seeds = own.select(F.col("src").alias("id"), F.lit(1.0).alias("weight"))
    return knowledge.ranks_at(edges, seeds, 30, epsilon=0.0).select("id", F.round("score", 9).alias("score"))


@R.query("graph_related", "SELECT 'n' || c_nationkey AS id, round(0.15 * 0.85, 9) AS score FROM customer WHERE c_custkey = 5")
def related(spark, sf_dir):
    _, edges = _places(spark, sf_dir)
    return knowledge.related(edges, star(spark, sf_dir)[0], "c5", "Nation", 10).select("id", F.round("score", 9).alias("score"))


@R.query("graph_keyword_search", """
SELECT id, score FROM (
  SELECT 'p' || p_partkey AS id, 2.0 * contains(lower('p' || p_partkey), 'bolt')::INT + 2.0 * contains(lower(p_name), 'bolt')::INT + contains(lower(p_brand), 'bolt')::INT AS score FROM part)
WHERE score > 0 ORDER BY score DESC, id LIMIT 50
""")
def keywords(spark, sf_dir):
    return knowledge.keyword_search(star(spark, sf_dir)[0].where(has_label("Part")), "Bolt", ["brand"], 50)


@R.query("graph_property_candidates", """
WITH s AS (SELECT o_custkey AS node, o_orderpriority AS value, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY node) AS total, row_number() OVER (PARTITION BY node ORDER BY n DESC, value) AS k FROM s WHERE true)
SELECT 'c' || node AS id, 'priority' AS property, value, round(n / total::DOUBLE, 9) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, value) AS kk FROM t WHERE n >= 3) WHERE kk = 1
""")
def property_candidates(spark, sf_dir):
    """The priority that most of a customer's orders have."""
    o = table(spark, sf_dir, "orders")
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    properties = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("priority").alias("property"), F.col("o_orderpriority").alias("value"))
    return knowledge.property_candidates(edges, properties, 3).select("id", "property", "value", F.round("confidence", 9).alias("confidence"))


_LINES = "(SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE text IS NOT NULL)"


@R.query("grep_content", f"SELECT path, line::INT AS line, text FROM {_LINES} WHERE regexp_matches(text, '[0-9]{{3}}-[0-9]{{4}}') ORDER BY path, line LIMIT 200")
def grep(spark, sf_dir):
    return knowledge.content_grep(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"), "[0-9]{3}-[0-9]{4}", 200)


@R.query("grep_paths", """
SELECT path, score FROM (SELECT url AS path, CASE WHEN contains(lower(string_split(url, '/')[-1]), 'then') THEN 3 WHEN contains(lower(url), 'then') THEN 2 WHEN regexp_matches(lower(url), 't.*h.*e.*n') THEN 1 ELSE 0 END AS score FROM pages)
WHERE score > 0 ORDER BY score DESC, len(path), path LIMIT 100
""")
def paths(spark, sf_dir):
    return knowledge.path_grep(table(spark, sf_dir, "pages").select(F.col("url").alias("path")), "Then", 100)


@R.query("recall_briefing", """
(SELECT 'recent' AS part, o_orderkey AS id, o_orderkey * 7 % 1009 AS value FROM orders ORDER BY 3 DESC, 2 LIMIT 5)
UNION ALL (SELECT 'linked', l_suppkey, count(*) FROM lineitem GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
UNION ALL (SELECT 'open', o_orderkey, o_orderkey % 977 FROM orders WHERE o_orderstatus = 'O' ORDER BY 3, 2 LIMIT 5)
""")
def briefing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (-F.col("l_orderkey") * 8 - F.col("l_linenumber") - 10**12).alias("dst"))
    return knowledge.briefing(o.select(k.alias("id"), (k * 7 % 1009).alias("updated_ms")), links, o.select(k.alias("id"), (k % 977).alias("since_ms"), (F.col("o_orderstatus") == "O").alias("open")), 5)


def _cells(spark, sf_dir):
    """Quantities of parts by supplier."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").cast("long").alias("value"))


_CELLS = "m AS (SELECT l_partkey AS x, l_suppkey AS y, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY 1, 2)"


@R.query("matrix_vector", f"WITH {_CELLS} SELECT x AS row, CAST(sum(v * (y % 5 + 1)) AS BIGINT) AS value FROM m WHERE x % 2 = 0 GROUP BY 1")
def times_vector(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    vector = cells.select(F.col("col").alias("row")).distinct().withColumn("value", F.col("row") % 5 + 1)
    return matrix.matrix_vector(cells, vector, "plus_times", cells.select("row").where("row % 2 = 0").distinct())


@R.query("matrix_product", f"WITH {_CELLS} SELECT a.y AS row, b.y AS col, min(a.v + b.v) AS value FROM m a JOIN m b ON a.x = b.x GROUP BY 1, 2")
def times_matrix(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    turned = cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    return matrix.matrix_matrix(turned, cells, "min_plus")


@R.query("matrix_elementwise_or", "SELECT o_custkey AS row, o_orderkey % 7 AS col FROM orders UNION SELECT c_custkey, c_nationkey FROM customer")
def cells_of_either(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("row"), (F.col("o_orderkey") % 7).alias("col"))
    return matrix.elementwise_or(a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.col("c_nationkey").alias("col")))


@R.query("matrix_compressed_rows", """
WITH e AS (SELECT 'c' || c_custkey AS x, 'n' || c_nationkey AS y, sum(c_acctbal)::DOUBLE AS w FROM customer GROUP BY 1, 2), i AS (SELECT x AS id FROM e UNION SELECT y FROM e),
k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM i),
r AS (SELECT k.n, count(e.x) AS size, list(t.n ORDER BY t.n) FILTER (WHERE t.n IS NOT NULL) AS targets FROM k LEFT JOIN e ON e.x = k.id LEFT JOIN k t ON t.id = e.y GROUP BY 1)
SELECT n AS number, CAST(sum(size) OVER (ORDER BY n) - size AS BIGINT) AS first, coalesce(targets, []) AS targets FROM r
""")
def compressed(spark, sf_dir):
    e = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.col("c_acctbal").cast("double").alias("weight"))
    return matrix.compressed_rows(e)[1].select("number", "first", "targets")


@R.query("postings_intersection", "SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def intersection(spark, sf_dir):
    nodes = star(spark, sf_dir)[0]
    labelled = label_postings(nodes).where("label = 'Customer'").select("id")
    return labelled.intersect(property_postings(nodes).where("property = 'segment' AND value = 'BUILDING'").select("id"))


@R.query("postings_tiers", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def tiers(spark, sf_dir):
    """Postings in two tiers, here of even and odd orders; an event is found if all asked fields name it in either."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("o_orderstatus", "o_orderpriority")])))
    both = o.where("id % 2 = 0").unionByName(o.where("id % 2 = 1"))
    asked = both.where("(field = 'o_orderstatus' AND value = 'O') OR (field = 'o_orderpriority' AND value = '1-URGENT')")
    return asked.groupBy("id").agg(F.count_distinct("field").alias("n")).where("n = 2").select("id")


def _rules() -> datalog.RuleSet:
    rules = datalog.RuleSet()
    rules.add("in_debt", lambda f: f["customer"].where("c_acctbal < 0").select(F.lit("in_debt").alias("rule"), F.concat(F.lit("c"), "c_custkey").alias("subject"), F.lit(0.9).alias("confidence")))
    rules.add("has_refuted", lambda f: f["orders"].where("o_orderstatus = 'F'").select(F.lit("has_refuted").alias("rule"), F.concat(F.lit("c"), "o_custkey").alias("subject"), F.lit(0.5).alias("confidence")))
    return rules


_FACTS = """f AS (SELECT 'in_debt' AS rule, 'c' || c_custkey AS subject, 0.9::DOUBLE AS confidence FROM customer WHERE c_acctbal < 0
UNION SELECT 'has_refuted', 'c' || o_custkey, 0.5 FROM orders WHERE o_orderstatus = 'F')"""


@R.query("rule_set_run", f"WITH {_FACTS} SELECT sha256(rule || '|' || subject) AS fact_id, rule, subject, confidence FROM f")
def rule_set(spark, sf_dir):
    return _rules().run({n: table(spark, sf_dir, n) for n in ("customer", "orders")})


@R.query("rule_pack_hash", f"""
WITH {_FACTS}, i AS (SELECT sha256(rule || '|' || subject) AS id FROM f), b AS (SELECT id[1:2] AS b, sha256(string_agg(id, ',' ORDER BY id)) AS h FROM i GROUP BY 1)
SELECT sha256(string_agg(h, ',' ORDER BY b)) AS hash FROM b
""")
def pack(spark, sf_dir):
    return datalog.pack_hash(_rules().run({n: table(spark, sf_dir, n) for n in ("customer", "orders")}))


@R.query("rule_saturation", """
SELECT 'located' AS pred, 'c' || c_custkey AS a, 'n' || c_nationkey AS b, round(0.9, 6) AS confidence FROM customer
UNION ALL SELECT 'located', 'n' || n_nationkey, 'r' || n_regionkey, 0.8 FROM nation
UNION ALL SELECT 'within', 'c' || c_custkey, 'n' || c_nationkey, 0.9 FROM customer UNION ALL SELECT 'within', 'n' || n_nationkey, 'r' || n_regionkey, 0.8 FROM nation
UNION ALL SELECT 'within', 'c' || c_custkey, 'r' || n_regionkey, 0.72 FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def saturation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("located").alias("pred"), F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"), F.lit(0.9).alias("confidence"))
    n = table(spark, sf_dir, "nation").select(F.lit("located").alias("pred"), F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"), F.lit(0.8).alias("confidence"))
    rules = [("within", [("located", "x", "y")]), ("within", [("within", "x", "z"), ("within", "z", "y")])]
    closed = datalog.prune(datalog.saturate(c.unionByName(n), rules), 0.5)
    return closed.select("pred", "a", "b", F.round("confidence", 6).alias("confidence"))


@R.query("rule_provenance", """
SELECT o_custkey AS customer, l_partkey AS part, count(*) AS derivations, round(max((1 - l_discount) * 0.9), 6) AS viterbi, max((1 - l_discount) * 0.9) > 0 AS holds,
  list_sort(list(DISTINCT [least(l_suppkey, o_orderkey), greatest(l_suppkey, o_orderkey)])) AS why FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey <> o_orderkey GROUP BY 1, 2
""")
def provenance(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_suppkey <> o_orderkey")
    d = joined.select(F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("part"), ((1 - F.col("l_discount")).cast("double") * 0.9).alias("trust"), "l_suppkey", "o_orderkey")
    out = matrix.semiring_provenance(d, ["customer", "part"], "trust", F.array("l_suppkey", "o_orderkey"))
    return out.withColumn("viterbi", F.round("viterbi", 6))


@R.query("rule_promote", "SELECT 'o' || o_orderkey AS from_id, 'c' || o_custkey AS to_id, 'placed' AS type, 0.7::DOUBLE AS confidence FROM orders WHERE o_orderstatus = 'O'")
def promoted(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    statements = o.select(F.concat(F.lit("o"), "o_orderkey").alias("subject"), F.when(F.col("o_orderstatus") == "O", "placed").otherwise("closed").alias("predicate"), F.concat(F.lit("c"), "o_custkey").alias("object"), F.lit(0.7).alias("confidence"))
    return datalog.promote(statements.unionByName(statements.withColumn("confidence", F.lit(0.2))), "placed")


@R.query("temporal_densification", """
WITH i AS (SELECT o_orderkey AS id, o_orderkey * 13 % 20011 AS s, o_orderkey * 13 % 20011 + o_orderkey % 5 AS e FROM orders)
SELECT a.id AS a, b.id AS b, greatest(b.s - a.e, 0) AS apart FROM i a JOIN i b ON (a.s < b.s OR (a.s = b.s AND a.id < b.id)) AND b.s <= a.e + 2
""")
def dense_pairs(spark, sf_dir):
    k = F.col("o_orderkey")
    return matrix.overlapping(table(spark, sf_dir, "orders").select(k.alias("id"), (k * 13 % 20011).alias("start"), (k * 13 % 20011 + k % 5).alias("stop")), 2, 16)


_NAMED = ("region", "nation", "customer")


@R.query("catalog_columns", "SELECT table_name, column_name, ordinal_position::INT AS ordinal_position FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer')")
def columns(spark, sf_dir):
    own = Engine(spark, {n: table(spark, sf_dir, n) for n in _NAMED})
    return own.information_schema()["columns"].select("table_name", "column_name", "ordinal_position")


@R.query("catalog_tables", "SELECT table_name, 'BASE TABLE' AS table_type FROM information_schema.tables WHERE table_name IN ('region', 'nation', 'customer') UNION ALL SELECT 'rich', 'MATERIALIZED'")
def tables(spark, sf_dir):
    own = Engine(spark, {n: table(spark, sf_dir, n) for n in _NAMED})
    own.create_table_as("rich", "SELECT c_custkey FROM customer WHERE c_acctbal > 0")
    return own.information_schema()["tables"]


@R.query("catalog_lineage", "SELECT * FROM (VALUES ('rich', 'customer'), ('rich', 'nation'), ('best', 'rich')) t(target, source)")
def lineage(spark, sf_dir):
    own = Engine(spark, {n: table(spark, sf_dir, n) for n in _NAMED})
    own.create_table_as("rich", "WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT c_custkey, c_acctbal FROM customer JOIN n ON c_nationkey = k WHERE c_acctbal > 0")
    own.create_table_as("best", "SELECT max(c_acctbal) AS m FROM rich")
    return own.lineage_of()


@R.query("catalog_plan_metrics", """
SELECT l_linestatus AS plan, count(*) AS runs, round(avg(l_extendedprice::DOUBLE), 4) AS cost, round(avg((l_returnflag = 'N')::INT), 9) AS success, round(stddev_samp(l_extendedprice::DOUBLE) / sqrt(count(*)), 4) AS error FROM lineitem GROUP BY 1
""")
def plan_metrics(spark, sf_dir):
    receipts = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("plan"), F.col("l_extendedprice").cast("double").alias("cost"), (F.col("l_returnflag") == "N").alias("ok"))
    return catalog.plan_metrics(receipts).select("plan", "runs", F.round("cost", 4).alias("cost"), F.round("success", 9).alias("success"), F.round("error", 4).alias("error"))


@R.query("catalog_index_advice", """
WITH r AS (SELECT 'orders' AS relation, o_orderpriority AS col, (o_orderpriority = '1-URGENT') AS indexed, 100 AS read, o_orderkey % (CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 97 END) AS out FROM orders),
p AS (SELECT relation, col, count(*) AS runs, 1 - sum(out) / sum(read)::DOUBLE AS share, avg(indexed::INT) AS indexed FROM r GROUP BY 1, 2)
SELECT relation, col AS "column", runs, round(share, 9) AS share, CASE WHEN runs < 5 THEN 'retired' WHEN indexed = 1 THEN 'promoted' WHEN share >= 0.9 THEN 'shadow' ELSE 'proposed' END AS state FROM p
""")
def advice(spark, sf_dir):
    k, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    receipts = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("relation"), priority.alias("column"), (priority == "1-URGENT").alias("indexed"), F.lit(100).alias("rows_read"), (k % F.when(priority == "5-LOW", 2).otherwise(97)).alias("rows_out")
    )
    return catalog.index_advice(receipts, 5, 0.9).withColumn("share", F.round("share", 9))


_TREE = {
    "op": "add",
    "args": [
        {"op": "mul", "args": [{"op": "field", "name": "c_nationkey"}, {"op": "const", "value": 2}]},
        {"op": "max", "args": [{"op": "count", "hop": "orders"}, {"op": "const", "value": 3}]},
    ],
}
_FLAG = {"op": "and", "args": [{"op": "gt", "args": [{"op": "field", "name": "c_acctbal"}, {"op": "const", "value": 0}]}, {"op": "not", "args": [{"op": "exists", "hop": "orders"}]}], "otherwise": False}


@R.query("feature_language", "SELECT c_custkey AS id, c_nationkey * 2 + greatest(n, 3) AS value, c_acctbal > 0 AND n = 0 AS flag FROM (SELECT c_custkey, c_nationkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)")
def feature(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("from_id"), F.lit("PLACED").alias("type"))
    rows, counts = features.hop_counts(table(spark, sf_dir, "customer"), "c_custkey", orders, {"orders": "PLACED"})
    return rows.select(F.col("c_custkey").alias("id"), features.compile_feature(_TREE, counts).alias("value"), features.compile_feature(_FLAG, counts).alias("flag"))


@R.query("feature_scores", "SELECT c_custkey AS id, round(greatest(0, least(1, c_acctbal::DOUBLE * 0.0002)) + greatest(0, least(1, c_nationkey * 0.05)), 9) AS score FROM customer")
def scored(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("b"), "c_nationkey")
    return features.feature_scores(c, {"b": 0.0002, "c_nationkey": 0.05}).select("id", F.round("score", 9).alias("score"))


@R.query("fusion_components", "SELECT c_custkey AS id, round(c_acctbal::DOUBLE * 0.5 + c_nationkey, 6) AS score FROM customer")
def components(spark, sf_dir):
    parts = F.create_map(F.lit("balance"), F.col("c_acctbal").cast("double"), F.lit("nation"), F.col("c_nationkey").cast("double"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), parts.alias("parts"))
    return features.component_fusion(c, "parts", {"balance": 0.5}).select("id", F.round("score", 6).alias("score"))


@R.query("fusion_listwise", "SELECT c_custkey AS id, round(0.8 * (c_nationkey / 25.0::DOUBLE) + 0.2 * CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 - (c_custkey % 20) / 20.0::DOUBLE END, 9) AS blended FROM customer")
def listwise(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), (F.col("c_nationkey") / 25.0).alias("score"), F.when(k % 4 != 0, k % 20).alias("rank"))
    return features.listwise_blend(c, "score", "rank", F.lit(20.0)).select("id", F.round("blended", 9).alias("blended"))


@R.query("order_by_fields", "SELECT c_custkey AS id FROM customer ORDER BY CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey LIMIT 40")
def fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("n"), "c_acctbal")
    return features.field_sort(c, [("n", False), ("c_acctbal", True)]).limit(40).select("id")


@R.query("fusion_pack_selection", """
WITH p AS (SELECT l_orderkey AS id, max(1 - l_discount)::DOUBLE AS trust, list_distinct(list(l_returnflag)) AS topics FROM lineitem GROUP BY 1)
SELECT id, round(len(list_intersect(topics, ['A', 'R', 'X'])) / 3.0::DOUBLE * trust, 9) AS score FROM p WHERE trust >= 0.95 AND len(list_intersect(topics, ['A', 'R', 'X'])) > 0 ORDER BY 2 DESC, 1 LIMIT 20
""")
def packs(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(1 - F.col("l_discount")).cast("double").alias("trust"), F.collect_set("l_returnflag").alias("topics"))
    return features.select_packs(p, ["A", "R", "X"], 0.95, 20).select("id", F.round("score", 9).alias("score"))


@R.query("fn_stable_hash", """SELECT c_custkey AS id, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') AS hash FROM customer""")
def hashed(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), datalog.stable_hash("c_nationkey", "c_name", "c_custkey").alias("hash"))


# Statements that write; each query reads the graph after them.


@R.query("cypher_create_node", "SELECT n_name AS name FROM nation UNION ALL SELECT 'ATLANTIS' UNION ALL SELECT 'MU'")
def create_node(spark, sf_dir):
    g = engine(spark, sf_dir)
    g.execute("CREATE (a:Nation {id: 'n100', name: 'ATLANTIS'}), (:Nation {name: $name})", {"name": "MU"})
    return g.cypher("MATCH (n:Nation) RETURN n.name AS name LIMIT 1000")


@R.query("cypher_create_edge", "SELECT 'n100' AS nation, 'r9' AS region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation WHERE n_regionkey = 1")
def create_edge(spark, sf_dir):
    g = engine(spark, sf_dir)
    g.execute("CREATE (a:Nation {id: 'n100', name: 'ATLANTIS'})-[:IN_REGION]->(b:Region {id: 'r9', name: 'SEA'})")
    new = g.cypher("MATCH (n:Nation {id: 'n100'})-[:IN_REGION]->(r:Region) RETURN n.id AS nation, r.id AS region")
    return new.unionByName(g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region {id: 'r1'}) RETURN n.id AS nation, r.id AS region"))


@R.query("cypher_match_create", "SELECT 'c' || c_custkey AS c, 'r' || n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'")
def match_create(spark, sf_dir):
    g = engine(spark, sf_dir)
    g.execute("MATCH (c:Customer {segment: 'BUILDING'})-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) CREATE (c)-[:LIVES_IN]->(r)")
    return g.cypher("MATCH (c:Customer)-[:LIVES_IN]->(r:Region) RETURN c.id AS c, r.id AS r LIMIT 1000000")


@R.query("cypher_merge", "SELECT 'n3' AS id, 'seen' AS state, 2 AS version UNION ALL SELECT 'n200', 'new', 1")
def merge(spark, sf_dir):
    g = engine(spark, sf_dir)
    g.execute("MERGE (n:Nation {id: 'n3'}) ON CREATE SET n.state = 'new' ON MATCH SET n.state = 'seen'")
    g.execute("MERGE (n:Nation {id: 'n200'}) ON CREATE SET n.state = 'new' ON MATCH SET n.state = 'seen'")
    return g.nodes.where("id IN ('n3', 'n200')").select("id", F.get_json_object("properties", "$.state").alias("state"), F.col("version").cast("int").alias("version"))


@R.query("cypher_set", "SELECT 'c' || c_custkey AS id, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END AS segment FROM customer")
def set_property(spark, sf_dir):
    g = engine(spark, sf_dir)
    g.execute("MATCH (c:Customer) WHERE c.balance < 0 SET c.segment = 'debt'")
    return g.cypher("MATCH (c:Customer) RETURN c.id AS id, c.name AS name, c.segment AS segment LIMIT 10000000")


@R.query("cypher_delete", "SELECT 'PLACED_BY' AS type, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0 UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer WHERE c_acctbal >= 0) + (SELECT count(*) FROM supplier)")
def delete(spark, sf_dir):
    g = engine(spark, sf_dir)
    g.execute("MATCH (c:Customer) WHERE c.balance < 0 DETACH DELETE c")
    live = g.edges.where("NOT tombstone AND type IN ('PLACED_BY', 'IN_NATION')")
    return live.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE_SQL = R.queries, R.oracle
