"""Read models, object queries and evaluation over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import readmodels as M
from lodestrata.plans.objects import Both, ObjectQuery, Test, run_objects, selection
from lodestrata.queries.registry import Registry
from lodestrata.runtime import table

R = Registry()


@R.query("model_composite_prefix", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 4")
def composite(spark, sf_dir):
    return M.composite_lookup(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey", "c_custkey"], ["BUILDING", 4]).select("c_custkey")


@R.query("model_partial_drift", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'missing' ELSE 'extra' END AS drift FROM orders WHERE (o_orderstatus = 'F' AND o_orderkey % 5 = 0) OR (o_orderstatus <> 'F' AND o_orderkey % 7 = 0)")
def drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    index = o.where("(o_orderstatus = 'F' AND o_orderkey % 5 <> 0) OR (o_orderstatus <> 'F' AND o_orderkey % 7 = 0)").select("o_orderkey")
    return M.partial_drift(index, o, {"o_orderstatus": "F"}, ["o_totalprice"], "o_orderkey")


@R.query("model_covering_stale", "SELECT o_orderkey, o_orderkey % 4 = 0 AS stale FROM orders")
def stale(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("version"))
    now = o.withColumn("version", F.when(F.col("o_orderkey") % 4 == 0, 2).otherwise(1))
    return M.covering(now, o, "o_orderkey", "version").select("o_orderkey", "stale")


@R.query("model_zone_map", "SELECT floor(o_orderkey / 100.0::DOUBLE)::BIGINT AS fragment, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders GROUP BY 1")
def zones(spark, sf_dir):
    return M.fragments(table(spark, sf_dir, "orders"), "o_totalprice", 100, "o_orderkey")


@R.query("model_fragment_scan", "SELECT count(*) FILTER (WHERE hi >= 300000 AND lo <= 900000) AS visited, count(*) FILTER (WHERE NOT (hi >= 300000 AND lo <= 900000)) AS skipped FROM (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY floor(o_orderkey / 20.0::DOUBLE))")
def scan(spark, sf_dir):
    return M.fragment_scan(M.fragments(table(spark, sf_dir, "orders"), "o_totalprice", 20, "o_orderkey"), 300000, 900000)


@R.query("model_tree_scan", "SELECT url AS path FROM pages WHERE starts_with(url, 'https://m.') ORDER BY 1")
def tree(spark, sf_dir):
    return M.tree_scan(table(spark, sf_dir, "pages").select(F.col("url").alias("path")), "https://m.")


@R.query("model_receipt_clusters", "SELECT event_type, count(*) AS queries, round(sum(value), 4) AS value FROM events GROUP BY 1")
def receipts(spark, sf_dir):
    out = M.receipt_clusters(table(spark, sf_dir, "events"), ["event_type"], ["value"])
    return out.withColumn("value", F.round("value", 4))


@R.query("model_consolidation", "SELECT lower(p_brand) AS key, count(*) AS n, list_slice(list(p_name ORDER BY p_partkey), 1, 3) AS summaries FROM part GROUP BY 1")
def consolidation(spark, sf_dir):
    return M.consolidation_groups(table(spark, sf_dir, "part"), F.lower("p_brand"), "p_partkey", "p_name")


@R.query("model_scatter_mean", "SELECT label, list(round(m, 6) ORDER BY i) AS vector FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY label")
def scatter(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return M.scatter(e, "label", "v", "mean").select("label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@R.query("model_recency", "SELECT user_id, count(*) AS touches, max(event_id) AS last FROM events GROUP BY 1")
def recency(spark, sf_dir):
    return M.recency(table(spark, sf_dir, "events"), "user_id", "event_id")


@R.query("model_temporal_neighbors", """
WITH e AS (SELECT o_custkey AS src, o_orderkey % 200 AS dst, o_orderkey AS t FROM orders), roots AS (SELECT c_custkey AS id, 900 AS until FROM customer),
one AS (SELECT id AS root, dst AS node, t, row_number() OVER (PARTITION BY id ORDER BY t DESC, dst) AS n FROM roots JOIN e ON src = id AND t < until),
two AS (SELECT root, dst AS node, e.t, row_number() OVER (PARTITION BY root, node ORDER BY e.t DESC, dst) AS n FROM (SELECT * FROM one WHERE n <= 16) o JOIN e ON e.src = o.node AND e.t < o.t WHERE dst <> root)
SELECT root, 1 AS hop, node, t FROM one WHERE n <= 16 UNION ALL SELECT root, 2, node, t FROM two WHERE n <= 8
""")
def neighbors(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 200).alias("dst"), F.col("o_orderkey").alias("t"))
    roots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(900).alias("at"))
    return M.temporal_neighbors(e, roots)


@R.query("model_ranking_quality", """
WITH s AS (SELECT (o_orderkey * 7 % 101) / 101.0::DOUBLE AS score, (o_orderkey % 3 = 0)::INT AS label FROM orders),
g AS (SELECT score, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM s GROUP BY 1), r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 9) AS auc, round(sum(p * tp / (tp + fp)) / sum(p), 9) AS average_precision,
  round(sum(-(p * ln(greatest(score, 1e-15)) + n * ln(greatest(1 - score, 1e-15)))) / (sum(p) + sum(n)), 9) AS log_loss FROM r
""")
def quality(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(((F.col("o_orderkey") * 7 % 101) / 101.0).alias("score"), (F.col("o_orderkey") % 3 == 0).cast("int").alias("label"))
    return M.ranking_quality(s).select(*[F.round(c, 9).alias(c) for c in ("auc", "average_precision", "log_loss")])


@R.query("rule_ownership_chain", "SELECT o_custkey, list(o_orderkey ORDER BY y NULLS LAST, o_orderkey) AS chain FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE year(o_orderdate) END AS y FROM orders) GROUP BY 1")
def chain(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("y", F.when(F.col("o_orderkey") % 9 != 0, F.year("o_orderdate")))
    return M.ownership_chain(o, "o_custkey", "y", "o_orderkey")


@R.query("rule_conflict_set", "SELECT l_orderkey, 'flag' AS field, list_sort(list(DISTINCT l_returnflag)) AS values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def conflicts(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("flag").alias("field"), "l_returnflag")
    return M.conflict_sets(a, "l_orderkey", "field", "l_returnflag")


@R.query("rule_demolition_window", "WITH s AS (SELECT o_custkey AS c, year(o_orderdate) AS y, o_orderstatus = 'F' AS p FROM orders), l AS (SELECT c, max(y) AS last_present FROM s WHERE p GROUP BY 1) SELECT c AS o_custkey, last_present, min(y) AS first_absent FROM s JOIN l USING (c) WHERE NOT p AND y > last_present GROUP BY 1, 2")
def demolition(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), (F.col("o_orderstatus") == "F").alias("p"))
    return M.demolition_window(s, "o_custkey", "y", "p")


@R.query("rule_fact_pack", "SELECT count(DISTINCT l_suppkey) AS facts FROM lineitem")
def pack(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.lit("r").alias("rule"), F.col("l_suppkey").cast("string").alias("subject"))
    return M.fact_pack(d).select("facts")


@R.query("statement_best", "SELECT l_partkey AS subject, l_suppkey AS object, round(max(1 - l_discount), 6) AS confidence, count(*) AS sources FROM lineitem GROUP BY 1, 2")
def statements(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.lit("SUPPLIED_BY").alias("p"), "l_suppkey", (1 - F.col("l_discount")).alias("c"))
    best = M.best_statements(M.statements(rows, "l_partkey", "p", "l_suppkey", "c"))
    return best.select("subject", "object", F.round("confidence", 6).alias("confidence"), "sources")


@R.query("fusion_provider_rrf", "SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS url, round(sum(1 / (60.0::DOUBLE + r)), 9) AS score FROM (SELECT url, (page_id % 10 + 1) AS r FROM pages UNION ALL SELECT url, (page_id % 7 + 1) FROM pages WHERE page_id % 2 = 0) GROUP BY 1")
def providers(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("url", F.regexp_replace("url", r"[?#].*$", ""))
    a = p.select("url", F.lit("a").alias("provider"), (F.col("page_id") % 10 + 1).alias("rank"), F.lit(None).cast("string").alias("title"))
    b = p.where("page_id % 2 = 0").select("url", F.lit("b").alias("provider"), (F.col("page_id") % 7 + 1).alias("rank"), F.lit("t").alias("title"))
    return M.provider_fusion(a.unionByName(b)).select("url", F.round("score", 9).alias("score"))


@R.query("fusion_arm_rerank", "SELECT p_partkey AS id, round(0.25 * (p_size / 50.0::DOUBLE) + 0.70 * (p_partkey % 11 / 11.0::DOUBLE) + 0.05 * (p_partkey % 3 / 3.0::DOUBLE), 6) AS score FROM part")
def arms(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("relevance"), (F.col("p_partkey") % 11 / 11.0).alias("ppr"), (F.col("p_partkey") % 3 / 3.0).alias("epistemic"))
    return M.arm_rerank(p, "code").select("id", F.round("score", 6).alias("score"))


@R.query("text_code_hits", "SELECT id, score FROM (SELECT p_partkey AS id, CASE WHEN lower(p_type) = 'steel' THEN 8 ELSE 0 END + 7 * contains(lower(p_name), '7')::INT + 2.75 * contains(lower(p_brand), '7')::INT + contains(lower(p_type), '7')::INT AS score FROM part) WHERE score > 0")
def hits(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_type").alias("kind"), F.lit("").alias("snippet"))
    return M.code_hits(s, "7")


@R.query("object_query_page", "SELECT c_custkey, c_acctbal FROM customer WHERE (c_mktsegment = 'BUILDING' OR contains(c_name, '7')) AND NOT c_nationkey = 3 ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 5")
def objects(spark, sf_dir):
    where = Both("and", (Both("or", (Test("c_mktsegment", "eq", "BUILDING"), Test("c_name", "contains", "7"))), Both("not", (Test("c_nationkey", "eq", 3),)), Test("c_name", "exists")))
    q = ObjectQuery("customer", where, (("c_acctbal", False), ("c_custkey", True)), 5, 15, ("c_custkey", "c_acctbal"))
    return run_objects(q, {"customer": table(spark, sf_dir, "customer")})


@R.query("object_nested_selection", "SELECT s_name AS root_s_name, n_name AS nation_n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def nested(spark, sf_dir):
    t = {"supplier": table(spark, sf_dir, "supplier"), "nation": table(spark, sf_dir, "nation")}
    return selection("supplier", {"s_name": None, "nation": ["n_name"]}, {"nation": ("s_nationkey", "n_nationkey")}, t)


QUERIES, ORACLE_SQL = R.queries, R.oracle
