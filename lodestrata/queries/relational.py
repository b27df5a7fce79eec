"""Relational queries over the star schema: scans, predicates, joins, aggregates, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import ordered, vector
from lodestrata.operators.joins import count_below
from lodestrata.operators.versioning import diff, merge
from lodestrata.plans.engine import Engine
from lodestrata.plans.ir import Equals, Join, Prefix, QueryIr, Range, TimeRange, compile_query
from lodestrata.queries.registry import Registry
from lodestrata.runtime import table

R = Registry()


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


@R.query(
    "rel_revenue_by_nation",
    """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n_name
""",
)
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of orders placed in 1996 or later, by the customer's nation."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        line.join(orders.select("o_orderkey", "o_custkey"), line.l_orderkey == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.groupBy("n_name").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n_lines")
    )


@R.query("rel_pricing_summary", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def pricing_summary(spark, sf_dir):
    return spark_sql(spark, sf_dir, R.oracle["rel_pricing_summary"], "lineitem")


def spark_sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """A statement through the engine's SQL front end."""
    return Engine(spark, catalog(spark, sf_dir, *names)).sql(text)


@R.query("ir_full_scan", "SELECT n_nationkey AS n_n_nationkey, n_name AS n_n_name, n_regionkey AS n_n_regionkey FROM nation")
def full_scan(spark, sf_dir):
    return compile_query(QueryIr({"n": "nation"}), catalog(spark, sf_dir, "nation"))


@R.query("ir_equality_range_join", """
SELECT o.o_orderkey AS o_o_orderkey, c.c_name AS c_c_name, o.o_totalprice AS o_o_totalprice
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus = 'F' AND o.o_totalprice >= 1000 AND o.o_totalprice < 50000 AND c.c_acctbal > 0
""")
def equality_range_join(spark, sf_dir):
    ir = QueryIr(
        {"o": "orders", "c": "customer"},
        (Equals("o", "o_orderstatus", "F"), Range("o", "o_totalprice", 1000, 50000, True, False), Range("c", "c_acctbal", 0, None, False)),
        (Join("o", "o_custkey", "c", "c_custkey"),),
        (("o", "o_orderkey"), ("c", "c_name"), ("o", "o_totalprice")),
    )
    return compile_query(ir, catalog(spark, sf_dir, "orders", "customer"))


@R.query("ir_prefix_scan", "SELECT p_partkey AS p_p_partkey, p_type AS p_p_type FROM part WHERE starts_with(p_type, 'S')")
def prefix_scan(spark, sf_dir):
    return compile_query(QueryIr({"p": "part"}, (Prefix("p", "p_type", "S"),), (), (("p", "p_partkey"), ("p", "p_type"))), catalog(spark, sf_dir, "part"))


@R.query("ir_time_range", """
SELECT event_id AS e_event_id, user_id AS e_user_id FROM events
WHERE ts BETWEEN (SELECT min(ts) FROM events) AND TIMESTAMP '2024-01-05'
""")
def time_range(spark, sf_dir):
    ir = QueryIr({"e": "events"}, (TimeRange("e", "ts", 0, 1704412800000),), (), (("e", "event_id"), ("e", "user_id")))
    return compile_query(ir, catalog(spark, sf_dir, "events"))


@R.query("ir_strict_equality", "SELECT p_partkey AS p_p_partkey FROM part WHERE false")
def strict_equality(spark, sf_dir):
    """Equality is strict about types: a text never equals a number."""
    return compile_query(QueryIr({"p": "part"}, (Equals("p", "p_size", "7"),), (), (("p", "p_partkey"),)), catalog(spark, sf_dir, "part"))


@R.query("ir_text_key_join", """
SELECT o_orderkey AS o_o_orderkey, k AS x_k FROM orders JOIN
  (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer WHERE c_acctbal > 5000) ON CAST(o_custkey AS VARCHAR) = k
""")
def text_key_join(spark, sf_dir):
    """Join keys of different types compare as text."""
    t = catalog(spark, sf_dir, "orders", "customer")
    t["x"] = t["customer"].where("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("k"))
    return compile_query(QueryIr({"o": "orders", "x": "x"}, (), (Join("o", "o_custkey", "x", "k"),), (("o", "o_orderkey"), ("x", "k"))), t)


@R.query("ir_join_chain_scored", """
SELECT c.c_custkey AS c_c_custkey, n.n_name AS n_n_name, r.r_name AS r_r_name, round(c.c_acctbal / 100, 6) AS score
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 50
""")
def join_chain_scored(spark, sf_dir):
    ir = QueryIr(
        {"c": "customer", "n": "nation", "r": "region"},
        (),
        (Join("c", "c_nationkey", "n", "n_nationkey"), Join("n", "n_regionkey", "r", "r_regionkey")),
    )
    out = compile_query(ir, catalog(spark, sf_dir, "customer", "nation", "region"))
    out = out.orderBy(F.col("c_c_acctbal").desc(), "c_c_custkey").limit(50)
    return out.select("c_c_custkey", "n_n_name", "r_r_name", F.round(F.col("c_c_acctbal") / 100, 6).alias("score"))


def _sql_query(name: str, tables: str, text: str) -> None:
    """Statements that both engines read alike run through the engine's SQL front end."""
    R.query(name, text)(lambda spark, sf_dir: spark_sql(spark, sf_dir, text, *tables.split()))


_sql_query("sql_group_having", "orders", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_sql_query("sql_count_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY l_returnflag")
_sql_query("sql_min_max_text", "part", "SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi, min(p_size) AS small, max(p_size) AS large FROM part GROUP BY p_brand")
_sql_query("sql_global_aggregate_empty", "part", "SELECT count(*) AS n, sum(p_size) AS s, min(p_name) AS lo FROM part WHERE p_size < 0")
_sql_query("sql_select_distinct", "customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
_sql_query("sql_left_join", "customer orders", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_sql_query("sql_full_join", "supplier customer", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
_sql_query("sql_semi_join", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
_sql_query("sql_anti_join", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql_query("sql_grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
_sql_query("sql_cube", "customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
_sql_query("sql_rollup", "part", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)")
_sql_query("sql_window_running", "orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
_sql_query("sql_window_rank", "part", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part")
_sql_query("sql_window_lag", "orders", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
_sql_query("sql_union", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
_sql_query("sql_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey AS k FROM supplier")
_sql_query("sql_except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 3000")
_sql_query("sql_cte_subquery", "lineitem orders", "WITH big AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) SELECT o_orderkey, q FROM big JOIN orders ON o_orderkey = l_orderkey")
_sql_query("sql_like_prefix", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'B%'")
_sql_query("sql_case_in", "orders", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END) AS done FROM orders GROUP BY o_orderpriority")
_sql_query("sql_order_limit_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
_sql_query("sql_top_suppliers", "lineitem supplier nation", "SELECT s_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY s_name, n_name")
_sql_query("sql_parts_by_quarter", "lineitem part", "SELECT p_brand, year(l_shipdate) AS y, quarter(l_shipdate) AS q, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3")
_sql_query("sql_scalar_subquery", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM orders)")
_sql_query("sql_null_ordering", "customer orders", "SELECT c_custkey, max(o_totalprice) AS best FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY c_custkey ORDER BY best DESC NULLS FIRST, c_custkey LIMIT 30")


@R.query("sql_theta_join", "SELECT s_suppkey, count(*) AS n FROM supplier JOIN part ON p_retailprice < s_acctbal / 4 GROUP BY s_suppkey")
def theta_join(spark, sf_dir):
    """Only counts of the pairs are asked for, so they are counted without making them."""
    suppliers, parts = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    return count_below(suppliers, "s_suppkey", F.col("s_acctbal") / 4, parts, F.col("p_retailprice"))


@R.query("rel_top_k_per_group", """
SELECT c_nationkey, c_custkey, c_acctbal, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3
""")
def top_k_per_group(spark, sf_dir):
    from lodestrata.operators.rules import elites

    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    return elites(rows, "c_nationkey", "c_acctbal", 3).select("c_nationkey", F.col("id").alias("c_custkey"), "c_acctbal", "rank")


@R.query("rel_approx_distinct")
def approx_distinct(spark, sf_dir):
    """A superset of the exact aggregates: sketches with partial aggregation."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.approx_percentile("l_quantity", 0.5).alias("median"))


@R.query("zset_rank", "SELECT o_orderkey AS member, o_totalprice AS score, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders")
def zset_rank(spark, sf_dir):
    return ordered.zrank(_entries(spark, sf_dir))


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("member"), F.col("o_totalprice").alias("score"))


@R.query("zset_rank_of", "SELECT CAST(sum(CASE WHEN o_totalprice < s OR (o_totalprice = s AND o_orderkey < m) THEN 1 ELSE 0 END) AS BIGINT) AS rank FROM orders, (SELECT o_totalprice AS s, o_orderkey AS m FROM orders ORDER BY o_orderkey LIMIT 1)")
def zset_rank_of(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    first = entries.agg(F.min("member")).first()[0]
    return ordered.zrank_of(entries, first)


@R.query("zset_range_by_score", "SELECT o_orderkey AS member, o_totalprice AS score FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 ORDER BY 2, 1 LIMIT 40 OFFSET 5")
def zset_range(spark, sf_dir):
    return ordered.zrange_by_score(_entries(spark, sf_dir), 1000, 90000, 40, 5)


@R.query("zset_pop_max", "SELECT o_orderkey AS member, o_totalprice AS score FROM orders ORDER BY 2 DESC, 1 DESC LIMIT 7")
def zset_pop_max(spark, sf_dir):
    return ordered.zpop(_entries(spark, sf_dir), 7, largest=True)[0]


@R.query("zset_pop_min_rest", "SELECT count(*) AS n, min(o_totalprice) AS least FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 9)")
def zset_pop_min(spark, sf_dir):
    return ordered.zpop(_entries(spark, sf_dir), 9)[1].agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))


@R.query("zset_add_remove", """
SELECT member, score FROM (
  SELECT o_orderkey AS member, CASE WHEN o_orderkey % 10 = 0 THEN 1.5 ELSE o_totalprice END AS score FROM orders) WHERE member % 7 <> 0
""")
def zset_add_remove(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    added = ordered.zadd(entries, entries.where("member % 10 = 0").select("member", F.lit(1.5).alias("score")))
    return ordered.zrem(added, entries.where("member % 7 = 0").select("member"))


@R.query("version_diff", """
SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'removed' WHEN o_orderkey % 13 = 0 THEN 'added' ELSE 'changed' END AS change
FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 13 <> 0 OR o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0
  OR (o_orderkey % 17 = 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderstatus <> 'X')
""")
def version_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = orders.where("o_orderkey % 13 <> 0")
    new = orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 17 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return diff(old, new, "o_orderkey")


_MERGED = """
WITH m AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'A' WHEN o_orderkey % 7 = 0 THEN 'B' ELSE o_orderstatus END AS o_orderstatus,
    o_orderkey % 5 = 0 AND o_orderkey % 7 = 0 AS conflict FROM orders)
"""


def _versions(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    change = lambda n, v: F.when(F.col("o_orderkey") % n == 0, F.lit(v)).otherwise(F.col("o_orderstatus"))
    return base, base.withColumn("o_orderstatus", change(5, "A")), base.withColumn("o_orderstatus", change(7, "B"))


@R.query("version_three_way_merge", _MERGED + "SELECT o_orderkey, o_orderstatus FROM m")
def version_merge(spark, sf_dir):
    return merge(*_versions(spark, sf_dir), "o_orderkey")[0]


@R.query("version_merge_conflicts", _MERGED + "SELECT o_orderkey FROM m WHERE conflict")
def version_conflicts(spark, sf_dir):
    return merge(*_versions(spark, sf_dir), "o_orderkey")[1]


@R.query("rel_dedup_first", "SELECT c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def dedup_first(spark, sf_dir):
    """First occurrence of each key in order."""
    w = Window.partitionBy("c_mktsegment").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").withColumn("n", F.row_number().over(w)).where("n = 1").select("c_mktsegment", "c_custkey")


@R.query("rel_recall_vs_exact", "SELECT 1.0 AS recall")
def recall_vs_exact(spark, sf_dir):
    """Share of the true five nearest that accelerated search finds, over the vectors divisible by 100."""
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = p.where("id % 100 = 0")
    dims = len(queries.where("id = 0").first()["vector"])
    exact = vector.exact_knn_join(queries, p, 5).select("query_id", "id")
    found = vector.accelerated_knn_join(queries, p, 5, dims).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


QUERIES, ORACLE_SQL = R.queries, R.oracle
