"""Queries of records through time and tiers, policies, merges and small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import lifecycle as L
from lodestrata.operators.vector import knn
from lodestrata.queries.registry import Registry
from lodestrata.queries.retrieval import places, points
from lodestrata.runtime import table

R = Registry()


def _orders(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.lit("t"), k % 3).alias("tenant"), F.col("o_orderstatus").alias("status"), (k * 7919 % 100003).alias("updated_ms"), F.concat(F.lit("s"), k % 5).alias("scope"),
        F.sha2(k.cast("string"), 256).alias("content_hash"),
    )


_ORDERS = "o AS (SELECT o_orderkey AS id, 't' || o_orderkey % 3 AS tenant, o_orderstatus AS status, o_orderkey * 7919 % 100003 AS updated_ms, 's' || o_orderkey % 5 AS scope FROM orders)"


@R.query("memory_newest", f"WITH {_ORDERS} SELECT id, updated_ms FROM o WHERE tenant = 't1' AND status = 'O' AND updated_ms >= 1000 AND updated_ms < 90000 ORDER BY updated_ms DESC, id LIMIT 100")
def newest(spark, sf_dir):
    return L.newest(_orders(spark, sf_dir), "t1", "O", 1000, 90000).select("id", "updated_ms")


@R.query("tier_coldest", f"WITH {_ORDERS} SELECT id AS member, updated_ms AS score FROM o WHERE updated_ms < 30000 ORDER BY updated_ms, id LIMIT 50")
def coldest(spark, sf_dir):
    return L.coldest_below(_orders(spark, sf_dir).select(F.col("id").alias("member"), F.col("updated_ms").alias("score")), 30000, 50)


@R.query("tier_cold_lookup", f"WITH {_ORDERS} SELECT id, sha256(id::VARCHAR) AS content_hash, scope FROM o WHERE updated_ms < 50000 AND id % 10 = 0")
def cold(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return L.cold_lookup(o.where("updated_ms < 50000"), o.where("id % 10 = 0").select("id"))


@R.query("tier_park", f"WITH {_ORDERS} SELECT scope, count(*) AS n FROM o WHERE scope <> 's2' GROUP BY 1")
def parked(spark, sf_dir):
    """Two scopes leave, one comes back."""
    o = _orders(spark, sf_dir)
    hot, cold = L.park(o, o.limit(0), "s2")
    hot, cold = L.park(hot, cold, "s3")
    hot, cold = L.unpark(hot, cold, "s3")
    return hot.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@R.query("temporal_close", "SELECT o_orderkey AS id, o_orderkey % 90 AS valid_from, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 90 <= 50 AND (o_orderkey % 4 = 0 OR o_orderkey % 90 + 30 > 50) THEN 50 WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 90 + 30 END AS valid_to FROM orders")
def close(spark, sf_dir):
    k = F.col("o_orderkey")
    facts = table(spark, sf_dir, "orders").select(k.alias("id"), "o_orderstatus", (k % 90).alias("valid_from"), F.when(k % 4 != 0, k % 90 + 30).alias("valid_to"))
    return L.close_interval(facts, F.col("o_orderstatus") == "F", 50).select("id", "valid_from", "valid_to")


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "delete").otherwise("write").alias("kind"), (F.col("event_id") * 31 % 257).alias("key"), "value")


@R.query("log_read_after", "SELECT event_id AS seq FROM events WHERE event_id > 700 AND event_id % 11 = 0 ORDER BY event_id LIMIT 20")
def read_after(spark, sf_dir):
    return L.read_log(_log(spark, sf_dir), 700, 20, ["delete"]).select("seq")


@R.query("log_replay", "SELECT event_id * 31 % 257 AS key, max(event_id) AS seq FROM events GROUP BY 1 HAVING max(event_id) % 11 <> 0")
def replayed(spark, sf_dir):
    return L.replay(_log(spark, sf_dir), "key").select("key", "seq")


@R.query("vector_candidate_policy", """
SELECT vec_id AS id FROM embeddings WHERE 's' || vec_id % 4 IN ('s1', 's2') AND label IN (1, 3, 5) AND vec_id % 10 / 10.0::DOUBLE >= 0.3 AND vec_id % 100 >= 20
""")
def policy(spark, sf_dir):
    k = F.col("id")
    p = points(spark, sf_dir).select("id", F.concat(F.lit("s"), k % 4).alias("scope"), F.array(F.col("label").cast("string")).alias("labels"), (k % 10 / 10.0).alias("trust"), (k % 100).alias("updated_ms"))
    return p.where(L.allowed({"scope": ["s1", "s2"], "labels": ["1", "3", "5"], "least_trust": 0.3, "since_ms": 20})).select("id")


@R.query("vector_search_across", """
SELECT id, round(d, 6) AS distance FROM (SELECT vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS d FROM embeddings WHERE label IN (1, 2, 4)) ORDER BY d, id LIMIT 12
""")
def across(spark, sf_dir):
    """The nearest of three labels, each searched for itself."""
    p = points(spark, sf_dir)
    q = list(p.where("id = 0").first()["vector"])
    return L.across([knn(p.where(F.col("label") == x), q, 12) for x in (1, 2, 4)], 12).select("id", F.abs(F.round("distance", 6)).alias("distance"))


@R.query("spatial_place_time_label", """
SELECT id FROM (SELECT c_custkey AS id, (c_custkey * 37 % 1200) / 10.0::DOUBLE - 60 AS lat, (c_custkey * 53 % 3400) / 10.0::DOUBLE - 170 AS lon, c_custkey % 4 AS l, c_custkey % 40 AS s, c_custkey % 40 + 15 AS e, c_custkey % 6 AS open FROM customer)
WHERE lat BETWEEN -30 AND 45 AND (lon >= 100 OR lon <= -60) AND l = 1 AND s <= 30 AND (open = 0 OR e >= 20)
""")
def place_time(spark, sf_dir):
    k = F.col("id")
    rows = places(spark, sf_dir).withColumn("labels", F.array(F.concat(F.lit("l"), k % 4))).withColumn("start", k % 40).withColumn("stop", F.when(k % 6 != 0, k % 40 + 15))
    return L.place_time_label(rows, (-30.0, 100.0, 45.0, -60.0), "l1", 20, 30).select("id")


@R.query("postings_common_values", "SELECT DISTINCT o_custkey::VARCHAR AS value FROM orders WHERE o_custkey IN (SELECT l_suppkey FROM lineitem) AND o_custkey IN (SELECT s_suppkey FROM supplier)")
def common(spark, sf_dir):
    sides = {"a": ("orders", "o_custkey"), "b": ("lineitem", "l_suppkey"), "c": ("supplier", "s_suppkey")}
    facts = [table(spark, sf_dir, t).select(F.lit(f).alias("field"), F.col(c).cast("string").alias("value")) for f, (t, c) in sides.items()]
    return L.common_values(facts[0].unionByName(facts[1]).unionByName(facts[2]), ["a", "b", "c"])


@R.query("replica_merge_rules", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'A' WHEN c_custkey % 3 = 0 THEN 'B' WHEN c_custkey % 7 > c_custkey % 5 THEN 'A' ELSE 'B' END AS v,
  CASE WHEN c_custkey % 4 = 0 THEN [1, 2] WHEN c_custkey % 3 = 0 THEN [2, 3] ELSE [1, 2, 3] END AS tags,
  CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 5 END + CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 7 END AS n FROM customer WHERE c_custkey % 12 <> 0
""")
def merged(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))

    def replica(skip: int, v: str, clock: int, tags: list[int], n: int):
        return c.where(F.col("id") % skip != 0).select("id", F.lit(v).alias("v"), (F.col("id") % clock).alias("v_t"), F.array(*map(F.lit, tags)).alias("tags"), F.lit(n).alias("n"))

    return L.merge_fields(replica(3, "A", 7, [1, 2], 5), replica(4, "B", 5, [2, 3], 7), "id", {"v": "lww", "tags": "union", "n": "sum"}).select("id", "v", "tags", "n")


@R.query("rule_contrast_pairs", """
WITH c AS (SELECT o_orderkey AS id, o_custkey AS topic, o_orderstatus AS stance, 1 + o_orderkey % 9 AS w FROM orders),
p AS (SELECT a.id AS a, b.id AS b, a.w * b.w AS score, row_number() OVER (PARTITION BY a.id ORDER BY a.w * b.w DESC, b.id) AS k FROM c a JOIN c b ON a.topic = b.topic AND a.stance <> b.stance AND a.id < b.id)
SELECT a, b, score FROM p WHERE k <= 2
""")
def contrast(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("topic"), F.col("o_orderstatus").alias("stance"), (1 + F.col("o_orderkey") % 9).alias("weight"))
    return L.contrast_pairs(o, 2)


@R.query("crawl_robots", """
WITH p AS (SELECT url, lower(regexp_extract(url, '://([^/]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '://[^/]*(/.*)$', 1), ''), '/') AS path FROM pages)
SELECT DISTINCT url, CASE WHEN starts_with(host, 'www') THEN CASE WHEN starts_with(path, '/t') AND NOT starts_with(path, '/th') THEN 'disallow' ELSE 'allow' END
  ELSE CASE WHEN starts_with(path, '/a') THEN 'disallow' ELSE 'allow' END END AS decision, CASE WHEN starts_with(host, 'www') THEN 2.0::DOUBLE END AS delay FROM p
""")
def robots(spark, sf_dir):
    url = F.col("url")
    path = F.regexp_extract(url, "://[^/]*(/.*)$", 1)
    pages = table(spark, sf_dir, "pages").select("url", F.lower(F.regexp_extract(url, "://([^/]*)", 1)).alias("host"), F.when(path == "", "/").otherwise(path).alias("path")).distinct()
    hosts = pages.select("host").distinct()
    own = F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(k).alias("kind"), F.lit(v).alias("value")) for a, k, v in (("Bot", "disallow", "/t"), ("Bot", "allow", "/th"), ("Bot", "delay", "2"), ("*", "disallow", "/"))])
    rest = F.array(*[F.struct(F.lit("*").alias("agent"), F.lit("disallow").alias("kind"), F.lit(v).alias("value")) for v in ("/a", "")])
    rules = hosts.select("host", F.inline(F.when(F.startswith("host", F.lit("www")), own).otherwise(rest)))
    return L.robots(rules, pages, "bot")


@R.query("ingest_virtual_fields", "SELECT p_partkey AS id, p_name AS copied, lower(p_brand) AS lowered, string_split(p_name, ' ')[2] AS second, CASE p_brand WHEN 'Brand#11' THEN 'first' ELSE p_brand END AS known FROM part")
def virtual(spark, sf_dir):
    name, brand = F.col("p_name"), F.col("p_brand")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), L.virtual_field(name, "copy").alias("copied"), L.virtual_field(brand, "lowercase").alias("lowered"), L.virtual_field(name, "split", " ", 1).alias("second"),
        L.resolve_alias(brand, {"Brand#11": "first"}).alias("known"),
    )


QUERIES, ORACLE_SQL = R.queries, R.oracle
