"""Stream, feed and ingest queries over ``events`` (token = event_id, stream = event_type, actor = user_id)."""

from __future__ import annotations


from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import ingest
from lodestrata.queries.registry import Registry
from lodestrata.runtime import shared_dir, table
from lodestrata.streaming import feeds

R = Registry()


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("token"),
        F.col("event_type").alias("stream"),
        F.col("user_id").alias("actor"),
        F.col("event_type").alias("kind"),
        "ts",
        "value",
        F.when(F.col("event_id") % 5 == 0, F.col("user_id") + 1).alias("target"),
        F.when(F.col("event_id") % 7 == 0, "ask").otherwise("info").alias("urgency"),
    )


@R.query("stream_read_after", "SELECT event_id AS token, event_type AS stream FROM events WHERE event_type = 'click' AND event_id > 50 OR event_type = 'view' ORDER BY token LIMIT 256")
def read_after(spark, sf_dir):
    cursors = spark.createDataFrame([(1, "click", 50)], "actor long, stream string, token long")
    subs = spark.createDataFrame([(1, "click"), (1, "view"), (2, "purchase")], "actor long, stream string")
    return feeds.read_after(events(spark, sf_dir), cursors, subs, 1).select("token", "stream")


@R.query("stream_advance", "SELECT 1::BIGINT AS actor, stream, max(token) AS token FROM (SELECT event_id AS token, event_type AS stream FROM events WHERE event_type = 'click' ORDER BY 1 LIMIT 256) GROUP BY stream")
def advance(spark, sf_dir):
    cursors = spark.createDataFrame([], "actor long, stream string, token long")
    subs = spark.createDataFrame([(1, "click")], "actor long, stream string")
    return feeds.advance(cursors, feeds.read_after(events(spark, sf_dir), cursors, subs, 1), 1)


@R.query("stream_mentions", "SELECT event_id AS token FROM events WHERE event_id % 5 = 0 AND user_id + 1 = 8 AND event_id > 20 ORDER BY 1 LIMIT 256")
def mentions(spark, sf_dir):
    return feeds.mentions(events(spark, sf_dir), 8, drained=20).select("token")


@R.query("stream_valid_publish", "SELECT count(*) AS n FROM events WHERE NOT (event_id % 7 = 0 AND event_id % 5 <> 0)")
def valid_publish(spark, sf_dir):
    return feeds.valid_publish(events(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@R.query("stream_retained", "SELECT event_type AS stream, count(*) AS n, min(event_id) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 100 GROUP BY 1")
def retained(spark, sf_dir):
    return feeds.retained(events(spark, sf_dir), 100).groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.min("token").alias("oldest"))


@R.query("stream_coalesce", "SELECT event_type AS kind, user_id AS id, max(event_id) AS token, list_sort(list_distinct(list('v' || (event_id % 3)))) AS changed, count(*) AS n FROM events GROUP BY 1, 2")
def coalesce(spark, sf_dir):
    e = events(spark, sf_dir).select("kind", F.col("actor").alias("id"), "token", F.array(F.concat(F.lit("v"), (F.col("token") % 3).cast("string"))).alias("changed"))
    return feeds.coalesce_changes(e)


@R.query("stream_matcher", "SELECT event_id AS token FROM events WHERE event_type IN ('click', 'purchase') AND event_id % 3 = 1")
def matcher(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("changed", F.array(F.concat(F.lit("v"), (F.col("token") % 3).cast("string"))))
    return e.where(feeds.matches(kinds=["click", "purchase"], changed=["v1"])).select("token")


@R.query("stream_load_shedding", "SELECT event_id AS token FROM events ORDER BY value DESC, event_id OFFSET 500")
def shedding(spark, sf_dir):
    return feeds.shed_load(events(spark, sf_dir), 500)[1].select("token")


@R.query("stream_log_ingest", "SELECT event_id AS token FROM events WHERE event_id % 4 = 0 AND event_id % 3 <> 0")
def log_ingest(spark, sf_dir):
    e = events(spark, sf_dir)
    remote = e.where("token % 4 = 0")
    return feeds.ingest_log(e.where("token % 3 = 0"), remote.unionByName(remote)).select("token")


_WINDOWS = "SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@R.query("stream_windows_batch", _WINDOWS)
def windows(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return feeds.windowed_counts(e, "ts", "1 hour", "1 hour", ["kind"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round("total", 4).alias("total"))


@R.query("stream_windows_streaming", _WINDOWS)
def windows_streaming(spark, sf_dir):
    """The same through Structured Streaming: the table as a file stream, complete windows at the end of input."""
    import uuid

    e = table(spark, sf_dir, "events")
    source = f"{shared_dir(spark)}/lodestrata/stream-{uuid.uuid4().hex}"
    e.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source + "/in")
    name = f"w_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(spark.read.parquet(source + "/in").schema).parquet(source + "/in").withColumn("kind", F.col("event_type"))
    counted = feeds.windowed_counts(stream, "ts", "1000000 hours", "1 hour", ["kind"])

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(source + "/out")

    query = counted.writeStream.outputMode("complete").queryName(name).option("checkpointLocation", source + "/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(source + "/out")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", F.round("total", 4).alias("total"))


def _facts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    forms = {"p_brand": S.lc_text(F.col("p_brand")), "p_type": S.lc_text(F.col("p_type")), "p_size": F.col("p_size")}
    return ingest.field_facts(p, "p_partkey", forms)


@R.query("ingest_field_facts", "SELECT p_partkey, 'p_brand' AS field, p_brand AS raw, lower(p_brand) AS normalized FROM part UNION ALL SELECT p_partkey, 'p_type', p_type, lower(p_type) FROM part UNION ALL SELECT p_partkey, 'p_size', p_size::VARCHAR, p_size::VARCHAR FROM part")
def facts(spark, sf_dir):
    return _facts(spark, sf_dir)


@R.query("ingest_data_dictionary", "SELECT 'p_brand' AS field, count(p_brand) AS n, count(DISTINCT lower(p_brand)) AS cardinality FROM part UNION ALL SELECT 'p_type', count(p_type), count(DISTINCT lower(p_type)) FROM part UNION ALL SELECT 'p_size', count(p_size), count(DISTINCT p_size) FROM part")
def dictionary(spark, sf_dir):
    return ingest.data_dictionary(_facts(spark, sf_dir))


@R.query("ingest_derived_edges", "SELECT DISTINCT lower(p_brand) AS from_id, lower(p_type) AS to_id, 'HAS_TYPE' AS type FROM part")
def derived(spark, sf_dir):
    return ingest.derive_edges(_facts(spark, sf_dir), "p_partkey", "p_brand", "p_type", "HAS_TYPE")


@R.query("ingest_json_props", "SELECT event_id, key AS field, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) WHERE json_extract_string(props, '$.' || key) IS NOT NULL")
def json_props(spark, sf_dir):
    return ingest.flatten_json(table(spark, sf_dir, "events"), "event_id", "props")


@R.query("ingest_jsonl_round_trip", "SELECT n_nationkey, n_name FROM nation")
def jsonl(spark, sf_dir):
    import uuid

    path = f"{shared_dir(spark)}/lodestrata/jsonl-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").write.json(path)
    return ingest.read_jsonl(spark, path, "n_nationkey int, n_name string", ["n_nationkey"])[0]


@R.query("ingest_polite_batch", "SELECT url FROM (SELECT url, row_number() OVER (PARTITION BY lower(regexp_extract(url, '://([^/:?#]*)', 1)) ORDER BY length(html) DESC, url) AS turn FROM pages) WHERE turn <= 1")
def polite(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", S.url_domain(F.col("url")).alias("domain"), F.length("html").alias("priority"))
    return ingest.polite_batch(p, 1, 1_000_000).select("url")


QUERIES, ORACLE_SQL = R.queries, R.oracle
