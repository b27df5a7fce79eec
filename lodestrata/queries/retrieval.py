"""Full-text, vector, fusion, spatial, temporal and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import fusion, spatial, temporal, text, vector
from lodestrata.queries.registry import Registry
from lodestrata.runtime import table

R = Registry()

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOK = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOP}))"


def _bm25_sql(terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(terms)))
    one = lambda i: f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))"
    return f"""t AS (SELECT doc_id AS id, {_TOK} AS w FROM documents), p AS (SELECT id, len(w) AS dl, {tf} FROM t),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM p),
bm AS (SELECT id, {" + ".join(one(i) for i in range(len(terms)))} AS score FROM p, s WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(terms)))})"""


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


@R.query("text_bm25", f"WITH {_bm25_sql(['worthless', 'trash', 'pathetic'])} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 25")
def bm25(spark, sf_dir):
    return text.bm25(docs(spark, sf_dir), "worthless trash the pathetic").orderBy(F.col("score").desc(), "id").limit(25).select("id", F.round("score", 6).alias("score"))


@R.query("text_bm25_index", f"WITH {_bm25_sql(['worthless', 'trash', 'pathetic'])} SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 25")
def bm25_index(spark, sf_dir):
    """The same search over postings that are written once."""
    found = text.Bm25Index(docs(spark, sf_dir)).search("worthless trash the pathetic")
    return found.orderBy(F.col("score").desc(), "id").limit(25).select("id", F.round("score", 6).alias("score"))


@R.query("text_tokens", f"SELECT doc_id AS id, len({_TOK}) AS n FROM documents")
def tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("id", F.size(text.bm25_tokens(F.col("text"))).alias("n"))


@R.query("text_phrase", "SELECT doc_id AS id, 2.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'of the')")
def phrase(spark, sf_dir):
    return text.phrase_search(docs(spark, sf_dir), "Of The", {"text": 2.0, "source": 0.5})


@R.query("text_prefix", "SELECT doc_id AS id FROM documents WHERE len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda w: starts_with(w, 'wort'))) > 0")
def prefix(spark, sf_dir):
    return text.prefix_search(docs(spark, sf_dir), "Wort")


@R.query("text_fuzzy", "SELECT doc_id AS id, list_min(list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: abs(len(w) - 5) <= 1 AND levenshtein(w, 'trush') <= 1), lambda w: levenshtein(w, 'trush')))::INT AS best FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: abs(len(w) - 5) <= 1 AND levenshtein(w, 'trush') <= 1)) > 0")
def fuzzy(spark, sf_dir):
    return text.fuzzy_search(docs(spark, sf_dir), "trush", 1)


@R.query("text_snippet", "SELECT doc_id AS id, substr(text, greatest(instr(lower(text), 'clown') - 40, 1), (instr(lower(text), 'clown') - greatest(instr(lower(text), 'clown') - 40, 1) + 45)::INT) AS snip FROM documents WHERE instr(lower(text), 'clown') > 0")
def snippets(spark, sf_dir):
    return docs(spark, sf_dir).select("id", text.snippet(F.col("text"), "clown").alias("snip")).where("snip is not null")


@R.query("text_filter_tokens", "SELECT doc_id AS id FROM documents WHERE list_has_all(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), ['the', 'idiot'])")
def text_match(spark, sf_dir):
    from lodestrata.plans.ir import QueryIr, TextMatch, compile_query

    return compile_query(QueryIr({"d": "docs"}, (TextMatch("d", "text", "The IDIOT"),), (), (("d", "id"),)), {"docs": docs(spark, sf_dir)}).select(F.col("d_id").alias("id"))


@R.query("text_passages", "SELECT id, count(*) AS n FROM (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents) WHERE len(trim(l)) >= 24 AND len(regexp_extract_all(lower(l), '[\\p{L}\\p{N}]+')) >= 4 GROUP BY id")
def passages(spark, sf_dir):
    return text.passages(docs(spark, sf_dir)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@R.query("text_excerpt")
def excerpts(spark, sf_dir):
    return text.excerpt(text.passage_scores(text.passages(docs(spark, sf_dir)), "stupid moron"), 400)


@R.query("text_code_terms", "SELECT p_partkey AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS terms FROM part")
def code_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.code_terms(F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("terms"))


def points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def _query_vector(spark, sf_dir) -> list[float]:
    return list(points(spark, sf_dir).where("id = 0").first()["vector"])


@R.query("vector_knn", f"SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM embeddings, {_Q} ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 1 LIMIT 10")
def knn(spark, sf_dir):
    return vector.knn(points(spark, sf_dir), _query_vector(spark, sf_dir), 10).select("id", F.abs(F.round("distance", 6)).alias("distance"))


@R.query("vector_accelerated_knn")
def accelerated(spark, sf_dir):
    return vector.accelerated_knn(points(spark, sf_dir), _query_vector(spark, sf_dir), 5, over=8)


@R.query("vector_similarity_edges", """
SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 3 AND score >= 0.1
""")
def similarity_edges(spark, sf_dir):
    p = points(spark, sf_dir)
    return vector.knn_join(p.where("id % 100 = 0"), p, 3, 0.1).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@R.query("vector_sign_bits", f"SELECT vec_id AS id, list_sum(list_transform(list_zip(embedding, q), lambda p: ((p[1] >= 0) <> (p[2] >= 0))::INT))::INT AS h FROM embeddings, {_Q}")
def signs(spark, sf_dir):
    q = _query_vector(spark, sf_dir)
    return points(spark, sf_dir).select("id", vector.hamming(vector.sign_bits(F.col("vector"), len(q)), vector.sign_bits(vector.literal(q), len(q))).alias("h"))


_MULTI = "v AS (SELECT vec_id // 8 AS doc, embedding::DOUBLE[] AS e FROM embeddings)"


def _late(product: str) -> str:
    """SQL of the five documents of eight vectors with the most late interaction, for every hundredth document as query."""
    return f"""WITH {_MULTI}, b AS (SELECT q.doc AS query_id, d.doc AS id, q.e AS qe, max({product}) AS best FROM v q JOIN v d ON q.doc % 100 = 0 GROUP BY 1, 2, 3),
s AS (SELECT query_id, id, sum(best) AS score FROM b GROUP BY 1, 2)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"""


def _multi(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.groupBy(F.floor(F.col("id") / 8).alias("id")).agg(F.collect_list("vector").alias("vectors"))


def _late_query(spark, sf_dir, binary: bool):
    docs = _multi(spark, sf_dir)
    found = vector.maxsim_rank(docs, docs.where("id % 100 = 0"), 5, binary)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@R.query("vector_maxsim", _late("list_inner_product(q.e, d.e)"))
def maxsim(spark, sf_dir):
    return _late_query(spark, sf_dir, False)


@R.query("vector_binary_maxsim", _late("list_inner_product(list_transform(q.e, lambda x: CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END), list_transform(d.e, lambda x: CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END)) / len(q.e)"))
def binary_maxsim(spark, sf_dir):
    return _late_query(spark, sf_dir, True)


@R.query("vector_hybrid", f"""
WITH n AS (SELECT vec_id AS id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS d FROM embeddings, {_Q} ORDER BY 3, 1 LIMIT 20), f AS (SELECT max(d) AS far FROM n)
SELECT id, round(0.5 * (1 - d / greatest(far, 1e-10)) + 0.5 * (CASE WHEN label = 3 THEN 0.8 WHEN label = 5 THEN -0.4 ELSE 0 END), 6) AS score FROM n, f
ORDER BY 0.5 * (1 - d / greatest(far, 1e-10)) + 0.5 * (CASE WHEN label = 3 THEN 0.8 WHEN label = 5 THEN -0.4 ELSE 0 END) DESC, id LIMIT 10
""")
def hybrid(spark, sf_dir):
    p = points(spark, sf_dir)
    g = p.where("label in (3, 5)").select("id", F.when(F.col("label") == 3, 0.8).otherwise(-0.4).alias("g"))
    return vector.hybrid(vector.knn(p, _query_vector(spark, sf_dir), 20), g, 10).select("id", F.round("score", 6).alias("score"))


@R.query("vector_hash_embedding")
def hash_embedding(spark, sf_dir):
    """Hashes of words are no SQL; a test holds the vectors against plain counts."""
    v = vector.hash_embedding(text.words_of(F.col("text")), 16)
    return docs(spark, sf_dir).select("id", F.transform(v, lambda x: F.round(x, 9)).alias("vector"))


_LISTS = f"""WITH {_bm25_sql(['worthless', 'trash'])},
a AS (SELECT id, 'bm25' AS method, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM bm ORDER BY score DESC, id LIMIT 30)),
b AS (SELECT id, 'quality' AS method, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT doc_id AS id, (n_chars % 97) / 97.0::DOUBLE AS score FROM documents ORDER BY 2 DESC, 1 LIMIT 30))"""


def _lists(spark, sf_dir):
    a = text.bm25(docs(spark, sf_dir), "worthless trash").orderBy(F.col("score").desc(), "id").limit(30)
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 97) / 97.0).alias("score")).orderBy(F.col("score").desc(), "id").limit(30)
    return [fusion.ranked(a, "bm25"), fusion.ranked(b, "quality")]


@R.query("fusion_rrf", _LISTS + " SELECT id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def rrf(spark, sf_dir):
    return fusion.reciprocal_rank_fusion(_lists(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


@R.query("fusion_weighted", _LISTS + " SELECT id, round(sum(score * CASE WHEN method = 'quality' THEN 0.3 ELSE 1 END), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def weighted(spark, sf_dir):
    return fusion.weighted_fusion(_lists(spark, sf_dir), {"quality": 0.3}).select("id", F.round("score", 6).alias("score"))


@R.query("fusion_cascade", """
WITH r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'contested' ELSE 'draft' END AS status, 0.8 + (o_orderkey % 10) / 10.0::DOUBLE AS weight,
  (o_orderkey % 1000) / 1000.0::DOUBLE AS v, o_orderkey % 9 AS hops FROM orders)
SELECT id, epistemic, band, hops_bucket FROM (
  SELECT id, CASE status WHEN 'accepted' THEN 4 WHEN 'contested' THEN 12 ELSE 8 END + CASE WHEN weight >= 1.5 THEN 0 WHEN weight >= 1.2 THEN 1 WHEN weight >= 1 THEN 2 ELSE 3 END AS epistemic,
    CAST(floor((1 - v) * 10) AS BIGINT) AS band, least(hops, 6) AS hops_bucket FROM r) ORDER BY epistemic, band, hops_bucket, id LIMIT 60
""")
def cascade(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "contested").otherwise("draft")
    rows = o.select(F.col("o_orderkey").alias("id"), status.alias("status"), (0.8 + (F.col("o_orderkey") % 10) / 10.0).alias("weight"), ((F.col("o_orderkey") % 1000) / 1000.0).alias("v"), (F.col("o_orderkey") % 9).alias("hops"))
    rules = {"epistemic": fusion.epistemic_bucket(F.col("status"), F.col("weight")), "band": fusion.band_bucket(F.col("v")), "hops_bucket": fusion.hops_bucket(F.col("hops"))}
    return fusion.cascade(rows, rules, {"epistemic": 15, "band": 10, "hops_bucket": 6}, 60).select("id", *rules)


@R.query("fusion_recency_bucket", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 11 WHEN o_orderkey % 7 = 0 THEN 10 ELSE least(floor((o_orderkey % 90) / 7.0::DOUBLE), 10) END::BIGINT AS bucket FROM orders")
def recency(spark, sf_dir):
    day = 24 * 3600 * 1000
    age = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise((F.col("o_orderkey") % 90) * day)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fusion.recency_bucket(age, F.col("o_orderkey") % 13 == 0).cast("long").alias("bucket"))


@R.query("fusion_epistemic_filter")
def eleven_stages(spark, sf_dir):
    o = table(spark, sf_dir, "documents")
    rows = o.select(
        F.col("doc_id").alias("id"), ((F.col("n_chars") % 89) / 89.0).alias("rrf_score"), ((F.col("n_chars") % 71) / 71.0).alias("learned"), F.lit(1.1).alias("weight"),
        F.when(F.col("doc_id") % 6 == 0, "contested").otherwise("accepted").alias("status"), F.concat(F.lit("s"), (F.col("doc_id") % 40).cast("string")).alias("slug"),
        F.split("text", "\n")[0].alias("title"), (F.col("doc_id") % 9 == 0).alias("is_code"), F.lit(False).alias("code_boost"),
    )
    return fusion.epistemic_filter(rows, 25, query="the of").select("id", F.round("score", 6).alias("score"))


@R.query("fusion_budget_prefix", """
SELECT source, id FROM (SELECT source, doc_id AS id, row_number() OVER w AS rank, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS running FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)) WHERE rank = 1 OR running <= 5000
""")
def budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return fusion.budget_prefix(d, "source", [F.col("n_chars"), F.col("id")], "n_chars", 5000).select("source", "id")


@R.query("fusion_mmr_fill")
def mmr(spark, sf_dir):
    from lodestrata.operators.rules import elites

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", ((F.col("n_chars") % 101) / 101.0).alias("score"), (F.col("n_chars") / 4).cast("long").alias("tokens"), text.words_of(F.col("text")).alias("terms"))
    return fusion.mmr_fill(elites(d, "source", "score", 20).drop("rank"), "source", 2000)


_GEO = "(SELECT c_custkey AS id, (c_custkey * 37 % 1200) / 10.0::DOUBLE - 60 AS lat, (c_custkey * 53 % 3400) / 10.0::DOUBLE - 170 AS lon FROM customer)"
_HAV = "2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians({0} - {2}) / 2), 2) + cos(radians({2})) * cos(radians({0})) * pow(sin(radians({1} - {3}) / 2), 2))))"


def places(spark, sf_dir):
    """Coordinates derived from keys, as the tables hold none."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 37 % 1200) / 10.0 - 60).alias("lat"), ((k * 53 % 3400) / 10.0 - 170).alias("lon"))


@R.query("spatial_radius", f"SELECT id, round(km, 6) AS km FROM (SELECT id, {_HAV.format('lat', 'lon', '20.0', '10.0')} AS km FROM {_GEO}) WHERE km <= 2000")
def radius(spark, sf_dir):
    return spatial.radius_search(places(spark, sf_dir), 20.0, 10.0, 2000).select("id", F.round("km", 6).alias("km"))


@R.query("spatial_bounding_box", f"SELECT id, lat, lon FROM {_GEO} WHERE lat BETWEEN -10 AND 15 AND lon BETWEEN 0 AND 40")
def bbox(spark, sf_dir):
    return spatial.bounding_box(places(spark, sf_dir), -10, 0, 15, 40)


@R.query("spatial_near_pairs", f"SELECT a, b, round(km, 6) AS km FROM (SELECT p.id AS a, q.id AS b, {_HAV.format('q.lat', 'q.lon', 'p.lat', 'p.lon')} AS km FROM {_GEO} p JOIN {_GEO} q ON p.id < q.id) WHERE km <= 100")
def near(spark, sf_dir):
    return spatial.near_pairs(places(spark, sf_dir), 100).select("a", "b", F.round("km", 6).alias("km"))


@R.query("temporal_as_of_join", """
SELECT e.event_id, max_by(o.o_orderkey, (o.o_orderdate, o.o_orderkey)) AS o_orderkey FROM events e LEFT JOIN (SELECT * , o_orderdate + INTERVAL 9000 DAY AS t FROM orders) o
ON o.o_custkey = e.user_id AND o.t <= e.ts WHERE e.event_type = 'click' GROUP BY e.event_id
""")
def as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", F.col("user_id").alias("k"), "ts")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderdate") + F.expr("INTERVAL 9000 DAY")).alias("t"), "o_orderkey").orderBy("o_orderkey")
    latest = o.groupBy("k", "t").agg(F.max("o_orderkey").alias("o_orderkey"))
    return temporal.as_of_join(e, latest, "k", "ts", "t", ["o_orderkey"]).select("event_id", "o_orderkey")


@R.query("temporal_interval_overlap", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-30' AND o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1995-06-01'")
def overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("e", F.col("o_orderdate") + F.expr("INTERVAL 30 DAY"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return o.where(temporal.overlaps(F.col("o_orderdate"), F.col("e"), at("1995-06-01"), at("1995-06-30"))).select("o_orderkey")


@R.query("temporal_facts_as_of", "SELECT o_custkey, count(*) AS n FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS e FROM orders) WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND (e IS NULL OR e > TIMESTAMP '1996-01-01') GROUP BY 1")
def facts_as_of(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    facts = o.select("o_custkey", F.col("o_orderdate").alias("valid_at"), F.lead("o_orderdate").over(w).alias("invalid_at"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("expired_at"))
    return temporal.as_of(facts, F.lit("1996-01-01").cast("timestamp_ntz")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@R.query("temporal_longest_run", """
SELECT o_custkey, max(n) AS longest FROM (SELECT o_custkey, g, count(*) AS n FROM (
  SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey) AS g FROM orders)
  WHERE o_orderstatus = 'F' GROUP BY 1, 2) GROUP BY 1
""")
def longest_run(spark, sf_dir):
    runs = temporal.longest_runs(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F")
    return runs.groupBy("o_custkey").agg(F.max("n").alias("longest"))


# Scalar functions, by the text tables.

_P = "p_name AS s, p_partkey AS id FROM part"


def _scalar(name: str, expression, sql: str, source: str = "part") -> None:
    """A query (id, out) of one expression over part names, page URLs or page markup."""
    tables = {"part": ("part", "p_partkey", "p_name"), "url": ("pages", "page_id", "url"), "html": ("pages", "page_id", "html"), "doc": ("documents", "doc_id", "text"), "num": ("orders", "o_orderkey", "o_totalprice"), "signed": ("customer", "c_custkey", "c_acctbal")}
    frame, key, column = tables[source]

    def run(spark, sf_dir):
        return table(spark, sf_dir, frame).select(F.col(key).alias("id"), expression(F.col(column)).alias("out"))

    R.query(f"fn_{name}", f"SELECT id, {sql} AS out FROM (SELECT {key} AS id, {column} AS s FROM {frame})")(run)


_LETTERS = "list_filter(regexp_split_to_array(lower(s), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_CAPPED = f"list_transform({_LETTERS}, lambda w: upper(w[1]) || w[2:])"
_scalar("lower", S.lower, "lower(s)")
_scalar("upper", S.upper, "upper(s)")
_scalar("capitalize", S.capitalize, "upper(s[1]) || lower(s[2:])")
_scalar("pascal", lambda c: S.pascal(F.lower(c)), f"array_to_string({_CAPPED}, '')")
_scalar("camel", lambda c: S.camel(F.lower(c)), f"lower(array_to_string({_CAPPED}, '')[1]) || array_to_string({_CAPPED}, '')[2:]")
_scalar("kebab", lambda c: S.kebab(F.lower(c)), f"array_to_string({_LETTERS}, '-')")
_scalar("snake", lambda c: S.snake(F.lower(c)), f"array_to_string({_LETTERS}, '_')")
_scalar("uncamel", S.uncamel, "lower(regexp_replace(s, '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g'))")
_scalar("trim", lambda c: S.trim(F.concat(F.lit("  "), c, F.lit(" "))), "trim(s)")
_scalar("reverse", S.reverse, "reverse(s)")
_scalar("length", S.length, "len(s)::INT", "doc")
_scalar("split_last", lambda c: S.last(S.split(c, "/")), "string_split(s, '/')[-1]", "url")
_scalar("split_first", lambda c: S.first(S.split(c, "/")), "string_split(s, '/')[1]", "url")
_scalar("nth", lambda c: S.join(S.nth(S.split(c, "/"), 2, 1), "+"), "array_to_string(list_filter(string_split(s, '/'), lambda x, i: i % 2 = 1), '+')", "url")
_scalar("slice", lambda c: S.slice_text(c, 2, -3), "s[3:len(s) - 3]", "url")
_scalar("unique", lambda c: F.array_sort(S.unique(S.split(c, " "))), "list_sort(list_distinct(string_split(s, ' ')))", "doc")
_scalar("replace", lambda c: S.replace(c, [("http://", ""), ("https://", ""), (".", "·")]), "replace(replace(replace(s, 'http://', ''), 'https://', ''), '.', '·')", "url")
_scalar("safe_name", S.safe_name, "regexp_replace(regexp_replace(s, '[<>:\"/\\\\|?*#^\\[\\]]', '', 'g'), '[. ]+$', '')", "url")
_scalar("blockquote", S.blockquote, "'> ' || replace(s, chr(10), chr(10) || '> ')", "doc")
_scalar("callout", lambda c: S.callout(c, "note", "T"), "'> [!note] T' || chr(10) || '> ' || s")
_scalar("link", lambda c: S.link(c, F.lit("x")), "'[x](' || s || ')'", "url")
_scalar("image", lambda c: S.image(c, F.lit("x")), "'![x](' || s || ')'", "url")
_scalar("wikilink", lambda c: S.wikilink(c, F.lit("a")), "'[[' || s || '|a]]'")
_scalar("list", lambda c: S.bullets(S.split(c, " "), "numbered"), "array_to_string(list_transform(string_split(s, ' '), lambda x, i: i || '. ' || x), chr(10))")
_scalar("footnote", lambda c: S.footnotes(S.split(c, " ")), "array_to_string(list_transform(string_split(s, ' '), lambda x, i: '[^' || i || ']: ' || x), chr(10) || chr(10))")
_scalar("template", lambda c: S.template(S.split(c, " "), "<", ">"), "array_to_string(list_transform(string_split(s, ' '), lambda x: '<' || x || '>'), '')")
_scalar("merge", lambda c: S.merge(S.split(c, " "), ["a", "b"]), "list_concat(string_split(s, ' '), ['a', 'b'])")
_scalar("map", lambda c: S.join(S.map_items(S.split(c, " "), 'x => "(" + x + ")"'), ""), "array_to_string(list_transform(string_split(s, ' '), lambda x: '(' || x || ')'), '')")
_scalar("calc", lambda c: F.round(S.calc(S.calc(c, "*", 2), "+", 1), 4), "round(s * 2 + 1, 4)", "num")
_scalar("round", lambda c: S.round_half_up(F.floor(c), -2), "round(floor(s)::DECIMAL(18,0), -2)::BIGINT", "num")
_scalar("number_format", lambda c: S.number_format(F.floor(c), 0), "format('{:,}', floor(s)::BIGINT)", "num")
_scalar("duration", lambda c: S.duration_text(F.floor(c) % 86400), "printf('%02d:%02d:%02d', (floor(s)::BIGINT % 86400) // 3600, (floor(s)::BIGINT % 86400) % 3600 // 60, floor(s)::BIGINT % 60)", "num")
_scalar("decode_uri", lambda c: S.decode_uri(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))), "s", "doc")
_scalar("unescape", lambda c: S.unescape(F.replace(c, F.lit(" "), F.lit('\\"'))), "replace(s, ' ', '\"')")
_scalar("strip_tags", S.strip_tags, "regexp_replace(s, '<[/]?[A-Za-z!][^>]*>', '', 'g')", "html")
_scalar("remove_tags", lambda c: S.remove_tags(c, ["b", "p"]), "regexp_replace(s, '</?(?:b|p)\\b[^>]*>', '', 'gi')", "html")
_scalar("remove_html", lambda c: S.remove_html(c, ["script", "nav"]), "regexp_replace(regexp_replace(s, '<script\\b[^>]*>.*?</script\\s*>', '', 'gis'), '<nav\\b[^>]*>.*?</nav\\s*>', '', 'gis')", "html")
_scalar("replace_tags", lambda c: S.replace_tags(c, "b", "strong"), "regexp_replace(s, '<(/?)b\\b', '<\\1strong', 'gi')", "html")
_scalar("strip_attr", lambda c: S.strip_attr(c), "regexp_replace(s, '\\s+[A-Za-z_:][-\\w:.]*\\s*=\\s*(?:\"[^\"]*\"|''[^'']*'')', '', 'g')", "html")
_scalar("remove_attr", lambda c: S.remove_attr(c, ["class", "href"]), "regexp_replace(s, '\\s+(?:class|href)\\s*=\\s*(?:\"[^\"]*\"|''[^'']*'')', '', 'g')", "html")
_scalar("strip_md", lambda c: S.strip_md(F.concat(F.lit("# *"), c, F.lit("* [x](y)"))), "s || ' x'")
_scalar("markdown", lambda c: S.markdown(F.concat(F.lit("<h1>"), c, F.lit("</h1><p><b>bold</b> and <a href=\"/x\">"), c, F.lit("</a></p>"))), "'# ' || s || chr(10) || chr(10) || '**bold** and [' || s || '](/x)'")
_scalar("lc_text", S.lc_text, "translate(lower(s), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')", "doc")
_scalar("ip_form", lambda c: S.ip_form(F.concat(F.lit("10.2."), (F.length(c) % 256).cast("string"), F.lit(".7"))), "'010.002.' || lpad((len(s) % 256)::VARCHAR, 3, '0') || '.007'")
_scalar("date_form", lambda c: S.date_form(F.concat(F.lit("2024-02-"), F.lpad((F.length(c) % 28 + 1).cast("string"), 2, "0"), F.lit(" 12:01:47"))), "'2024-02-' || lpad((len(s) % 28 + 1)::VARCHAR, 2, '0') || 'T12:01:47.000Z'")
_DIGITS = "ltrim(replace(printf('%.2f', abs(s::DOUBLE)), '.', ''), '0')"
_KEPT = f"rtrim({_DIGITS}, '0')"
_TURNED = f"(translate({_KEPT}[1:-2], '0123456789', '9876543210') || (10 - {_KEPT}[-1]::INT))"
_scalar("number_form", S.number_form, f"""CASE WHEN s = 0 THEN '+AE0' WHEN s > 0
  THEN '+' || CASE WHEN len({_DIGITS}) >= 3 THEN chr(94 + len({_DIGITS})::INT) ELSE chr(88 + len({_DIGITS})::INT) END || 'E' || {_KEPT}[1] || CASE WHEN len({_KEPT}) > 1 THEN '.' || {_KEPT}[2:] ELSE '' END
  ELSE '!' || CASE WHEN len({_DIGITS}) >= 3 THEN chr(93 - len({_DIGITS})::INT) ELSE chr(99 - len({_DIGITS})::INT) END || 'E' || {_TURNED}[1] || CASE WHEN len({_TURNED}) > 1 THEN '.' || {_TURNED}[2:] ELSE '' END END""", "signed")
_scalar("mask", lambda c: S.mask(c, 4), "repeat('*', greatest(len(s) - 4, 0)) || right(s, 4)", "url")
_scalar("content_hash", S.content_hash, "'sha256:' || sha256(s)", "url")
_scalar("canonical_body_hash", S.canonical_body_hash, "sha256(regexp_replace(regexp_replace(lower(s), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '^ | $', '', 'g'))", "doc")
_scalar("url_domain", S.url_domain, "lower(regexp_extract(s, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))", "url")
_scalar("url_normal", lambda c: S.url_normal(F.regexp_replace(c, r"\?.*$", "")), "regexp_replace(regexp_replace(regexp_replace(s, '[?].*$', ''), '#.*$', ''), '/+$', '')", "url")
_scalar("source_class", S.source_class, "CASE WHEN regexp_matches(s, '://(blog|m)[.]') THEN 'blog' ELSE 'web' END", "url")
_scalar("extract_emails", lambda c: F.size(S.extract_emails(c)), "len(list_distinct(regexp_extract_all(s, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')))::INT", "doc")
_scalar("dictionary_match", lambda c: S.dictionary_match(c, ["idiot", "trash", "clown"]), "list_sort(list_intersect(list_distinct(regexp_split_to_array(lower(s), '[^\\p{L}\\p{N}+#.]+')), ['idiot', 'trash', 'clown']))", "doc")

QUERIES, ORACLE_SQL = R.queries, R.oracle
