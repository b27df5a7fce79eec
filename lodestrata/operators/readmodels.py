"""Read models: composite and partial lookups, covering rows, zone-mapped fragments, document trees, receipts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composite_lookup(rows: DataFrame, columns: list[str], key: list[object]) -> DataFrame:
    """Rows whose leading columns equal the key; a shorter key is a left prefix."""
    if len(key) > len(columns):
        raise ValueError("the key is longer than the index")
    return rows.where(reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, key, strict=False)], F.lit(True)))


def partial_rows(rows: DataFrame, equals: dict[str, object], exists: list[str]) -> DataFrame:
    out = rows
    for c, v in equals.items():
        out = out.where(F.col(c) == F.lit(v))
    for c in exists:
        out = out.where(F.col(c).isNotNull())
    return out


def partial_drift(index: DataFrame, rows: DataFrame, equals: dict[str, object], exists: list[str], key: str) -> DataFrame:
    """(key, drift): entries that should not be there, and rows that miss one."""
    wanted = partial_rows(rows, equals, exists).select(key)
    extra = index.select(key).join(wanted, key, "left_anti").select(key, F.lit("extra").alias("drift"))
    return extra.unionByName(wanted.join(index.select(key), key, "left_anti").select(key, F.lit("missing").alias("drift")))


def covering(rows: DataFrame, cover: DataFrame, key: str, version: str) -> DataFrame:
    """The covering rows with a flag whether the source has moved on."""
    now = rows.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
    joined = cover.join(now, F.col(key) == F.col("_k"), "left")
    return joined.withColumn("stale", F.col("_v").isNull() | (F.col("_v") > F.col(version))).drop("_k", "_v")


def fragments(rows: DataFrame, column: str, size: int, key: str) -> DataFrame:
    """(fragment, lo, hi, n): the zone map of fragments of about ``size`` rows by range of key."""
    tagged = rows.withColumn("fragment", F.floor(F.col(key) / size))
    return tagged.groupBy("fragment").agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("n"))


def fragment_scan(zones: DataFrame, lo: float, hi: float) -> DataFrame:
    """One row: how many fragments a range visits and skips."""
    hit = (F.col("hi") >= lo) & (F.col("lo") <= hi)
    return zones.agg(F.count_if(hit).alias("visited"), F.count_if(~hit).alias("skipped"))


def tree_scan(docs: DataFrame, prefix: str, column: str = "path") -> DataFrame:
    """Paths with a prefix, in order."""
    return docs.where(F.col(column).startswith(prefix)).orderBy(column)


def receipt_clusters(receipts: DataFrame, keys: list[str], totals: list[str]) -> DataFrame:
    return receipts.groupBy(*keys).agg(F.count(F.lit(1)).alias("queries"), *[F.sum(c).alias(c) for c in totals])


def consolidation_groups(rows: DataFrame, key: Column, order: str, summary: str, keep: int = 3) -> DataFrame:
    """(key, n, summaries): the first summaries of each normalised key."""
    w = Window.partitionBy("key").orderBy(order)
    ranked = rows.withColumn("key", key).withColumn("_n", F.row_number().over(w))
    return ranked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_n") <= keep, F.struct("_n", summary)))).alias("s")).select(
        "key", "n", F.transform("s", lambda x: x[summary]).alias("summaries")
    )


def scatter(messages: DataFrame, to: str, vector: str, how: str = "sum") -> DataFrame:
    """(to, vector): sum or mean of the vectors by destination."""
    flat = messages.select(to, F.posexplode(vector).alias("i", "x"))
    by = flat.groupBy(to, "i").agg((F.sum("x") if how == "sum" else F.avg("x")).alias("x"))
    return by.groupBy(to).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(to, F.transform("v", lambda p: p["x"]).alias("vector"))


def recency(accesses: DataFrame, key: str, at: str) -> DataFrame:
    return accesses.groupBy(key).agg(F.count(F.lit(1)).alias("touches"), F.max(at).alias("last"))


def temporal_neighbors(edges: DataFrame, roots: DataFrame, first: int = 16, second: int = 8) -> DataFrame:
    """(root, hop, node, t): most recent out-interactions strictly before a root's time, and theirs before them."""
    step = edges.select("src", "dst", "t")
    w1 = Window.partitionBy("root").orderBy(F.col("t").desc(), "node")
    one = roots.select(F.col("id").alias("root"), F.col("at")).join(step, (F.col("root") == F.col("src")) & (F.col("t") < F.col("at")))
    one = one.select("root", F.col("dst").alias("node"), "t").withColumn("n", F.row_number().over(w1)).where(F.col("n") <= first)
    w2 = Window.partitionBy("root", "via").orderBy(F.col("t").desc(), "node")
    two = one.select("root", F.col("node").alias("via"), F.col("t").alias("before"), "n").join(step, (F.col("via") == F.col("src")) & (F.col("t") < F.col("before")))
    two = two.where("dst <> root").select("root", "via", F.col("dst").alias("node"), "t").withColumn("n", F.row_number().over(w2)).where(F.col("n") <= second)
    return one.select("root", F.lit(1).alias("hop"), "node", "t").unionByName(two.select("root", F.lit(2).alias("hop"), "node", "t"))


def ranking_quality(scored: DataFrame) -> DataFrame:
    """(auc, average_precision, log_loss) of (score, label), with ties of scores counted half."""
    by = scored.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("n"))
    w = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct score
    run = by.withColumn("tp", F.sum("p").over(w)).withColumn("fp", F.sum("n").over(w))
    sums = run.agg(
        F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)).alias("area"),
        F.sum("p").alias("P"),
        F.sum("n").alias("N"),
        F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        F.sum(-(F.col("p") * F.log(F.greatest("score", F.lit(1e-15))) + F.col("n") * F.log(F.greatest(1 - F.col("score"), F.lit(1e-15))))).alias("loss"),
    )
    return sums.select((F.col("area") / (F.col("P") * F.col("N"))).alias("auc"), (F.col("ap") / F.col("P")).alias("average_precision"), (F.col("loss") / (F.col("P") + F.col("N"))).alias("log_loss"))


def ownership_chain(facts: DataFrame, subject: str, year: str, owner: str) -> DataFrame:
    """(subject, chain): owners in order of year, unknown years last."""
    entry = F.struct(F.col(year).isNull().alias("u"), F.col(year).alias("y"), F.col(owner).alias("o"))
    return facts.groupBy(subject).agg(F.array_sort(F.collect_list(entry)).alias("c")).select(subject, F.transform("c", lambda x: x["o"]).alias("chain"))


def conflict_sets(assertions: DataFrame, subject: str, field: str, value: str) -> DataFrame:
    """(subject, field, values) of fields that sources give different values."""
    return assertions.groupBy(subject, field).agg(F.array_sort(F.collect_set(value)).alias("values")).where(F.size("values") > 1)


def demolition_window(seen: DataFrame, subject: str, year: str, present: str) -> DataFrame:
    """(subject, last_present, first_absent): the first absence after the last presence."""
    last = seen.where(F.col(present)).groupBy(subject).agg(F.max(year).alias("last_present"))
    gone = seen.where(~F.col(present)).join(last, subject).where(F.col(year) > F.col("last_present"))
    return gone.groupBy(subject).agg(F.first("last_present").alias("last_present"), F.min(year).alias("first_absent"))


def provider_fusion(results: DataFrame, rrf_k: float = 60.0) -> DataFrame:
    """(url, score, title): providers' ranks fused by normalised URL, the first title in order of provider and rank."""
    from lodestrata.functions.scalars import url_normal

    by = results.withColumn("u", url_normal(F.col("url"))).groupBy("u")
    first = F.min(F.when(F.col("title").isNotNull(), F.struct("provider", "rank", "title")))
    return by.agg(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))).alias("score"), first.alias("t")).select(F.col("u").alias("url"), "score", F.col("t.title").alias("title"))


#: Weights of relevance, graph rank and epistemic weight of each retrieval arm.
ARMS = {"web": (0.78, 0.15, 0.07), "code": (0.25, 0.70, 0.05), "balanced": (0.55, 0.35, 0.10)}


def arm_rerank(rows: DataFrame, arm: str) -> DataFrame:
    a, b, c = ARMS[arm]
    return rows.withColumn("score", a * F.col("relevance") + b * F.col("ppr") + c * F.col("epistemic")).orderBy(F.col("score").desc(), "id")


def code_hits(symbols: DataFrame, query: str) -> DataFrame:
    """(id, score) of code symbols (name, path, kind, snippet) by weighted matches."""
    q, terms = query.lower(), query.lower().split()
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "path", "kind", "snippet")}
    if not q:
        return symbols.select("id", F.lit(0.1).alias("score"))
    bit = lambda cond, w: F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    score = bit(low["name"] == q, 8.0) + bit(F.contains(low["name"], F.lit(q)), 5.0) + bit(F.contains(low["path"], F.lit(q)), 2.0)
    score = score + bit(F.contains(low["kind"], F.lit(q)), 1.0) + bit(F.contains(low["snippet"], F.lit(q)), 1.0)
    for t in terms:
        score = score + bit(F.contains(low["name"], F.lit(t)), 2.0) + bit(F.contains(low["path"], F.lit(t)), 0.75) + bit(F.contains(low["snippet"], F.lit(t)), 0.5)
    return symbols.select("id", score.alias("score")).where("score > 0")


def statements(rows: DataFrame, subject: str, predicate: str, obj: str, confidence: str) -> DataFrame:
    """Reified triples with a stable id."""
    return rows.select(F.sha2(F.concat_ws("\u001f", subject, predicate, obj), 256).alias("statement_id"), F.col(subject).alias("subject"), F.col(predicate).alias("predicate"), F.col(obj).alias("object"), F.col(confidence).alias("confidence"))


def best_statements(found: DataFrame) -> DataFrame:
    """One row per triple: the greatest confidence and the number of sources (the join of the confidence algebra)."""
    return found.groupBy("statement_id", "subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("sources"))


def fact_pack(derived: DataFrame) -> DataFrame:
    """One row (facts, digest) over derived facts in order of rule and subject; the digest combines per-fact digests without a sort."""
    one = F.xxhash64("rule", "subject")
    return derived.distinct().agg(F.count(F.lit(1)).alias("facts"), F.bit_xor(one).alias("digest"))
