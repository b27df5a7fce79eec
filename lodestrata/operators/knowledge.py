"""Retrieval over knowledge graphs: filtered expansion, ranks from seeds, keyword search, proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.graph import bfs, personalized_pagerank
from lodestrata.operators.model import confidence, property_of, visible


def expand(edges: DataFrame, seeds: DataFrame, depth: int | None, direction: str = "out", least: float = 0.0, types: list[str] | None = None) -> DataFrame:
    """(id, depth): nodes within ``depth`` hops of the seeds over visible edges of enough confidence and, if named, of some types.

    ``direction`` is out, in or both; an edge without a confidence counts as 1.
    """
    live = visible(edges).where(confidence() >= least)
    live = live if types is None else live.where(F.col("type").isin(types))
    forward = live.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    back = live.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    steps = {"out": forward, "in": back, "both": forward.unionByName(back)}[direction]
    return bfs(steps.distinct(), seeds, depth)


def explain(edges: DataFrame, a: str, b: str) -> DataFrame:
    """All visible edges between two nodes, in either direction."""
    there = (F.col("from_id") == a) & (F.col("to_id") == b)
    back = (F.col("from_id") == b) & (F.col("to_id") == a)
    return visible(edges).where(there | back)


def filtered_ranks(edges: DataFrame, seeds: DataFrame, allowed: DataFrame, alpha: float = 0.15, epsilon: float = 1e-4) -> DataFrame:
    """(id, score): forward push in which only allowed nodes (id) seed or are reached."""
    ends = allowed.select("id").distinct()
    kept = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return personalized_pagerank(kept.select("src", "dst", "weight"), seeds.join(ends, "id", "left_semi"), alpha, epsilon)


def ranks_at(edges: DataFrame, seeds: DataFrame, at: int, alpha: float = 0.15, epsilon: float = 1e-4) -> DataFrame:
    """(id, score): forward push over edges (src, dst, weight, valid_from, valid_to) that hold at an instant; open ends are null."""
    begun = F.col("valid_from").isNull() | (F.col("valid_from") <= at)
    alive = F.col("valid_to").isNull() | (F.col("valid_to") > at)
    return personalized_pagerank(edges.where(begun & alive).select("src", "dst", "weight"), seeds, alpha, epsilon)


def related(edges: DataFrame, nodes: DataFrame, seed: str, label: str | None, k: int, epsilon: float = 1e-5) -> DataFrame:
    """(id, score): the nodes of a label that a push from one seed ranks highest, itself left out."""
    spark = nodes.sparkSession
    one = spark.range(1).select(F.lit(seed).alias("id"), F.lit(1.0).alias("weight"))
    ranks = personalized_pagerank(edges, one, epsilon=epsilon).where(F.col("id") != seed)
    kept = nodes if label is None else nodes.where(F.array_contains("labels", label))
    return ranks.join(kept.select("id"), "id", "left_semi").orderBy(F.col("score").desc(), "id").limit(k)


def keyword_search(nodes: DataFrame, text: str, names: list[str], k: int) -> DataFrame:
    """(id, score): nodes whose id or name holds the text (2 each), or another of the named properties (1 each)."""
    wanted = F.lit(text.lower())

    def hit(value: Column, weight: float) -> Column:
        return F.when(F.contains(F.lower(F.coalesce(value, F.lit(""))), wanted), F.lit(weight)).otherwise(F.lit(0.0))

    score = hit(F.col("id"), 2.0) + hit(property_of("name"), 2.0)
    for name in names:
        score = score + hit(property_of(name), 1.0)
    return visible(nodes).select("id", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), "id").limit(k)


def property_candidates(edges: DataFrame, properties: DataFrame, least: int) -> DataFrame:
    """(id, property, value, confidence): what enough neighbours of a node agree on and it lacks.

    edges: (src, dst); properties: (id, property, value).  Of each node and
    property the value of the greatest share of neighbours stays.
    """
    seen = edges.select(F.col("src").alias("node"), F.col("dst").alias("id")).join(properties, "id")
    votes = seen.groupBy("node", "property", "value").agg(F.count_distinct("id").alias("n"))
    votes = votes.withColumn("all", F.sum("n").over(Window.partitionBy("node", "property"))).where(F.col("n") >= least)
    best = Window.partitionBy("node", "property").orderBy(F.col("n").desc(), "value")
    ranked = votes.withColumn("nth", F.row_number().over(best)).where("nth = 1")
    held = properties.select(F.col("id").alias("node"), "property").distinct()
    return ranked.join(held, ["node", "property"], "left_anti").select(F.col("node").alias("id"), "property", "value", (F.col("n") / F.col("all")).alias("confidence"))


def content_grep(files: DataFrame, pattern: str, limit: int) -> DataFrame:
    """(path, line, text): lines of files (path, text) that match a regular expression, by path and line number from 1."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return lines.where(F.rlike("text", F.lit(pattern))).select("path", (F.col("at") + 1).alias("line"), "text").orderBy("path", "line").limit(limit)


def path_grep(paths: DataFrame, query: str, limit: int) -> DataFrame:
    """(path, score): paths that hold the query's letters in order; a whole hit counts 3, one in the file name 2, scattered letters 1."""
    wanted = query.lower()
    path = F.lower("path")
    name = F.element_at(F.split(path, "/"), -1)
    scattered = ".*".join("\\Q" + c + "\\E" for c in wanted)
    score = F.when(F.contains(name, F.lit(wanted)), 3).when(F.contains(path, F.lit(wanted)), 2).when(F.rlike(path, F.lit(scattered)), 1).otherwise(0)
    return paths.select("path", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), F.length("path"), "path").limit(limit)


def briefing(items: DataFrame, edges: DataFrame, threads: DataFrame, n: int) -> DataFrame:
    """(part, id, value): the newest items, the items of most links, and the oldest open threads."""
    recent = items.orderBy(F.col("updated_ms").desc(), "id").limit(n).select(F.lit("recent").alias("part"), "id", F.col("updated_ms").cast("long").alias("value"))
    degree = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst")).groupBy("id").agg(F.count(F.lit(1)).alias("value"))
    linked = degree.orderBy(F.col("value").desc(), "id").limit(n).select(F.lit("linked").alias("part"), "id", "value")
    waiting = threads.where("open").orderBy("since_ms", "id").limit(n).select(F.lit("open").alias("part"), "id", F.col("since_ms").cast("long").alias("value"))
    return recent.unionByName(linked).unionByName(waiting)
