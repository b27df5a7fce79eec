"""Deductive rules over facts, with confidences.

Claims, dependencies and sources are plain DataFrames: claims(id, status),
supports(claim, source), depends(claim, on), objects(id, title),
tensions(left, right, state), facts with flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.runtime import materialize


def derived(df: DataFrame, rule: str, subject: str, trust: float) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"), F.lit(trust).alias("confidence"))


def unsupported_claims(claims: DataFrame, supports: DataFrame, depends: DataFrame) -> DataFrame:
    live = claims.where(~F.col("status").isin("archived", "refuted", "superseded"))
    backed = supports.select(F.col("claim").alias("id")).unionByName(depends.select(F.col("claim").alias("id")))
    return derived(live.join(backed, "id", "left_anti"), "unsupported_claim", "id", 1.0)


def dependent_claims(depends: DataFrame) -> DataFrame:
    return derived(depends, "dependent_claim", "claim", 1.0)


def reused_sources(supports: DataFrame) -> DataFrame:
    return derived(supports.groupBy("source").agg(F.count_distinct("claim").alias("n")).where("n >= 2"), "source_reused_support", "source", 0.8)


def duplicate_entities(objects: DataFrame) -> DataFrame:
    title = F.trim(F.regexp_replace(F.lower("title"), r"\s+", " "))
    groups = objects.withColumn("key", title).where("key <> ''").groupBy("key").agg(F.count_distinct("id").alias("n")).where("n >= 2")
    return derived(groups, "likely_duplicate_entity", "key", 0.7)


def long_paths(paths: DataFrame, limit: int = 3) -> DataFrame:
    return derived(paths.where(F.col("path_length") > limit), "evidence_path_too_long", "id", 0.9)


def dependent_on_few_sources(supports: DataFrame, claims: DataFrame) -> DataFrame:
    counted = claims.join(supports.groupBy(F.col("claim").alias("id")).agg(F.count_distinct("source").alias("n")), "id", "left")
    return derived(counted.where(F.coalesce("n", F.lit(0)) < 2), "claim_has_no_independent_support", "id", 0.85)


def in_tension(tensions: DataFrame) -> DataFrame:
    open_ = tensions.where(F.col("state").isin("contradicts", "contested"))
    ends = open_.select(F.col("left").alias("id")).unionByName(open_.select(F.col("right").alias("id"))).distinct()
    return derived(ends, "object_in_unresolved_tension_neighborhood", "id", 0.8)


def flagged(facts: DataFrame, rule: str, flag: str, trust: float) -> DataFrame:
    return derived(facts.where(F.col(flag)), rule, "id", trust)


def private_exports(sources: DataFrame, supports: DataFrame) -> DataFrame:
    both = sources.where(F.col("private") & F.col("exportable")).select(F.col("id").alias("source"))
    return derived(supports.join(both, "source").select("claim").distinct(), "private_source_reaches_export_candidate", "claim", 0.95)


def support_closure(edges: DataFrame, decay: float = 0.9) -> DataFrame:
    """(src, dst, hops, confidence): the best support path of each length of two and more.

    Each round extends the last round's paths by one edge that leads to a node
    they have not seen.  Of the paths with the same ends and length only the
    most confident goes on (the one of least nodes in order among equals), so a
    round holds one path for each pair of ends.  Rounds end when no path grows.
    """
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("confidence").alias("_c"))
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "seen")).alias("b")
    paths = edges.where("src <> dst").select("src", "dst", F.col("confidence").cast("double").alias("confidence"), F.array("src", "dst").alias("seen"))
    out: DataFrame | None = None
    hops = 1
    while True:
        hops += 1
        longer = paths.join(step, F.col("dst") == F.col("_s")).where(~F.array_contains("seen", F.col("_d")))
        longer = longer.select("src", F.col("_d").alias("dst"), (F.col("confidence") * F.col("_c") * decay).alias("confidence"), F.concat("seen", F.array("_d")).alias("seen"))
        paths = longer.groupBy("src", "dst").agg(best).select("src", "dst", (-F.col("b.c")).alias("confidence"), F.col("b.seen").alias("seen"))
        paths = materialize(paths, "closure")
        if paths.isEmpty():
            break
        part = paths.select("src", "dst", F.lit(hops).alias("hops"), "confidence")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return paths.where("false").select("src", "dst", F.lit(0).alias("hops"), "confidence")
    return out


def contradiction_cycles(attacks: DataFrame) -> DataFrame:
    """(cycle, left, right) of claims that attack each other."""
    a = attacks.select(F.col("src").alias("left"), F.col("dst").alias("right")).distinct()
    b = a.select(F.col("right").alias("left"), F.col("left").alias("right"))
    both = a.join(b, ["left", "right"]).where(F.col("left") < F.col("right"))
    return both.select(F.concat_ws("|", "left", "right").alias("cycle"), "left", "right")


def grounded_status(claims: DataFrame, attacks: DataFrame) -> DataFrame:
    """(id, attacks, grounded): mutual attack is undecided, an attacked claim is out, any other in."""
    count = attacks.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("attacks"))
    cycles = contradiction_cycles(attacks)
    mutual = cycles.select(F.col("left").alias("id")).unionByName(cycles.select(F.col("right").alias("id"))).distinct().withColumn("mutual", F.lit(True))
    joined = claims.select("id").join(count, "id", "left").join(mutual, "id", "left")
    status = F.when(F.coalesce("mutual", F.lit(False)), "undecided").when(F.coalesce("attacks", F.lit(0)) > 0, "out").otherwise("in")
    return joined.select("id", F.coalesce("attacks", F.lit(0)).alias("attacks"), status.alias("grounded"))


def reliability(df: DataFrame, good: str, bad: str, a0: float = 1.0, b0: float = 1.0) -> DataFrame:
    """Beta-binomial mean and variance of counts of confirmed and contradicted cases."""
    a, b = F.col(good) + a0, F.col(bad) + b0
    return df.withColumn("mean", a / (a + b)).withColumn("variance", a * b / ((a + b) * (a + b) * (a + b + 1)))


def expected_value_of_information(u0: F.Column, u1: F.Column, value: F.Column, cost: F.Column) -> F.Column:
    return F.greatest(u0 - u1, F.lit(0.0)) * value - cost


def collapse_same(pairs: DataFrame, threshold: float, min_sources: int = 2) -> DataFrame:
    """(id, canonical): entities of confident, independently confirmed sameness, by least id of the cluster."""
    from lodestrata.operators.graph import components

    strong = pairs.where(F.col("confidence") >= threshold).groupBy("src", "dst").agg(F.count_distinct("source").alias("n")).where(F.col("n") >= min_sources)
    ids = strong.select(F.col("src").alias("id")).unionByName(strong.select(F.col("dst").alias("id"))).distinct()
    return components(strong.select("src", "dst"), ids).select("id", F.col("component").alias("canonical"))


def elites(rows: DataFrame, niche: str, score: str, k: int) -> DataFrame:
    """The best k rows of each niche, by score, then id."""
    w = Window.partitionBy(niche).orderBy(F.col(score).desc(), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
