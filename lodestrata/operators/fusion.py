"""Rank fusion, cascades, re-ranking and budgeted packing."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.runtime import ship


def ranked(scores: DataFrame, method: str) -> DataFrame:
    """(id, method, score, rank) with ranks from 1, by score, then id."""
    order = Window.orderBy(F.col("score").desc(), "id")  # lists are top-k results, not tables
    return scores.select("id", F.lit(method).alias("method"), "score", F.row_number().over(order).alias("rank"))


def reciprocal_rank_fusion(lists: list[DataFrame], k: float = 60.0) -> DataFrame:
    """(id, score): sum of 1 / (k + rank); a single list keeps its own scores."""
    if len(lists) == 1:
        return lists[0].select("id", "score")
    return reduce(DataFrame.unionByName, lists).groupBy("id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))


def weighted_fusion(lists: list[DataFrame], weights: dict[str, float]) -> DataFrame:
    """(id, score): sum of weight times score by method; a method without a weight counts once."""
    weight: Column = F.lit(1.0)
    for method, w in weights.items():
        weight = F.when(F.col("method") == method, F.lit(w)).otherwise(weight)
    return reduce(DataFrame.unionByName, lists).groupBy("id").agg(F.sum(weight * F.col("score")).alias("score"))


# Ranking cascade: each rule gives a bucket, lower is better; rows are sorted by the buckets in turn, then id.


def words_bucket(matched: Column, terms: int) -> Column:
    return F.lit(terms) - matched


def typo_bucket(typos: Column, terms: int) -> Column:
    return F.least(typos, F.lit(2 * terms))


def proximity_bucket(gaps: Column, terms: int) -> Column:
    """``gaps``: array of distances between matched words."""
    capped = F.aggregate(gaps, F.lit(0), lambda s, g: s + F.least(g - 1, F.lit(8)))
    return F.least(capped, F.lit((terms - 1) * 8))


def attribute_bucket(first: Column) -> Column:
    return F.least(first, F.lit(64))


def band_bucket(value: Column) -> Column:
    """Ten bands of a value between 0 and 1."""
    return F.floor((1 - F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))) * 10)


def text_bucket(score: Column) -> Column:
    return band_bucket(score / (score + 1))


def hops_bucket(hops: Column) -> Column:
    return F.least(hops, F.lit(6))


def recency_bucket(age_ms: Column, superseded: Column) -> Column:
    week = 7 * 24 * 3600 * 1000
    return F.when(superseded, F.lit(11)).when(age_ms.isNull(), F.lit(10)).otherwise(F.least(F.floor(age_ms / week), F.lit(10)))


def status_tier(status: Column) -> Column:
    return (
        F.when(status == "axiomatic", F.lit(0))
        .when(status.isin("accepted", "supported", "grounded", "explanatory"), F.lit(1))
        .when(status.isin("contested", "undercut"), F.lit(3))
        .otherwise(F.lit(2))
    )


def epistemic_bucket(status: Column, weight: Column) -> Column:
    tier = F.when(weight >= 1.5, F.lit(0)).when(weight >= 1.2, F.lit(1)).when(weight >= 1.0, F.lit(2)).otherwise(F.lit(3))
    return status_tier(status) * 4 + tier


def cascade(rows: DataFrame, buckets: dict[str, Column], worst: dict[str, int], limit: int) -> DataFrame:
    """Rows with their buckets, in cascade order; a missing signal gets the rule's worst bucket."""
    out = rows
    for name, bucket in buckets.items():
        out = out.withColumn(name, F.coalesce(bucket.cast("long"), F.lit(worst[name]).cast("long")))
    return out.orderBy(*buckets, "id").limit(limit)


def half_even(value: Column, places: int) -> Column:
    return F.bround(value, places)


def epistemic_filter(rows: DataFrame, top_n: int = 25, code: bool = False, query: str = "", code_debug: bool = False) -> DataFrame:
    """The eleven-stage filter over (id, rrf_score, learned, weight, status, slug, title, is_code, code_boost).

    Cut to twice ``top_n``; drop code objects unless asked for; learned score
    and weight at four half-even places; boost; one row per slug, the strictly
    higher or else the first; title bonus; threshold; status gate; slice.
    """
    cut = rows.orderBy(F.col("rrf_score").desc(), "id").limit(2 * top_n)
    kept = cut if code else cut.where(~F.coalesce("is_code", F.lit(False)))
    score = half_even(F.coalesce("learned", "rrf_score"), 4)
    score = half_even(score * F.coalesce("weight", F.lit(1.0)), 4)
    if code_debug:
        score = score + F.when(F.coalesce("code_boost", F.lit(False)), F.lit(0.25)).otherwise(F.lit(0.0))
    scored = kept.withColumn("score", score)
    by_slug = Window.partitionBy(F.coalesce("slug", F.concat(F.lit("id:"), F.col("id")))).orderBy(F.col("score").desc(), F.col("rrf_score").desc(), "id")
    single = scored.withColumn("_nth", F.row_number().over(by_slug)).where("_nth = 1").drop("_nth")
    shared = F.size(F.array_intersect(F.split(F.lower("title"), r"\W+"), F.array(*[F.lit(w) for w in query.lower().split()]).cast("array<string>")))
    out = single.withColumn("score", F.col("score") + F.least(0.10 * shared, F.lit(0.3)))
    out = out.where((F.col("score") >= 0.1) & (F.coalesce("weight", F.lit(1.0)) > 0))
    out = out.where(~F.coalesce("status", F.lit("accepted")).isin("retracted", "provisional", "contested"))
    return out.orderBy(F.col("score").desc(), F.col("rrf_score").desc(), "id").limit(top_n)


def budget_prefix(rows: DataFrame, group: str, order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Rows of each group in order while their tokens fit the budget; the first always does."""
    w = Window.partitionBy(group).orderBy(*order)
    running = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("rank", F.row_number().over(w)).withColumn("running", running)
    return out.where((F.col("rank") == 1) | (F.col("running") <= budget))


def mmr_fill(candidates: DataFrame, group: str, budget: int, lam: float = 0.7) -> DataFrame:
    """(group, id, position): greedy fill by score less redundancy under a token budget, per group.

    candidates: group, id, score, tokens, terms.  The choice of each step
    depends on those before it, so a group is filled in pandas; a group is one
    ranked candidate list, which callers cut to a bounded length beforehand.
    """
    ship(candidates.sparkSession)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["score", "id"], ascending=[False, True]).to_dict("records")
        sets = {r["id"]: {t for t in r["terms"] if len(t) > 2} for r in left}
        chosen, remaining = [], budget
        while left:

            def gain(r: dict) -> float:
                own = sets[r["id"]]
                near = max((len(own & sets[c]) / max(1, len(own | sets[c])) for c in chosen), default=0.0)
                return lam * r["score"] - (1 - lam) * near

            fits = [r for r in left if r["tokens"] <= remaining]
            if not fits:
                break
            best = max(fits, key=lambda r: (gain(r), [-ord(c) for c in str(r["id"])]))
            chosen.append(best["id"])
            remaining -= best["tokens"]
            left.remove(best)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(chosen), "id": chosen, "position": range(1, len(chosen) + 1)})

    kinds = dict(candidates.dtypes)
    return candidates.groupBy(group).applyInPandas(fill, f"{group} {kinds[group]}, id {kinds['id']}, position int")
