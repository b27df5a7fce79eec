"""Joins that bear hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.ordered import running_totals
from lodestrata.runtime import materialize


def skew_join(left: DataFrame, right: DataFrame, key: str, spread: list[str], broadcast_rows: int = 50_000, parts: int = 4096, how: str = "inner") -> DataFrame:
    """Inner (or left) join on ``key`` of a written, large ``left`` with a ``right`` that may be small.

    A right side of at most ``broadcast_rows`` rows is broadcast.  Otherwise
    keys that hold more than a share of 1 / ``parts`` of the left rows, of
    which there are fewer than ``parts``, are dealt to as many salted keys as
    keep each below that share; ``spread`` names left columns that deal them.
    """
    if right.count() <= broadcast_rows:
        return left.join(F.broadcast(right), key, how)
    limit = max(left.count() // parts, 1000)
    hot = left.groupBy(key).count().where(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("int").alias("_salts"))
    hot = materialize(hot, "hot-keys")
    if hot.isEmpty():
        return left.join(right, key, how)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    copied = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def paired(edges: DataFrame, tile: int = 512) -> DataFrame:
    """(m, u, v): all pairs of different neighbours u, v of each node m of (src, dst); a hub's pairs are dealt to many tasks."""
    degree = edges.groupBy(F.col("dst").alias("m")).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    ends = materialize(edges.select(F.col("dst").alias("m"), F.col("src").alias("u")).join(degree, "m"), "pairs")
    left = ends.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("m", "t", "u")
    right = ends.select("m", F.pmod(F.xxhash64("u"), F.col("tiles")).cast("int").alias("t"), F.col("u").alias("v"))
    return left.join(right, ["m", "t"]).where("u <> v").select("m", "u", "v")


def count_below(left: DataFrame, key: str, bound: Column, right: DataFrame, value: Column) -> DataFrame:
    """(key, n): for each key the pairs of its rows with right rows whose value is less than the row's bound; keys without any are left out.

    Values and bounds are sorted together by ranges and the values counted up to each bound, so no pair is made.
    Nulls meet nothing; NaN counts as the greatest.
    """
    bounds = left.select(F.col(key).alias("k"), (bound.cast("double") + F.lit(0.0)).alias("x"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("c"))
    values = right.select((value.cast("double") + F.lit(0.0)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    values = values.select(F.lit(None).cast(left.schema[key].dataType).alias("k"), "x", F.lit(1).alias("kind"), "c")
    # A bound comes before the equal value, which is not less; the key deals bounds that repeat to several ranges.
    both = bounds.unionByName(values).where("x is not null")
    counted = running_totals(both, [F.col("x"), F.col("kind"), F.col("k")], "c").where("kind = 0")
    return counted.groupBy(F.col("k").alias(key)).agg(F.sum("running").alias("n")).where("n > 0")
