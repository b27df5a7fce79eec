"""Sorted-set operations over (member, score) frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.runtime import materialize


def finite(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))


def zadd(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with new scores; a member's new score replaces its old one, others must be finite."""
    keep = entries.join(finite(new).select("member"), "member", "left_anti")
    return keep.unionByName(finite(new))


def zrem(entries: DataFrame, members: DataFrame) -> DataFrame:
    return entries.join(members, "member", "left_anti")


def zrange_by_score(entries: DataFrame, lo: float, hi: float, limit: int | None = None, offset: int = 0) -> DataFrame:
    out = entries.where(F.col("score").between(lo, hi)).orderBy("score", "member")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def zpop(entries: DataFrame, n: int, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped, rest): the n least or greatest entries and all others."""
    order = (F.col("score").desc(), F.col("member").desc()) if largest else (F.col("score"), F.col("member"))
    popped = entries.orderBy(*order).limit(n)
    return popped, entries.join(popped.select("member"), "member", "left_anti")


def zrank(entries: DataFrame, scope: str | None = None) -> DataFrame:
    """Rank from 0 of every member, within its scope if one is named.

    A rank over all entries is taken in two steps: ranges are ranked each for
    itself, and the sizes of the ranges before give the offset.
    """
    if scope is not None:
        w = Window.partitionBy(scope).orderBy("score", "member")
        return entries.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
    ranged = materialize(entries.repartitionByRange("score", "member").withColumn("_range", F.spark_partition_id()), "zrank")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("score", "member")) - 1
    return ranged.join(F.broadcast(offsets), "_range").withColumn("rank", inside + F.col("_before")).drop("_range", "_before")


def running_totals(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """``df`` with rank (from 1) and running, the sum of a column up to each row, over all rows in an order.

    As with ranks, ranges are summed each for itself and the ranges before give the offsets.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "running")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))  # one row per partition
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_v"))
    inside = Window.partitionBy("_range").orderBy(*order)
    joined = ranged.join(F.broadcast(offsets), "_range")
    rank = F.row_number().over(inside) + F.col("_n")
    running = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_v")
    return joined.withColumn("rank", rank).withColumn("running", running).drop("_range", "_n", "_v")


def zrank_of(entries: DataFrame, member: str) -> DataFrame:
    """Rank from 0 of one member: a count of the entries before it, without sorting."""
    own = F.broadcast(entries.where(F.col("member") == member).select(F.col("score").alias("s"), F.col("member").alias("m")))  # one row
    before = (F.col("score") < F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("member") < F.col("m")))
    return entries.join(own, how="cross").agg(F.sum(before.cast("long")).alias("rank"))
