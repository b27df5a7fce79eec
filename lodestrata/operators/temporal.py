"""Temporal validity, as-of joins and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(start: Column, end: Column, at: Column) -> Column:
    """Both ends inclusive; a null end is open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end >= at))


def overlaps(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    return (start.isNull() | (start <= hi)) & (end.isNull() | (end >= lo))


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    """Facts (valid_at, invalid_at, created_at, expired_at) that are valid and known at an instant."""
    valid = (F.col("valid_at").isNull() | (F.col("valid_at") <= at)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at))
    known = (F.col("created_at").isNull() | (F.col("created_at") <= at)) & (F.col("expired_at").isNull() | (F.col("expired_at") > at))
    return facts.where(valid & known)


def close_on_contradiction(facts: DataFrame, subject: str, at: str) -> DataFrame:
    """Functional facts: each ends when the subject's next one begins."""
    w = Window.partitionBy(subject).orderBy(at)
    return facts.withColumn("invalid_at", F.lead(at).over(w))


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of its key's latest right row at or before its time.

    One union and one window: both sides are sorted together once per key, so
    no row meets more than its predecessor.
    """
    packed = F.struct(*[F.col(v) for v in values])
    l = left.select(key, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(packed).schema[0].dataType).alias("_v"))
    r = right.select(key, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), packed.alias("_v"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def longest_runs(rows: DataFrame, group: str, order: list[str], state: Column) -> DataFrame:
    """(group, run, n, first, last): maximal runs of rows in order for which ``state`` holds."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = rows.withColumn("_on", state).withColumn("_n", F.row_number().over(w))
    wo = Window.partitionBy(group, "_on").orderBy(*order)
    runs = marked.withColumn("_run", F.col("_n") - F.row_number().over(wo)).where("_on")
    return runs.groupBy(group, F.col("_run").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def time_encoding(delta: Column, dims: int) -> Column:
    """cos(delta * w) with w from 1 down to 1e-9 in equal ratios."""
    ratio = 10 ** (-9 / max(1, dims - 1))
    return F.array(*[F.cos(delta * F.lit(ratio**i)) for i in range(dims)])
