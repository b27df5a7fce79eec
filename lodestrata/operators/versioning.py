"""Snapshots as DataFrames: diff, three-way merge, read models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _digest(columns: list[str]) -> F.Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or changed records; one full join on the key and a digest."""
    values = [c for c in sorted(old.columns) if c != key]
    a = old.select(F.col(key).alias("_k"), _digest(values).alias("_a"))
    b = new.select(F.col(key).alias("_l"), _digest(values).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, F.col("_k") == F.col("_l"), "full").select(F.coalesce("_k", "_l").alias(key), change.alias("change")).where("change is not null")


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) of two versions of a base.

    A record that one side changed takes that side; one that both changed alike
    is no conflict; one that both changed otherwise keeps ours and is reported.
    """
    values = [c for c in base.columns if c != key]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).alias(f"_{name}k"), F.struct(*values).alias(f"_{name}"), _digest(sorted(values)).alias(f"_{name}d"))

    b, o, t = side(base, "b"), side(ours, "o"), side(theirs, "t")
    joined = o.join(t, F.col("_ok") == F.col("_tk"), "full").withColumn("_k", F.coalesce("_ok", "_tk"))
    joined = joined.join(b, F.col("_k") == F.col("_bk"), "full").withColumn("_k", F.coalesce("_k", "_bk"))
    same_o, same_t = F.col("_od").eqNullSafe(F.col("_bd")), F.col("_td").eqNullSafe(F.col("_bd"))
    both = F.col("_od").eqNullSafe(F.col("_td"))
    taken = F.when(both | same_t, F.col("_o")).when(same_o, F.col("_t")).otherwise(F.col("_o"))
    judged = joined.select(F.col("_k").alias(key), taken.alias("_v"), (~both & ~same_o & ~same_t).alias("_c"))
    merged = judged.where("_v is not null").select(key, "_v.*")
    return merged, judged.where("_c").select(key)


def page(df: DataFrame, order: list, cursor: int, size: int) -> DataFrame:
    """Rows of an offset cursor; the next cursor is ``cursor + size`` while rows come."""
    return df.orderBy(*order).offset(cursor).limit(size)
