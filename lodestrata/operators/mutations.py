"""Writes to graph and relation frames: every function returns the new frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows replace those of the same key; a version column grows where the content differs."""
    new = rows.select(*[F.col(c).alias(f"_n_{c}") for c in rows.columns])
    joined = base.join(new, F.col(key) == F.col(f"_n_{key}"), "full")
    out = []
    values = [c for c in base.columns if c not in (key, "version") and c in rows.columns]
    changed = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in values], F.lit(False))
    given = F.col(f"_n_{key}").isNotNull()
    for c in base.columns:
        if c == "version":
            grown = F.when(F.col(key).isNull(), F.lit(1)).when(given & changed, F.col("version") + 1).otherwise(F.col("version"))
            out.append(grown.cast(base.schema[c].dataType).alias(c))
        elif c in rows.columns:
            out.append(F.when(given, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def insert_if_absent(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    return base.unionByName(rows.join(base.select(key), key, "left_anti").select(*rows.columns), allowMissingColumns=True)


def compare_and_set(base: DataFrame, key: str, wanted: object, column: str, expected: object, value: object) -> DataFrame:
    """One property changes where it still has the expected value."""
    hit = (F.col(key) == wanted) & F.col(column).eqNullSafe(F.lit(expected))
    return base.withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column)))


def update_where(base: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return base.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns])


def delete_nodes(nodes: DataFrame, edges: DataFrame, condition: Column, detach: bool = False) -> tuple[DataFrame, DataFrame]:
    """Matched nodes become tombstones; with ``detach`` so do their edges in both directions."""
    gone = nodes.where(condition).select(F.col("id").alias("_gone"))
    out = nodes.withColumn("tombstone", F.coalesce("tombstone", F.lit(False)) | F.coalesce(condition, F.lit(False)))
    if not detach:
        return out, edges
    touched = edges.join(gone, F.col("from_id") == F.col("_gone"), "left_semi").select(F.col("id").alias("_edge"))
    touched = touched.unionByName(edges.join(gone, F.col("to_id") == F.col("_gone"), "left_semi").select(F.col("id").alias("_edge"))).distinct()
    marked = edges.join(touched, F.col("id") == F.col("_edge"), "left")
    return out, marked.withColumn("tombstone", F.coalesce("tombstone", F.lit(False)) | F.col("_edge").isNotNull()).drop("_edge")


def match_or_create(base: DataFrame, rows: DataFrame, key: str, on_create: dict[str, Column], on_match: dict[str, Column]) -> DataFrame:
    """Each row's key is found, and gets ``on_match``, or is made, and gets ``on_create``."""
    keys = rows.select(F.col(key).alias("_k")).distinct()
    joined = base.join(keys, F.col(key) == F.col("_k"), "full")
    found, new = F.col(key).isNotNull() & F.col("_k").isNotNull(), F.col(key).isNull()
    out = [F.coalesce(F.col(key), F.col("_k")).alias(key)]
    for c in base.columns:
        if c != key:
            kind = base.schema[c].dataType
            out.append(F.when(new, on_create.get(c, F.lit(None)).cast(kind)).when(found, on_match.get(c, F.col(c)).cast(kind)).otherwise(F.col(c)).alias(c))
    return joined.select(*out)


def commit_batch(base: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """All of a batch or nothing: a key that is both written and deleted is an error."""
    clash = upserts.select(key).join(deletes.select(key), key).limit(1)
    if not clash.isEmpty():
        raise ValueError("a record is written and deleted in one batch")
    return upsert(base.join(deletes.select(key), key, "left_anti"), upserts, key)


def set_expiry(nodes: DataFrame, condition: Column, expires_at_ms: Column) -> DataFrame:
    return nodes.withColumn("expires_at_ms", F.when(condition, expires_at_ms).otherwise(F.col("expires_at_ms")))


def purge_expired(nodes: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(kept, purged) at an instant."""
    due = F.coalesce(F.col("expires_at_ms") <= now_ms, F.lit(False))
    return nodes.where(~due), nodes.where(due)


def expiring_before(nodes: DataFrame, at_ms: int, limit: int) -> DataFrame:
    return nodes.where(F.col("expires_at_ms") < at_ms).orderBy("expires_at_ms", "id").limit(limit)


def evict(hot: DataFrame, last_access: str, cutoff: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hot, cold): rows last read before the cutoff leave the hot tier, oldest first."""
    cold = hot.where(F.col(last_access) < cutoff).orderBy(last_access, "id")
    cold = cold if limit is None else cold.limit(limit)
    return hot.join(cold.select("id"), "id", "left_anti"), cold


def rehydrate(hot: DataFrame, cold: DataFrame, ids: DataFrame) -> DataFrame:
    """Asked ids from the hot tier, or else from the cold one."""
    near = ids.join(hot, "id")
    far = ids.join(hot.select("id"), "id", "left_anti").join(cold, "id")
    return near.unionByName(far, allowMissingColumns=True)


def pack_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, edges) with dense numbers in order of id; edges with unknown ends are dropped."""
    from lodestrata.operators.ordered import zrank

    numbered = zrank(nodes.select(F.col("id").alias("member"), F.lit(0).alias("score"))).select(F.col("member").alias("id"), F.col("rank").alias("number"))
    a = numbered.select(F.col("id").alias("from_id"), F.col("number").alias("a"))
    b = numbered.select(F.col("id").alias("to_id"), F.col("number").alias("b"))
    return numbered, edges.join(a, "from_id").join(b, "to_id").select("a", "b")
