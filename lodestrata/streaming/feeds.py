"""Event streams: cursor reads, subscriptions, mentions, change feeds and windows.

Batch forms work on frames of (token, stream, actor, kind, ...); streaming
forms use Structured Streaming with checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READ_LIMIT = 256
KEPT_PER_STREAM = 4096


def retained(events: DataFrame, keep: int = KEPT_PER_STREAM) -> DataFrame:
    """The newest events of each stream, as its log keeps them."""
    w = Window.partitionBy("stream").orderBy(F.col("token").desc())
    return events.withColumn("_age", F.row_number().over(w)).where(F.col("_age") <= keep).drop("_age")


def read_after(events: DataFrame, cursors: DataFrame, subscriptions: DataFrame, actor: object, limit: int = READ_LIMIT) -> DataFrame:
    """Events after an actor's cursor over its subscribed streams, in token order."""
    subs = subscriptions.where(F.col("actor") == actor).select("stream")
    own = cursors.where(F.col("actor") == actor).select("stream", F.col("token").alias("_after"))
    mine = events.join(F.broadcast(subs), "stream", "left_semi").join(F.broadcast(own), "stream", "left")  # one actor's few rows
    return mine.where(F.col("token") > F.coalesce("_after", F.lit(-1))).drop("_after").orderBy("token").limit(limit)


def advance(cursors: DataFrame, read: DataFrame, actor: object) -> DataFrame:
    """Cursors after a read: each stream's greatest token."""
    new = read.groupBy("stream").agg(F.max("token").alias("token")).select(F.lit(actor).cast(cursors.schema["actor"].dataType).alias("actor"), "stream", "token")
    return cursors.unionByName(new).groupBy("actor", "stream").agg(F.max("token").alias("token"))


def mentions(events: DataFrame, actor: object, drained: int = -1, limit: int = READ_LIMIT) -> DataFrame:
    """Pending events that target an actor, oldest first."""
    return events.where((F.col("target") == actor) & (F.col("token") > drained)).orderBy("token").limit(limit)


def valid_publish(events: DataFrame) -> DataFrame:
    """Urgent events need a target; others are refused."""
    return events.where(~F.col("urgency").isin("ask", "block") | F.col("target").isNotNull())


def ingest_log(log: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote events that the log does not hold yet, by token."""
    return remote.dropDuplicates(["token"]).join(log.select("token"), "token", "left_anti")


def coalesce_changes(changes: DataFrame) -> DataFrame:
    """One change per (kind, id): the latest, with all changed properties merged."""
    return changes.groupBy("kind", "id").agg(F.max("token").alias("token"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("changed")))).alias("changed"), F.count(F.lit(1)).alias("n"))


def matches(kinds: list[str] | None = None, labels: list[str] | None = None, changed: list[str] | None = None) -> Column:
    """A mutation matcher: each list that is given must share a member."""
    out = F.lit(True)
    if kinds:
        out = out & F.col("kind").isin(kinds)
    for name, wanted in (("labels", labels), ("changed", changed)):
        if wanted:
            out = out & F.arrays_overlap(name, F.array(*[F.lit(w) for w in wanted]))
    return out


def shed_load(queue: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the most valuable events of a full queue, ties to the older."""
    order = [F.col("value").desc(), F.col("token")]
    kept = queue.orderBy(*order).limit(capacity)
    return kept, queue.join(kept.select("token"), "token", "left_anti")


def windowed_counts(events: DataFrame, time: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Counts and sums per event-time window; on a stream, events later than the watermark are dropped."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what a stream holds now into Parquet, exactly once, and stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def change_feed(stream: DataFrame, handler, checkpoint: str) -> None:
    """Hand each micro-batch, coalesced, to ``handler(batch, number)``; a batch that is replayed has the same number."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: handler(coalesce_changes(batch), number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
