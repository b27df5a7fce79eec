"""What the engine knows of itself: relations and columns, lineage, and advice from receipts."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def columns(spark: SparkSession, relations: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, ordinal_position, data_type, is_nullable) as information_schema.columns has them."""
    rows = [
        (name, f.name, at, f.dataType.simpleString(), "YES" if f.nullable else "NO")
        for name, df in sorted(relations.items())
        for at, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")


def tables(spark: SparkSession, relations: Mapping[str, DataFrame], lineage: Mapping[str, str]) -> DataFrame:
    """(table_name, table_type): derived relations count as materialised."""
    rows = [(name, "MATERIALIZED" if name in lineage else "BASE TABLE") for name in sorted(relations)]
    return spark.createDataFrame(rows, "table_name string, table_type string")


def sources_of(spark: SparkSession, text: str) -> list[str]:
    """The relations that a statement reads, from its parsed plan; names that it defines itself (WITH) are none."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    found = set(re.findall(r"'UnresolvedRelation \[([^\]]+)\]", plan.toString()))
    own = {m.lower() for m in re.findall(r"(?is)(?:\bwith\b|,)\s*(?:recursive\s+)?([A-Za-z_]\w*)\s*(?:\([^()]*\)\s*)?\bas\s*\(", text)}
    names = {name.split(", ")[-1] for name in found}
    return sorted(n for n in names if n.lower() not in own)


def lineage(spark: SparkSession, statements: Mapping[str, str]) -> DataFrame:
    """(target, source) of derived relations by their statements."""
    rows = [(target, source) for target, text in sorted(statements.items()) for source in sources_of(spark, text)]
    return spark.createDataFrame(rows, "target string, source string")


def plan_metrics(receipts: DataFrame) -> DataFrame:
    """By plan: runs, mean cost, share that succeeded, and the standard error of the cost (null for one run)."""
    n = F.count(F.lit(1))
    return receipts.groupBy("plan").agg(n.alias("runs"), F.avg("cost").alias("cost"), F.avg(F.col("ok").cast("double")).alias("success"), (F.stddev_samp("cost") / F.sqrt(n)).alias("error"))


def index_advice(receipts: DataFrame, least_runs: int, least_share: float) -> DataFrame:
    """(relation, column, runs, share, state): columns by which relations are often filtered without an index.

    receipts: (relation, column, indexed, rows_read, rows_out).  A proposal that reads far more than it returns is to be
    shadowed; one whose indexed runs already read little is promoted; one that is rarely asked for is retired.
    """
    pain = receipts.groupBy("relation", "column").agg(
        F.count(F.lit(1)).alias("runs"),
        (1 - F.sum("rows_out") / F.sum("rows_read")).alias("share"),
        F.avg(F.col("indexed").cast("double")).alias("indexed"),
    )
    state = F.when(F.col("runs") < least_runs, "retired").when(F.col("indexed") == 1, "promoted").when(F.col("share") >= least_share, "shadow").otherwise("proposed")
    return pain.select("relation", "column", "runs", "share", state.alias("state"))
