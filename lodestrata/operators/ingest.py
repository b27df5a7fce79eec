"""Ingest: readers with error reports, flattening, field facts, dictionaries and derived edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "id string, labels array<string>, properties string"
EDGE_SCHEMA = "id string, from_id string, to_id string, type string, properties string, confidence double"


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of newline-delimited JSON; an error names its line's text and reason."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    missing = reduce(Column.__or__, [F.col(f"r.{c}").isNull() for c in required], F.lit(False))
    broken = F.col("r").isNull() | F.col("r._bad").isNotNull()
    good = parsed.where(~broken & ~missing).select("r.*").drop("_bad")
    errors = parsed.where(broken | missing).select("value", F.when(broken, "malformed JSON").otherwise("missing field").alias("reason"))
    return good, errors


def read_csv_nodes(spark: SparkSession, path: str, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """(nodes, errors): columns id and label, every other column a text property; rows of another width are errors.

    The first line of each file names its columns, and is alone no data.
    """
    names = spark.read.text(path).first()["value"].split(delimiter)
    # The CSV reader passes over the first line of each file; with a separator that no text holds, lines stay whole.
    lines = spark.read.schema("value string").option("header", True).option("sep", "\x01").option("quote", "").option("escape", "\x02").csv(path)
    cells = lines.where(F.trim("value") != "").select("value", F.split("value", f"\\Q{delimiter}\\E", -1).alias("c"))
    fits = F.size("c") == len(names)
    rows = cells.where(fits)
    others = [n for n in names if n not in ("id", "label")]
    properties = F.to_json(F.struct(*[F.col("c")[names.index(n)].alias(n) for n in others])) if others else F.lit("{}")
    label = F.array(F.col("c")[names.index("label")]) if "label" in names else F.array().cast("array<string>")
    nodes = rows.select(F.col("c")[names.index("id")].alias("id"), label.alias("labels"), properties.alias("properties"))
    return nodes, cells.where(~fits).select("value", F.lit("wrong number of columns").alias("reason"))


def read_csv_edges(spark: SparkSession, path: str, from_column: str, to_column: str, kind: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    a, b = F.col(from_column), F.col(to_column)
    return raw.select(F.concat_ws("|", F.lit(kind), a, b).alias("id"), a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("type"))


def flatten_json(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, field, value) of each scalar of a JSON object; nested names are joined by points."""
    top = df.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("field", "value"))
    nested = F.col("value").startswith("{")
    deep = top.where(nested).select(key, "field", F.explode(F.from_json("value", "map<string,string>")).alias("inner", "value"))
    lists = top.where(F.col("value").startswith("[")).select(key, "field", F.explode(F.from_json("value", "array<string>")).alias("value"))
    flat = top.where(~nested & ~F.col("value").startswith("["))
    return flat.unionByName(deep.select(key, F.concat_ws(".", "field", "inner").alias("field"), "value")).unionByName(lists.select(key, "field", "value"))


def map_fields(df: DataFrame, key: str, rules: dict[str, str], column: str) -> DataFrame:
    """Named JSON paths as columns."""
    return df.select(key, *[F.get_json_object(column, f"$.{path}").alias(name) for name, path in rules.items()])


def field_facts(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field, raw, normalized) of each non-null field, one pass over the rows."""
    entries = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("raw"), form.cast("string").alias("normalized")) for n, form in fields.items()])
    return df.select(key, F.inline(entries)).where("raw is not null")


def data_dictionary(facts: DataFrame) -> DataFrame:
    """(field, n, cardinality) of field facts."""
    return facts.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("normalized").alias("cardinality"))


def edge_dictionary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def derive_edges(facts: DataFrame, key: str, source: str, target: str, kind: str) -> DataFrame:
    """(from_id, to_id, type): the normalized values of two fields of one record."""
    a = facts.where(F.col("field") == source).select(key, F.col("normalized").alias("from_id"))
    b = facts.where(F.col("field") == target).select(key, F.col("normalized").alias("to_id"))
    return a.join(b, key).select("from_id", "to_id", F.lit(kind).alias("type")).distinct()


def frontier_scores(pages: DataFrame, topic: str, now_overlap: Column, depth: Column) -> DataFrame:
    """Crawl priority: overlap with the topic less a tenth of the depth."""
    return pages.withColumn("priority", now_overlap - 0.1 * depth)


def polite_batch(frontier: DataFrame, per_domain: int, batch: int) -> DataFrame:
    """The best pages of a batch with a bound for each domain."""
    from pyspark.sql import Window

    w = Window.partitionBy("domain").orderBy(F.col("priority").desc(), "url")
    return frontier.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_domain).orderBy(F.col("priority").desc(), "url").limit(batch)
