"""The engine's front door: named relations, SQL, query IR, JSON bodies, the graph pattern language and DDL."""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.model import DEFAULT_LIMIT, query_nodes
from lodestrata.plans.ir import QueryIr, compile_query

_NUMBER = itertools.count()
MAX_LIMIT = 1000


class Engine:
    """Relations by name over one session; each engine has its own view names."""

    def __init__(self, spark: SparkSession, relations: Mapping[str, DataFrame] | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None):
        self.spark = spark
        self.relations: dict[str, DataFrame] = dict(relations or {})
        self.nodes, self.edges = nodes, edges
        self.lineage: dict[str, str] = {}

    def register(self, name: str, df: DataFrame) -> None:
        self.relations[name] = df

    def sql(self, text: str, params: Mapping[str, object] | None = None) -> DataFrame:
        """A SELECT over the registered relations; ``:name`` parameters are bound as literals."""
        return self._with_views(text, params)

    def _with_views(self, text: str, params: Mapping[str, object] | None) -> DataFrame:
        for name, df in self.relations.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text, args=dict(params or {}))

    def explain(self, text: str) -> str:
        """The formatted physical plan of a statement."""
        df = self.sql(text)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def ir(self, query: QueryIr) -> DataFrame:
        return compile_query(query, self.relations, self.edges)

    def query(self, body: Mapping[str, object]) -> DataFrame:
        """A JSON query body: {"kind": "node_match" | "neighbors", ...}; limits are capped at 1000."""
        limit = min(int(body.get("limit", DEFAULT_LIMIT)), MAX_LIMIT)
        if body["kind"] == "node_match":
            return query_nodes(self.nodes, body.get("label"), body.get("properties") or {}, limit)
        if body["kind"] == "neighbors":
            from lodestrata.operators.graph import neighbors

            return neighbors(self.edges, body["node_id"], body.get("direction", "out"), body.get("type")).limit(limit)
        raise ValueError(f"unknown query kind {body['kind']!r}")

    def cypher(self, text: str, params: Mapping[str, object] | None = None) -> DataFrame:
        from lodestrata.plans.cypher import run

        return run(text, self.nodes, self.edges, dict(params or {}))

    def execute(self, text: str, params: Mapping[str, object] | None = None) -> None:
        """Run a statement of the pattern language that writes; nodes and edges are then those after it."""
        from lodestrata.plans.cypher_writes import execute

        self.nodes, self.edges = execute(text, self.nodes, self.edges, dict(params or {}))

    def information_schema(self) -> dict[str, DataFrame]:
        """Tables and columns of the engine's relations."""
        from lodestrata.operators import catalog

        return {"tables": catalog.tables(self.spark, self.relations, self.lineage), "columns": catalog.columns(self.spark, self.relations)}

    def lineage_of(self) -> DataFrame:
        """(target, source) of derived relations."""
        from lodestrata.operators import catalog

        return catalog.lineage(self.spark, self.lineage)

    def create_table_as(self, name: str, text: str, path: str | None = None) -> DataFrame:
        """Materialise a query under a name, with its statement as lineage."""
        from lodestrata.runtime import materialize

        df = self.sql(text)
        if path is None:
            df = materialize(df, f"ctas-{name}")
        else:
            df.write.mode("errorifexists").parquet(path)
            df = self.spark.read.schema(df.schema).parquet(path)
        self.relations[name], self.lineage[name] = df, text
        return df

    def insert_into(self, name: str, text: str) -> DataFrame:
        """Append a query's rows; wider rows add columns."""
        from lodestrata.runtime import materialize

        grown = self.relations[name].unionByName(self.sql(text), allowMissingColumns=True)
        self.relations[name] = materialize(grown, f"insert-{name}")
        return self.relations[name]

    def drop(self, name: str, if_exists: bool = False) -> bool:
        if name not in self.relations:
            if if_exists:
                return False
            raise KeyError(name)
        del self.relations[name]
        self.lineage.pop(name, None)
        return True

    def rename(self, old: str, new: str) -> None:
        self.relations[new] = self.relations.pop(old)
        if old in self.lineage:
            self.lineage[new] = self.lineage.pop(old)

    def test_not_null(self, name: str, column: str) -> DataFrame:
        """Rows that break the rule, as dbt-style tests return them."""
        return self.relations[name].where(F.col(column).isNull())

    def test_unique(self, name: str, column: str) -> DataFrame:
        return self.relations[name].where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1")

    def test_accepted_values(self, name: str, column: str, values: list[object]) -> DataFrame:
        return self.relations[name].where(~F.col(column).isin(values)).groupBy(column).count()

    def test_relationships(self, name: str, column: str, parent: str, key: str) -> DataFrame:
        own = self.relations[name].where(F.col(column).isNotNull())
        return own.join(self.relations[parent].select(F.col(key).alias(column)), column, "left_anti").select(column)
