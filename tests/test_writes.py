"""Transactions, mutations and sinks on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph, mutations
from lodestrata.operators.transactions import Snapshot
from lodestrata.sources import sinks


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, v string")


def test_transaction(spark):
    first = Snapshot({"t": frame(spark, [(1, "a"), (2, "b")])})
    change = first.begin()
    change.upsert("t", frame(spark, [(2, "B"), (3, "c")]))
    change.delete("t", frame(spark, [(1, "")]).select("id"))
    assert {tuple(r) for r in change.read("t").collect()} == {(2, "B"), (3, "c")}
    assert first.frames["t"].count() == 2
    other = first.begin()
    second = change.commit(first)
    assert second.version == 1 and {tuple(r) for r in second.frames["t"].collect()} == {(2, "B"), (3, "c")}
    with pytest.raises(RuntimeError):
        other.commit(second)
    other.rollback()
    with pytest.raises(RuntimeError):
        other.read("t")


def test_batches_are_atomic(spark):
    base = frame(spark, [(1, "a")])
    with pytest.raises(ValueError):
        mutations.commit_batch(base, frame(spark, [(1, "x")]), base.select("id"))


def test_export_keeps_gated_records_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean")
    sinks.export_jsonl(rows, f"{tmp_path}/out", F.col("ok"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert [r["id"] for r in lines] == [1]


def test_boxes(spark):
    boxes = spark.createDataFrame([("i", 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("i", 2, 0.8, 1.0, 1.0, 10.0, 10.0), ("i", 3, 0.7, 50.0, 50.0, 60.0, 60.0)], "image string, id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert {r["id"] for r in sinks.suppress_boxes(boxes, 0.5).collect()} == {1, 3}


def test_bridges_and_betweenness(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    assert {tuple(r) for r in graph.bridges(edges, nodes).collect()} == {(3, 4), (6, 7)}
    both = graph.undirected(edges)
    got = {r["id"]: r["score"] for r in graph.betweenness(both, nodes).collect()}
    assert got[3] == pytest.approx(2 * 8) and got[4] == pytest.approx(2 * 9) and got.get(7, 0) == 0


def test_detach_delete_query_marks_only_orders_of_deleted_customers(spark):
    from lodestrata.queries import QUERIES
    from tests.conftest import SF

    got = {r["id"]: r["tombstone"] for r in QUERIES["write_detach_delete"](spark, SF).collect()}
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    assert got == {f"PLACED_BY|o{o}|c{c}": c % 5 == 0 for o, c in orders} and len(set(got.values())) == 2
