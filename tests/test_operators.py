"""Operators on small frames whose results are known."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import fusion, graph, ingest, ordered, rules, spatial, temporal, text, vector
from lodestrata.operators.versioning import diff, merge
from lodestrata.plans.cypher import run as cypher
from lodestrata.plans.engine import Engine
from lodestrata.plans.ir import Join, QueryIr, compile_query


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_bm25_prefers_the_matching_document(spark):
    docs = spark.createDataFrame([("d1", "rust programming language"), ("d2", "python programming"), ("d3", "graph database")], "id string, text string")
    rows = text.bm25(docs, "rust programming").orderBy(F.col("score").desc()).collect()
    assert [r["id"] for r in rows] == ["d1", "d2"]
    idf = math.log((3 - 1 + 0.5) / 1.5 + 1)
    assert rows[0]["score"] > idf * 0.9


def test_bm25_of_an_empty_table(spark):
    assert text.bm25(spark.createDataFrame([], "id string, text string"), "a word").count() == 0


def test_rank_fusion(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "id string, score double")
    b = spark.createDataFrame([("y", 9.0), ("z", 1.0)], "id string, score double")
    got = {r["id"]: r["score"] for r in fusion.reciprocal_rank_fusion([fusion.ranked(a, "a"), fusion.ranked(b, "b")]).collect()}
    assert got["y"] == pytest.approx(1 / 62 + 1 / 61)
    assert got["x"] == pytest.approx(1 / 61)


def test_ppr_agrees_with_power_iteration(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 1), (2, 4)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(1, 1.0)], "id long, weight double")
    got = {r["id"]: r["score"] for r in graph.personalized_pagerank(edges, seeds, epsilon=1e-7).collect()}
    rank = {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    start = dict(rank)
    for _ in range(300):
        new = {n: 0.15 * start[n] for n in rank}
        for a, b in pairs:
            new[b] += 0.85 * rank[a] / sum(1 for s, _ in pairs if s == a)
        rank = new
    for node, value in rank.items():
        assert got[node] == pytest.approx(value, abs=1e-5)


def test_strong_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    got = {r["id"]: r["scc"] for r in graph.strongly_connected(edges, nodes).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_loops_end_whole_or_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 8)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    assert {r["id"]: r["scc"] for r in graph.strongly_connected(chain, nodes, 3).collect()} == {i: i for i in range(1, 9)}
    pairs = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.strongly_connected(pairs, nodes.where("id <= 4"), 1)
    with pytest.raises(RuntimeError):
        graph.shortest_path_costs(chain.withColumn("weight", F.lit(1.0)), 1, 3)
    with pytest.raises(RuntimeError):
        graph.betweenness(chain, nodes.where("id = 1"), 3)
    with pytest.raises(RuntimeError):
        graph.cfl_reachability(chain.withColumn("label", F.lit("e")), [], [("e", "e", "e")], 1)
    ladder = spark.createDataFrame([(i, i + d) for i in range(6) for d in (1, 2)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.k_truss(ladder, 4, 1)


def test_k_truss_and_triangles(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (4, 5)], "src long, dst long")
    assert graph.triangles(edges).count() == 4
    assert {tuple(r) for r in graph.k_truss(edges, 4).collect()} == {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)}


@pytest.mark.parametrize("array_triangles", [0, 6_000_000])
def test_k_truss_finds_triangles_once(spark, monkeypatch, array_triangles):
    """A strip that peels in many rounds beside a clique that stays: by joins and in arrays."""
    whole, calls = graph.triangles, []
    monkeypatch.setattr(graph, "triangles", lambda e: calls.append(1) or whole(e))
    clique = [(a, b) for a in range(100, 105) for b in range(a + 1, 105)]
    edges = spark.createDataFrame([(i, i + d) for i in range(12) for d in (1, 2)] + clique, "src long, dst long")
    assert {tuple(r) for r in graph.k_truss(edges, 4, array_triangles=array_triangles).collect()} == set(clique)
    assert len(calls) == 1
    assert graph.k_truss(edges, 9, array_triangles=array_triangles).count() == 0


@pytest.mark.parametrize("array_triangles", [60, 6_000_000])
def test_k_truss_peels_in_ranges_without_joins(spark, monkeypatch, array_triangles):
    """A random graph, a strip that peels from range to range and a clique: as peeled one edge at a time."""
    import itertools
    import random

    monkeypatch.setattr(graph, "_truss_by_joins", None)
    rng = random.Random(7)
    pairs = {p for p in itertools.combinations(range(40), 2) if rng.random() < 0.17} | {(i, i + d) for i in range(100, 120) for d in (1, 2)}
    pairs |= set(itertools.combinations(range(200, 205), 2))
    kept = set(pairs)
    while True:
        near = {}
        for a, b in kept:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        weak = {(a, b) for a, b in kept if len(near[a] & near[b]) < 2}
        if not weak:
            break
        kept -= weak
    assert 10 < len(kept) < len(pairs)
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    assert sorted(tuple(r) for r in graph.k_truss(edges, 4, array_triangles=array_triangles).collect()) == sorted(kept)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "id long")
    got = {r["id"]: r["component"] for r in graph.components(edges, nodes).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 200


def test_as_of_join(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("c", 1, "z")], "k string, u int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in temporal.as_of_join(left, right, "k", "t", "u", ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None}


def test_merge_reports_conflicts(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, v string")
    base, ours, theirs = make([(1, "a"), (2, "b"), (3, "c")]), make([(1, "A"), (2, "b"), (3, "x")]), make([(1, "a"), (2, "B"), (3, "y"), (4, "n")])
    merged, conflicts = merge(base, ours, theirs, "id")
    assert {tuple(r) for r in merged.collect()} == {(1, "A"), (2, "B"), (3, "x"), (4, "n")}
    assert [r["id"] for r in conflicts.collect()] == [3]
    assert {tuple(r) for r in diff(base, ours, "id").collect()} == {(1, "changed"), (3, "changed")}


def test_sorted_set(spark):
    e = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "member string, score double")
    added = ordered.zadd(e, spark.createDataFrame([("a", 9.0), ("d", float("inf"))], "member string, score double"))
    assert {tuple(r) for r in added.collect()} == {("a", 9.0), ("b", 3.0), ("c", 2.0)}
    assert {r["member"]: r["rank"] for r in ordered.zrank(added).collect()} == {"c": 0, "b": 1, "a": 2}


def test_radius_and_near_pairs(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.5), (3, 50.0, 9.0)], "id int, lat double, lon double")
    assert [r["id"] for r in spatial.radius_search(p, 0.0, 0.1, 60).orderBy("id").collect()] == [1, 2]
    assert [(r["a"], r["b"]) for r in spatial.near_pairs(p, 60).collect()] == [(1, 2)]


def test_reliability_and_closure(spark):
    r = rules.reliability(spark.createDataFrame([(3, 1)], "g int, b int"), "g", "b").first()
    assert r["mean"] == pytest.approx(4 / 6)
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 1, 1.0)], "src int, dst int, confidence double")
    got = {(x["src"], x["dst"]): x["confidence"] for x in rules.support_closure(e).collect()}
    assert got[(1, 3)] == pytest.approx(0.9 * 0.8 * 0.9) and (1, 1) not in got


def test_cypher_refuses_other_clauses(spark):
    nodes = spark.createDataFrame([("a", ["X"], "{}", 1, False)], "id string, labels array<string>, properties string, version int, tombstone boolean")
    edges = spark.createDataFrame([], "id string, from_id string, to_id string, type string, confidence double, tombstone boolean")
    with pytest.raises(ValueError):
        cypher("OPTIONAL MATCH (a) RETURN a", nodes, edges, {})
    assert cypher("MATCH (a:X) RETURN count(*) AS n", nodes, edges, {}).first()["n"] == 1


def test_unjoined_relations_are_refused(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        compile_query(QueryIr({"a": "t", "b": "t"}), {"t": df})
    assert compile_query(QueryIr({"a": "t", "b": "t"}, (), (Join("a", "id", "b", "id"),)), {"t": df}).count() == 3


def test_engine_ddl(spark):
    e = Engine(spark, {"t": spark.range(5)})
    e.create_table_as("u", "SELECT id FROM t WHERE id > 2")
    e.insert_into("u", "SELECT id, 'x' AS tag FROM t WHERE id = 0")
    assert e.relations["u"].count() == 3
    e.rename("u", "w")
    assert e.test_unique("w", "id").count() == 0 and e.test_not_null("w", "tag").count() == 2
    assert e.drop("w") and not e.drop("w", if_exists=True)
    assert "Physical Plan" in e.explain("SELECT count(*) FROM t")


def test_normalisers(spark):
    assert one(spark, S.number_form(F.lit("111"))) == "+cE1.11"
    assert one(spark, S.date_form(F.lit("2024-02-29 12:01:47"))) == "2024-02-29T12:01:47.000Z"
    assert one(spark, S.date_form(F.lit("no date"))) is None
    assert one(spark, S.url_normal(F.lit("HTTP://Ex.com/a/?b=2&utm_source=x&a=1#f"))) == "http://ex.com/a?a=1&b=2"
    assert one(spark, S.camel(F.lit("some-word here"))) == "someWordHere"
    assert one(spark, S.table_text(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2"))))) == "| a | b |\n| - | - |\n| 1 | 2 |"


def test_vectors(spark):
    p = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("z", [1.0])], "id string, vector array<double>")
    assert [r["id"] for r in vector.knn(p, [1.0, 0.0], 2).collect()] == ["a", "b"]
    assert vector.storage_bytes(32, 128) == {"f32": 16384, "f16": 8192, "binary": 512}


def test_accelerated_knn_against_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(size=(400, 16))
    v[5] = v[4]
    p = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    found = {}
    for r in vector.accelerated_knn_join(p.where("id % 20 = 0"), p, 5, 16).orderBy("query_id", "distance", "id").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    truth = {q: sorted(range(400), key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i))[:5] for q in range(0, 400, 20)}
    assert sum(len(set(found[q]) & set(truth[q])) for q in truth) / 100 >= 0.9
    assert found == truth
    assert [r["id"] for r in vector.accelerated_knn(p, [float(x) for x in v[20]], 5).collect()] == truth[20]


def test_recall_is_measured(spark, monkeypatch):
    """A search that finds three of five is reported as 0.6."""
    from lodestrata.queries import QUERIES
    from tests.conftest import SF

    assert QUERIES["rel_recall_vs_exact"](spark, SF).first()["recall"] == 1.0
    whole = vector.accelerated_knn_join
    monkeypatch.setattr(vector, "accelerated_knn_join", lambda queries, points, k, dims: whole(queries, points, 3, dims))
    assert QUERIES["rel_recall_vs_exact"](spark, SF).first()["recall"] == pytest.approx(0.6)


def test_nearest_are_found_without_rows_for_pairs(spark):
    """Both searches agree, with odd vectors among the points, and no plan crosses queries with points."""
    import numpy as np

    v = np.random.default_rng(3).normal(size=(300, 8)).tolist()
    rows = [*enumerate(v), (300, [0.0] * 8), (301, None), (302, [1.0]), (303, [None] * 8)]
    p = spark.createDataFrame(rows, "id long, vector array<double>")
    exact, quick = vector.exact_knn_join(p.where("id % 30 = 0"), p, 4), vector.accelerated_knn_join(p.where("id % 30 = 0"), p, 4, 8)
    got = {(r["query_id"], r["id"]) for r in exact.collect()}
    unit = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 300, 30):
        assert {i for x, i in got if x == q} == set(np.argsort(-(unit @ unit[q]))[:4].tolist())
    assert {(r["query_id"], r["id"]) for r in quick.collect()} == got
    for found in (exact, quick):
        assert not re.search("CartesianProduct|NestedLoop", found._jdf.queryExecution().toString())


def test_csv_and_jsonl_readers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,label,name\n1,City,Flint\n2,City\n")
    nodes, errors = ingest.read_csv_nodes(spark, str(tmp_path / "n.csv"))
    assert nodes.first()["properties"] == '{"name":"Flint"}' and errors.count() == 1
    (tmp_path / "e.jsonl").write_text('{"id":"a"}\n{bad\n{"x":1}\n')
    good, bad = ingest.read_jsonl(spark, str(tmp_path / "e.jsonl"), "id string", ["id"])
    assert good.count() == 1 and bad.count() == 2


def test_passage_scores_count_each_term(spark):
    body = "The idiot met another idiot. A moron too."
    found = spark.createDataFrame([("d", 0, body), ("d", 1, "No such word in it."), ("e", 0, "Moron, moron and Moron")], "id string, passage int, body string")
    got = {(r["id"], r["passage"]): r["score"] for r in text.passage_scores(found, "idiot moron").collect()}
    assert got == pytest.approx({("d", 0): (2 / 3.2 + 1 / 2.2) / (1 + 8 / 240), ("e", 0): 3 / 4.2 / 2 / (1 + 4 / 240)})


def test_excerpt_query_keeps_best_passages_of_each_document(spark):
    from lodestrata.queries import QUERIES
    from tests.conftest import SF

    rows = QUERIES["text_excerpt"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    holding = set()
    for name, body in texts.items():
        for line in (body or "").split("\n"):
            words = re.findall(r"[^\W_]+", line.lower())
            if len(line.strip(" ")) >= 24 and len(words) >= 4 and {"stupid", "moron"} & set(words):
                holding.add(name)
    assert {r["id"] for r in rows if r["rank"] == 1} == {r["id"] for r in rows} == holding
    assert all(r["rank"] == 1 or r["chars"] <= 400 for r in rows)
