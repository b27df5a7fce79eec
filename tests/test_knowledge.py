"""Operators against brute force where SQL has no say, and the cases that caps used to cut."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.scalars import number_form
from lodestrata.operators import catalog, datalog, features, graph, ingest, joins, matrix, ordered, retrieval, rules, text, vector
from lodestrata.operators.model import star_graph
from lodestrata.plans.engine import Engine
from lodestrata.runtime import table
from tests.conftest import SF


def random_edges(seed, nodes, n):
    rng = random.Random(seed)
    return sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)})


def test_csv_lines_like_the_header_are_data(spark, tmp_path):
    for name, body in (("a.csv", "id,label,x\n1,A,5\nid,label,x\n\n2,B"), ("b.csv", 'id,label,x\n3,C,"7\n')):
        (tmp_path / name).write_text(body)
    nodes, errors = ingest.read_csv_nodes(spark, f"file://{tmp_path}/*.csv")
    assert sorted(r["id"] for r in nodes.collect()) == ["1", "3", "id"]
    assert [r["value"] for r in errors.collect()] == ["2,B"]


def test_number_forms_sort_as_numbers(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, -1.0, 9.999, 10.0, -10.0, 0.1, -0.1, 1e-7, -1e-7, 2e25, -2e25, 999999999.5, -999999999.5]
    values += [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-9, 12) for _ in range(400)]
    assert spark.createDataFrame([(x,) for x in ("111", "-2", "+aE1.11", "0.00", "1e30", "x", "", None, "-0.5")], "v string").select(number_form(F.col("v"))).collect() == [
        ("+cE1.11",), ("!ZE8",), ("+aE1.11",), ("+AE0",), (None,), (None,), (None,), (None,), ("!aE5",)
    ]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", number_form(F.col("v")).alias("f")).collect()
    assert [r["v"] for r in sorted(rows, key=lambda r: r["f"])] == sorted(values)


def test_everything_is_reached(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "id long")
    assert graph.reachable(edges, seeds).count() == 13


def test_push_in_arrays_is_the_push_of_frames(spark):
    edges = [(a, b, 1.0 + (a + b) % 3) for a, b in random_edges(3, 60, 200)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    seeds = spark.createDataFrame([(edges[0][0], 2.0), (edges[9][0], 1.0)], "id long, weight double")
    one = {r["id"]: r["score"] for r in graph.personalized_pagerank(df, seeds, epsilon=2e-2).collect()}
    other = {r["id"]: r["score"] for r in graph.personalized_pagerank(df, seeds, epsilon=2e-2, local_edges=0).collect()}
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-12 for k in one)
    assert 0.3 < sum(one.values()) <= 1


def test_betweenness_and_bridges(spark):
    pairs = {(min(a, b), max(a, b)) for a, b in random_edges(7, 14, 17) if a != b}
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in range(14)}

    def reach(start, skip=None):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for y in near[x] - seen:
                if skip != (min(x, y), max(x, y)):
                    seen.add(y)
                    todo.append(y)
        return seen

    def paths(a, b):
        best, todo = [], [[a]]
        while todo and not best:
            best = [p for p in todo if p[-1] == b]
            todo = [[*p, y] for p in todo for y in near[p[-1]] if y not in p]
        return best

    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    both = graph.undirected(edges)
    ids = both.select(F.col("src").alias("id")).distinct()
    expected = {v: 0.0 for v in range(14)}
    for a in near:
        for b in near:
            found = paths(a, b) if a != b and near[a] and b in reach(a) else []
            for p in found:
                for v in p[1:-1]:
                    expected[v] += 1 / len(found)
    got = {r["id"]: r["score"] for r in graph.betweenness(both, ids).collect()}
    assert all(abs(got.get(v, 0.0) - x) < 1e-9 for v, x in expected.items())
    cut = {e for e in pairs if e[1] not in reach(e[0], e)}
    assert {tuple(r) for r in graph.bridges(edges, ids).select("src", "dst").collect()} == cut


def test_hubs_meet_themselves_in_tiles(spark):
    edges = spark.createDataFrame([(i, 0) for i in range(1, 30)] + [(1, 99), (2, 99)], "src long, dst long")
    got = {tuple(r) for r in joins.paired(edges, tile=4).collect()}
    assert got == {(0, u, v) for u in range(1, 30) for v in range(1, 30) if u != v} | {(99, 1, 2), (99, 2, 1)}


def test_recall_has_no_cap(spark):
    rows = [(i, "words", 0.0, 0, 0, float(i), 0, 1) for i in range(1500)]
    items = spark.createDataFrame(rows, "id long, text string, ppr double, activation int, fitness int, updated_ms double, permeability int, tokens int")
    got = retrieval.memory_recall(items, "none", 1400).select("id", "rank").collect()
    assert len(got) == 1400 and {(r["id"], r["rank"]) for r in got} == {(1499 - k, k + 1) for k in range(1400)}
    totals = ordered.running_totals(items, [F.col("id")], "id").select("id", "rank", "running").collect()
    assert all(r["rank"] == r["id"] + 1 and r["running"] == r["id"] * (r["id"] + 1) // 2 for r in totals)


def test_support_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 1, 0.5), (1, 3, 0.2)], "src long, dst long, confidence double")
    got = {(r["src"], r["dst"], r["hops"]): round(r["confidence"], 6) for r in rules.support_closure(edges).collect()}
    assert got == {(1, 3, 2): 0.648, (2, 1, 2): 0.36, (3, 2, 2): 0.405}


def test_saturation_keeps_the_best(spark):
    base = spark.createDataFrame([("e", "a", "b", 0.5), ("e", "b", "c", 0.5), ("e", "a", "c", 0.1), ("e", "c", "a", 1.0)], "pred string, a string, b string, confidence double")
    closed = datalog.saturate(base, [("t", [("e", "x", "y")]), ("t", [("t", "x", "z"), ("e", "z", "y")]), ("back", [("e", "y", "x")])])
    got = {(r["pred"], r["a"], r["b"]): r["confidence"] for r in closed.collect()}
    assert got["t", "a", "c"] == 0.25 and got["t", "c", "c"] == 0.25 and got["back", "b", "a"] == 0.5
    assert datalog.prune(closed, 0.4).where("pred = 't'").count() == 5
    rules_ = datalog.RuleSet()
    with pytest.raises(ValueError):
        rules_.run({})
    with pytest.raises(KeyError):
        rules_.run({}, ["unknown"])


def test_searches_against_plain_loops(spark):
    rng = random.Random(5)
    vec = lambda: [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(6)]
    rows = [(i, vec()) for i in range(60)] + [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (103, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = lambda a, b: 0.0 if not dot(a, a) or not dot(b, b) else dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5
    good = [(i, v) for i, v in rows if v and None not in v]
    expected = set()
    for q, v in good:
        if q % 10 == 0:
            best = sorted((-round(cos(v, w), 9), i) for i, w in good if i != q)[:4]
            expected |= {(q, i, k + 1) for k, (_, i) in enumerate(best)}
    got = vector.knn_join(df.where("id % 10 = 0"), df, 4, block=3).withColumn("score", F.round("score", 9))
    scores = {(r["query_id"], r["rank"]): r["score"] for r in got.collect()}
    assert scores == {(q, k): round(cos(dict(good)[q], dict(good)[i]), 9) for q, i, k in expected}
    multi = df.where("id < 60").groupBy(F.floor(F.col("id") / 5).alias("id")).agg(F.collect_list("vector").alias("vectors"))
    sets = {r["id"]: r["vectors"] for r in multi.collect()}
    for binary in (False, True):
        sign = lambda v: [1.0 if x >= 0 else -1.0 for x in v]
        one = (lambda a, b: dot(sign(a), sign(b)) / 6) if binary else dot
        scored = {(q, d): sum(max(one(a, b) for b in sets[d]) for a in sets[q]) for q in sets for d in sets}
        found = vector.maxsim_rank(multi, multi, 3, binary, block=4).collect()
        assert len(found) == 3 * len(sets) and all(abs(r["score"] - scored[r["query_id"], r["id"]]) < 1e-9 for r in found)
        for q in sets:
            top = sorted((scored[q, d] for d in sets), reverse=True)[:3]
            assert [round(r["score"], 9) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == [round(x, 9) for x in top]
    assert {len(m) for m in sets.values()} == {5}


def test_hash_embeddings(spark):
    words = ["the", "cat", "the", "mat", "été"]
    got = spark.createDataFrame([(words,), ([],)], "w array<string>").select(vector.hash_embedding(F.col("w"), 8).alias("v")).collect()
    counts = [sum(zlib.crc32(w.encode()) % 8 == b for w in words) for b in range(8)]
    norm = sum(c * c for c in counts) ** 0.5
    assert all(abs(x - c / norm) < 1e-12 for x, c in zip(got[0]["v"], counts)) and got[1]["v"] == [0.0] * 8


def test_unit_vectors_are_computed_once(spark):
    """A vector that is computed from a row is computed once, not for each component."""
    from pyspark.sql.types import ArrayType, DoubleType

    calls = spark.sparkContext.accumulator(0)

    def made(n):
        calls.add(1)
        return [3.0, 4.0] * n

    slow = F.udf(made, ArrayType(DoubleType())).asNondeterministic()
    got = [list(r["v"]) for r in spark.range(1, 3).select(vector.unit(slow(F.col("id"))).alias("v")).collect()]
    norms = [5.0 * n**0.5 for n in (1, 2)]
    assert got == [[x / n for x in [3.0, 4.0] * k] for k, n in zip((1, 2), norms)]
    assert calls.value == 2
    odd = spark.createDataFrame([(None,), ([],), ([0.0, 0.0],)], "v array<double>").select(vector.unit(F.col("v")).alias("v")).collect()
    assert [r["v"] for r in odd] == [None, [], [0.0, 0.0]]


def test_index_and_scan_agree(spark):
    docs = spark.createDataFrame([(1, "The cat sat. The CAT!"), (2, "dog_1 and cat"), (3, None), (4, ""), (5, "the of and")], "id long, text string")
    one = {r["id"]: round(r["score"], 9) for r in text.bm25(docs, "cat dog_1 the").collect()}
    index = text.Bm25Index(docs)
    assert {r["id"]: round(r["score"], 9) for r in index.search("cat dog_1 the").collect()} == one and set(one) == {1, 2}
    assert index.search("the of").count() == 0 and text.bm25(docs, "").count() == 0


def test_statements_that_write_refuse(spark):
    nodes, edges = star_graph({n: table(spark, SF, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")})
    g = Engine(spark, nodes=nodes, edges=edges)
    for wrong in (
        "CREATE (n:Nation {id: 'n3'})", "MATCH (n:Nation {id: 'n3'}) DELETE n", "MATCH (n:Nation) SET n.id = 'x'", "CREATE (a)-[]->(b)",
        "MERGE (n:Nation {id: 'n3'}) ON DELETE SET n.a = 1", "MATCH (n:Nation)", "RETURN 1", "CREATE (a:X {id: 'q'}) RETURN a",
    ):
        with pytest.raises(ValueError):
            g.execute(wrong)


def test_features_are_refused(spark):
    deep = {"op": "const", "value": 1}
    for _ in range(9):
        deep = {"op": "max", "args": [deep]}
    for wrong in (deep, {"op": "shell", "args": []}, {"op": "count", "hop": "none"}, {"op": "not", "args": []}):
        with pytest.raises(ValueError):
            features.compile_feature(wrong)


def test_sources_of_statements(spark):
    assert catalog.sources_of(spark, "WITH x AS (SELECT * FROM a JOIN b ON a.k = b.k), y AS (SELECT * FROM x) SELECT * FROM y JOIN c ON y.k = c.k") == ["a", "b", "c"]
    assert {"a", "b", "c"} <= set(catalog.sources_of(spark, "SELECT * FROM a JOIN b ON a.k = b.k UNION ALL SELECT * FROM c"))
    with pytest.raises(ValueError):
        matrix.matrix_vector(spark.range(1), spark.range(1), "none")


@pytest.mark.parametrize("tile", [7, 2_000_000])
def test_two_hops_in_tiles(spark, monkeypatch, tile):
    """Triangles, nearest by shared neighbours and link candidates of a random graph with a hub, in one tile and in many; no join makes a row for a path."""
    import itertools
    import random

    from lodestrata.operators import graph, hops, joins, retrieval

    whole = hops.two_hops
    monkeypatch.setattr(hops, "two_hops", lambda *args: whole(*args, tile=tile))
    monkeypatch.setattr(joins, "paired", None)
    rng = random.Random(5)
    pairs = {(a, b) for a in range(18) for b in range(a + 1, 18) if rng.random() < 0.25} | {(0, b) for b in range(1, 18)}
    near = {n: {b if a == n else a for a, b in pairs if n in (a, b)} for n in range(18)}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    assert {tuple(r) for r in graph.triangles(edges).collect()} == {t for t in itertools.combinations(range(18), 3) if set(itertools.combinations(t, 2)) <= pairs}
    expected = set()
    for u in near:
        scores = sorted((-len(near[u] & near[v]) / (len(near[u]) * len(near[v])) ** 0.5, v) for v in near if v != u and near[u] & near[v])
        expected |= {(u, v, -s, i + 1) for i, (s, v) in enumerate(scores[:3])}
    assert {tuple(r) for r in graph.structural_knn(edges, 3).collect()} == expected
    links = {(a, b, len(near[a] & near[b])) for a, b in itertools.combinations(range(18), 2) if (a, b) not in pairs and len(near[a] & near[b]) >= 2}
    assert {tuple(r) for r in retrieval.link_candidates(edges, 2).collect()} == links


def test_pairs_below_a_bound_are_counted(spark):
    from lodestrata.operators.joins import count_below

    nan = float("nan")
    left = spark.createDataFrame([(1, 2.0), (1, 9.0), (2, 1.0), (3, None), (4, nan), (None, 9.0), (5, -0.0), (6, -5.0)], "k long, b double")
    right = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (0.0,), (None,), (nan,), (-1.0,)], "x double")
    out = count_below(left, "k", F.col("b"), right, F.col("x"))
    left.createOrReplaceTempView("bounds")
    right.createOrReplaceTempView("vals")
    expected = spark.sql("SELECT k, count(*) AS n FROM bounds JOIN vals ON x < b GROUP BY k").collect()
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, expected), key=str)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(("run", "block"), [(256, 16_384), (3, 7)])
def test_overlapping_intervals_meet_in_lists(spark, run, block):
    """Equal to brute force with many equal starts, ids that repeat, nulls and a long interval; in one list and task for a cell, and in many."""
    import random

    rng = random.Random(3)
    rows = [(i, s := rng.choice([5, 5, 5, rng.randrange(-40, 40)]), s + rng.randrange(4)) for i in range(90)]
    rows += [(7, 5, 6), (7, 5, 6), (None, 5, 5), (None, 4, 9), (200, None, 5), (201, 5, None), (202, -30, 30), (203, 9, 8), (204, 9, -60)]
    found = matrix.overlapping(spark.createDataFrame(rows, "id long, start long, stop long"), 2, 8, run, block)

    def first(a, b):
        return a[1] < b[1] or a[1] == b[1] and None not in (a[0], b[0]) and a[0] < b[0]

    placed = [r for r in rows if r[1] is not None]
    expected = [(a[0], b[0], max(b[1] - a[2], 0)) for a in placed for b in placed if a[2] is not None and first(a, b) and b[1] - a[2] <= 2]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_pairs_of_intervals_take_little_disk(spark, tmp_path):
    """A result that grows with the square of the intervals is written as runs and repeats: less than half a byte a pair."""
    x = F.col("id")
    intervals = spark.range(9000).select("id", (x * 13 % 20).alias("start"), (x * 13 % 20 + x % 5).alias("stop"))
    matrix.overlapping(intervals, 2, 16).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert pairs > 10_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < pairs / 2


def _scratch_bytes(spark, run):
    """Rows of a result and the bytes of the scratch tables that it wrote."""
    import os

    from lodestrata import runtime

    runtime.release(spark)
    rows = [tuple(r) for r in run().collect()]
    paths = [path.removeprefix("file://") for owner, path in runtime._SCRATCH if owner is spark]
    return rows, sum(os.path.getsize(os.path.join(folder, f)) for path in paths for folder, _, names in os.walk(path) for f in names)


def _random_graph(nodes: int, pairs: int):
    import numpy as np

    ends = np.random.default_rng(3).integers(0, nodes, (pairs, 2))
    return {(min(a, b), max(a, b)) for a, b in ends.tolist() if a != b}


def test_structural_knn_keeps_little_on_disk(spark):
    """Lists are packed: a pair takes less than 8 bytes of all scratch tables together."""
    from lodestrata.operators import graph

    pairs = _random_graph(20_000, 200_000)
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    rows, size = _scratch_bytes(spark, lambda: graph.structural_knn(edges, 1))
    assert len(rows) == 20_000 and size < 8 * len(pairs)


def test_structural_knn_of_any_ids(spark):
    """Names, far apart and negative numbers, nulls, loops and repeats."""
    from lodestrata.operators import graph

    pairs = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 4), (None, 1), (1, None), (2, 3)]
    for kind, ids in (("string", ["", "a", "b", "c", "d"]), ("long", [0, -(1 << 62), -1, 5, 1 << 62]), ("int", [0, 7, 8, 9, 10])):
        edges = spark.createDataFrame([tuple(None if x is None else ids[x] for x in p) for p in pairs], f"src {kind}, dst {kind}")
        root = 2**-0.5
        got = {(r["u"], r["v"], r["rank"]): round(r["score"], 9) for r in graph.structural_knn(edges, 2).collect()}
        assert got == {(ids[1], ids[3], 1): round(root, 9), (ids[3], ids[1], 1): round(root, 9), (ids[2], ids[4], 1): round(root, 9), (ids[4], ids[2], 1): round(root, 9)}
        assert graph.structural_knn(edges.limit(0), 2).count() == 0


def test_link_candidates_keep_little_on_disk(spark):
    from lodestrata.operators import retrieval

    pairs = _random_graph(20_000, 200_000)
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    rows, size = _scratch_bytes(spark, lambda: retrieval.link_candidates(edges, 4))
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert rows and all(len(near[a] & near[b]) == n and b not in near[a] for a, b, n in rows) and size < 8 * len(pairs)


def test_pairs_within_groups(spark):
    from lodestrata.operators.packs import pairs_within

    lines = spark.createDataFrame([(1, 5), (1, 3), (1, 3), (1, 9), (2, 3), (2, 5), (3, 1), (None, 1), (None, 2), (4, None)], "g long, m int")
    assert sorted(tuple(r) for r in pairs_within(lines, "g", "m").collect()) == [(3, 5), (3, 5), (3, 9), (5, 9)]
