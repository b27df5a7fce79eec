"""op7: near-duplicate classes against brute force, and its edge cases."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import minhash
from lodestrata.llm.components import connected_components
from lodestrata.llm.minhash import NearDuplicateParams, drop_near_duplicates, near_duplicates
from tests.llm.frames import documents, empty_documents, odd_documents


def brute(rows, n, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def noisy_rows(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(6):
        text = [rng.choice(words) for _ in range(rng.choice([3, 40, 90]))]
        for _ in range(rng.choice([1, 8, 25])):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.02, 0.06]) else w for w in text]
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,shingle,tile", [(1, 2, 512), (2, 2, 4), (3, 5, 512)])
def test_matches_brute_force(spark, seed, shingle, tile):
    """A tile of four rows makes the groups cross tiles."""
    rows = noisy_rows(seed)
    got = near_duplicates(documents(spark, rows), NearDuplicateParams(shingle=shingle, tile=tile)).collect()
    expected = brute(rows, shingle, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_without_broadcasts(spark):
    rows = noisy_rows(4)
    got = near_duplicates(documents(spark, rows), NearDuplicateParams(shingle=2, broadcast_rows=0)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 2, 80)


def test_odd_rows(spark):
    got = near_duplicates(odd_documents(spark)).collect()
    assert len(got) == 12
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0
    assert by[6]["component_id"] == 4 and not by[6]["kept"]
    assert sum(r["doc_id"] == 5 and r["kept"] for r in got) == 2
    assert all(r["kept"] for r in got if r["doc_id"] is None)


def test_empty_table(spark):
    assert near_duplicates(empty_documents(spark)).count() == 0
    assert drop_near_duplicates(empty_documents(spark)).count() == 0


def test_drop_keeps_one_of_each_group(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = documents(spark, [(3, text), (1, text + " end"), (2, "other text of its own kind here"), (1, text + " end"), (9, None)])
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 9]


def test_near_misses_leave_tiles_as_links_only(spark, monkeypatch):
    """Texts that nearly all miss the threshold: rows written by the search grow with the group, not with its square."""
    from lodestrata.llm import minhash

    written = {}
    plain = minhash.materialize

    def counted(df, name):
        out = plain(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    sizes = {}
    for g in (150, 600):
        rng = random.Random(g)
        base = [f"w{k}" for k in range(100)]
        rows = []
        for i in range(g):
            text = list(base)
            for k in rng.sample(range(100), 4):
                text[k] = f"x{i}_{k}"
            rows.append((i, " ".join(text)))
        written.clear()
        got = near_duplicates(documents(spark, rows), NearDuplicateParams(shingle=2, tile=64)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 2, 80)
        sizes[g] = sum(n for name, n in written.items() if name in ("nd-star", "nd-cross", "nd-sparse", "nd-dense-links", "nd-outlier-links"))
    assert sizes[600] < 6 * sizes[150], sizes  # four times the texts, sixteen times the pairs


def test_signatures_meet_each_node_once(spark):
    """A node of many keys meets its signature in one joined row, and whole sets are put together for the nodes that are asked for."""
    from lodestrata.llm import minhash

    nodes = spark.createDataFrame([(n, bytes([n] * 200), 9) for n in range(5)], "node long, signature binary, n_shingles long")
    members = spark.createDataFrame([(key, n, 0, 0, 1, 1) for n in range(3) for key in range(100)], "key long, node long, root long, major long, tiles long, outer_tiles long")
    out = minhash._with_signatures(members, nodes)
    joins = []

    def visit(plan):
        if plan.nodeName() in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin"):
            joins.append(plan.metrics().apply("numOutputRows").value())
        for k in range(plan.children().size()):
            visit(plan.children().apply(k))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = out._jdf.queryExecution()
        assert run.executedPlan().executeCollect() is not None
        visit(run.executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert joins == [3]
    got = {(r["key"], r["node"]): (bytes(r["signature"]), r["n_shingles"]) for r in out.collect()}
    assert got == {(key, n): (bytes([n] * 200), 9) for n in range(3) for key in range(100)}
    sets = spark.createDataFrame([(n, bytes([n] * 8)) for n in range(5)], "node long, items binary")
    assert sorted(r["node"] for r in minhash._whole(members, nodes, sets).collect()) == [0, 1, 2]


def outlier_joins(spark, after):
    """Rows made by each run of the join that finds members outside of their key's largest component, and the last execution's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    ids = [runs.apply(k).executionId() for k in range(runs.size())]
    made = []
    for run in ids:
        if run <= after:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for k in range(nodes.size()):
            node, metrics = nodes.apply(k), nodes.apply(k).metrics()
            if "Join" in node.name() and re.search(r"NOT \(root#\d+L? = major#", node.desc()):
                rows = [values.get(metrics.apply(m).accumulatorId()) for m in range(metrics.size()) if metrics.apply(m).name() == "number of output rows"]
                made += [int(r.get().replace(",", "")) for r in rows if r.isDefined()]
    return [n for n in made if n], max(ids, default=-1)


def test_outliers_are_joined_once_a_round(spark, monkeypatch):
    """Rows of the join of members with their keys: one run for each change of the components, a row for a node and kind of key at most."""
    written = []
    plain = minhash.materialize

    def named(df, name):
        out = plain(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(minhash, "materialize", named)
    rows_of = {}
    for g in (100, 400):
        rng = random.Random(g)
        rows = []
        for i in range(g):
            text = [f"w{k}" for k in range(100)]
            for k in rng.sample(range(100), rng.choice([3, 4, 5])):
                text[k] = f"x{i}_{k}"
            rows.append((i, " ".join(text)))
        written.clear()
        after = outlier_joins(spark, -1)[1]
        got = near_duplicates(documents(spark, rows), NearDuplicateParams(shingle=2)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 2, 80)
        made = outlier_joins(spark, after)[0]
        rounds = [n for name, n in written if name == "nd-roots"]
        gains = [n for name, n in written if name in ("nd-star-links", "nd-cross-links") and n]
        assert made and len(made) <= len(rounds) <= 1 + len(gains), (made, written)
        assert max(made) <= 100 * g
        rows_of[g] = sum(made)
    assert rows_of[400] <= 8 * rows_of[100], rows_of  # four times the texts, sixteen times the pairs


def test_names_of_any_type(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([("b", text), ("a", text + " end"), ("c", "other text of its own")], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}
    assert sorted(r["doc_id"] for r in drop_near_duplicates(docs).collect()) == ["a", "c"]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32))
def test_pigeonhole_guarantee(seed):
    """Signatures within the guaranteed distance always share a key."""
    import numpy as np

    p = NearDuplicateParams()
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, p.symbols)
    b = a.copy()
    b[rng.choice(p.symbols, p.distance, replace=False)] ^= 1
    equal = (a == b).reshape(p.chunks, p.chunk_symbols)
    assert any(equal[:, list(k)].all(axis=1).any() for k in p.kept_symbols)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(None, 3), (200, 201)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[201] == 200
    assert minhash.shingle_set(__import__("numpy").array([3, 1, 3], dtype="uint64")).tolist() == [1, 3]
