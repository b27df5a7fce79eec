"""op9 against brute force, op2 through its versions, and the pipeline against its stages' rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.llm.knn import TopKParams, top_k
from lodestrata.llm.sharding import CommitConflict, Shard, ShardParams, ShardStore


def brute(rows, k):
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in clean}:
        if q % 5:
            continue
        found = {(-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q and len(w) == len(v)}
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("block,slice_rows", [(4096, 32768), (3, 7)])
def test_top_k(spark, block, slice_rows):
    """Small blocks make many groups and slices; a third of the rows share one vector, and scores tie."""
    rng = random.Random(7)
    rows = [(i, [0.5, -0.25, 1.0] if i % 3 == 0 else [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(120)]
    rows += [(200, None), (205, [1.0, None, 2.0]), (210, [float("nan"), 1.0, 1.0]), (215, [float("inf"), 1.0, 1.0]), (220, [2.0, 1.0]), (225, []), (None, [1.0, 1.0, 1.0]), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("v", F.lit("x"))
    got = top_k(df, F.col("vec_id") % 5 == 0, TopKParams(block=block, slice_rows=slice_rows))
    assert {tuple(r) for r in got.collect()} == brute(rows, 5)


def test_cells_of_clustered_vectors_are_pruned(spark, caplog):
    """Two hundred vectors in eight far clusters: exact, and most pairs of cells never meet."""
    rng = random.Random(2)
    centres = [[rng.choice([-1, 1]) * (4.0 if j == c else 0.0) for j in range(8)] for c in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 8]]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with caplog.at_level("INFO", logger="lodestrata.llm.knn"):
        got = top_k(df, F.col("vec_id") % 5 == 0)
        assert {tuple(r) for r in got.collect()} == brute(rows, 5)
    share = float(caplog.records[-1].getMessage().split(" pivots, ")[1].split(" ")[0])
    assert share > 50


def test_bounds_hold(spark):
    """Cell and vector bounds against all scores of random cells."""
    import numpy as np

    from lodestrata.llm.knn import Cells

    rng = np.random.default_rng(5)
    for _ in range(30):
        cells = Cells(rng.normal(0, 50, (6, 4)), 5)
        q, v = rng.integers(-120, 120, (40, 4)), rng.integers(-120, 120, (80, 4))
        (cq, dq), (cv, dv) = cells.near(q), cells.near(v)
        for c in range(6):
            cells.queries[c], cells.data[c] = (cq == c).sum(), (cv == c).sum()
            cells.radius[c], cells.spread[c] = dq[cq == c].max(initial=0), dv[cv == c].max(initial=0)
        cells.raise_floors()
        least, most = cells.of_cells()
        low, high = cells.of_vectors(v)
        for i in range(40):
            scores = v @ q[i]
            assert (scores >= least[cq[i]][cv]).all() and (scores <= most[cq[i]][cv]).all()
            assert (scores >= low[:, cq[i]]).all() and (scores <= high[:, cq[i]]).all()
            assert np.sort(scores)[-6] >= cells.floor[cq[i]]
            assert cells.allowed()[cq[i]][cv[np.argsort(-scores)[:5]]].all()


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in top_k(df, F.col("vec_id") % 5 == 0).collect()} == {(0, 1, 5, 131072), (5, 1, 0, 131072)}
    assert top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_shards(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", ShardParams(target=200_000, arrival=20_000, fanout=3))
    df = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    for k in range(6):
        store.append(df.where(F.col("id") % 6 == k).repartition(3))
    before, manifest = store.manifest()
    assert before == 6 and len(manifest["shards"]) == 18 and sum(s["rows"] for s in manifest["shards"]) == 4000
    version = store.compact(everything=True)
    merged = store.manifest()[1]["shards"]
    assert version == 7 and len(merged) < 6 and sum(s["rows"] for s in merged) == 4000
    assert max(s["bytes"] for s in merged) <= 1.25 * 200_000
    assert store.read().exceptAll(df).count() == 0 and store.read().count() == 4000
    assert store.read(3).count() == df.where(F.col("id") % 6 < 3).count()
    with pytest.raises(CommitConflict):
        store.commit(3, {"whole": True, "added": [], "removed": [], "schema": None})
    assert store.vacuum() == 0 and store.vacuum(older_than=0) == 18 and store.read().count() == 4000
    assert store.compact() == version


def test_shards_of_nothing(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/e")
    with pytest.raises(ValueError):
        store.read()
    store.append(spark.createDataFrame([], "id long, text string"))
    assert store.read().count() == 0 and store.compact(everything=True) == 1


def test_tiers(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/t", ShardParams(target=1000, arrival=100, fanout=2))
    shards = [Shard(f"p{k}", size, 1) for k, size in enumerate([60, 70, 90, 400, 420, 990])]
    tiers = store.plan(shards)
    assert [[[s.bytes for s in g] for g in groups] for groups in tiers] == [[[90, 70, 60]], [[420, 400]]]
    uneven = [Shard(f"q{k}", size, 1) for k, size in enumerate([700, 690, 650, 300, 200, 180, 170, 160])]
    for groups in store.plan(uneven, everything=True):
        assert all(len(g) > 1 and sum(s.bytes for s in g) <= 1000 for g in groups)


def test_each_group_becomes_one_file(spark, tmp_path):
    """Tiers of unlike sizes in one compaction: as many files as groups, of the rows and sizes planned."""
    store = ShardStore(spark, f"file://{tmp_path}/g", ShardParams(target=120_000, arrival=10_000, fanout=3, whole_every=4))
    text = lambda n: spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    for n in [60, 80, 100, 60, 500, 520, 510, 90, 800, 790]:
        store.append(text(n).coalesce(1))
    before = store.read().count()
    shards = [Shard(**s) for s in store.manifest()[1]["shards"]]
    planned = [g for groups in store.plan(shards) for g in groups]
    assert len({store.tier(g[0].bytes) for g in planned}) > 1
    assert all(len({store.tier(s.bytes) for s in g}) == 1 for g in planned)
    store.compact()
    known = {s.path for s in shards}
    made = [s for s in store.manifest()[1]["shards"] if s["path"] not in known]
    assert sorted(s["rows"] for s in made) == sorted(sum(s.rows for s in g) for g in planned)
    assert store.read().count() == before


def test_racing_writers_and_awkward_paths(spark, tmp_path):
    """Appends from threads all arrive; a file not yet committed survives a vacuum; blanks in the path do no harm."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/a folder with blanks"
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: ShardStore(spark, path).append(spark.range(k * 100, k * 100 + 100).coalesce(1)), range(8)))
    store = ShardStore(spark, path)
    assert store.versions() == list(range(1, 9)) and store.read().count() == 800 and store.read().distinct().count() == 800
    spark.range(5).write.parquet(f"{path}/data/append-underway")
    assert store.vacuum() == 0
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda _: _try(lambda: store.commit(8, {"whole": False, "added": [], "removed": [], "schema": store.manifest()[1]["schema"]})), range(8)))
    assert won.count(True) == 1 and store.versions()[-1] == 9
    merged = [s["path"] for s in store.manifest()[1]["shards"]]
    store.compact(everything=True)
    with pytest.raises(CommitConflict):
        store._change("", [], merged)
    assert store.read().count() == 800


def _try(action):
    try:
        action()
        return True
    except CommitConflict:
        return False


def test_shards_of_odd_rows(spark, tmp_path):
    """Nulls, repeats, very long texts and clashing columns come back as they went in; the query names its shards' sizes."""
    from lodestrata.llm.queries import op2_sharding
    from tests.llm.frames import empty_documents, odd_documents

    for name, docs in (("odd", odd_documents(spark)), ("empty", empty_documents(spark))):
        docs = docs.withColumn("ok", F.lit("clash")).withColumn("f", F.lit("clash")).withColumn("_metadata", F.lit("clash"))
        docs.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        store = ShardStore(spark, f"file://{tmp_path}/s-{name}")
        store.append(docs)
        assert store.read().exceptAll(docs).count() == 0 and store.read().count() == docs.count()
        got = op2_sharding(spark, f"file://{tmp_path}/{name}")
        assert got.count() == docs.count() and got.where("not within_target").count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Each stage's output against the rule it stands for."""
    import corpus_pipeline
    from lodestrata.llm.bpe import BpeParams, decode_documents
    from lodestrata.llm.pii import base_spans
    from lodestrata.llm.queries import tokenizer_path
    from lodestrata.runtime import table
    from tests.conftest import SF
    from tests.llm.test_near_duplicates import brute as components
    from tests.llm.test_texts import brute_contamination

    docs = table(spark, SF, "documents")
    seen = [docs]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{number}")
        seen.append(spark.read.parquet(f"{tmp_path}/{number}"))
    assert all(df.columns == docs.columns for df in seen[:5])
    texts = [{r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for df in seen[:5]]
    letters = {i for i, t in texts[0].items() if any(c.isalpha() for c in t or "")}
    assert set(texts[1]) <= letters and len(texts[1]) >= len(letters) - 2
    assert set(texts[2]) == {c for _, c in components(list(texts[1].items()), 5, 80).values()}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert set(texts[3]) == {i for i, t in texts[2].items() if brute_contamination(t, items)[1] == 0}
    assert set(texts[4]) == set(texts[3]) and not any(base_spans(t or "") for t in texts[4].values())
    decoded = decode_documents(seen[5], BpeParams(tokenizer_path()), ["doc_id"]).collect()
    assert {r["doc_id"]: r["text"] for r in decoded} == texts[4]
    assert corpus_pipeline.run(spark, SF).count() == len(decoded)


def test_pipeline_odd_rows(spark):
    import corpus_pipeline
    from tests.llm.frames import empty_documents, odd_documents

    docs = odd_documents(spark)
    for source in (docs, empty_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, source, SF_SMALL)
            assert out.columns == source.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, source, SF_SMALL).count()


SF_SMALL = "/root/testdata/sf0.001"
