"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "rel_revenue_by_nation rel_pricing_summary ir_equality_range_join sql_top_suppliers sql_window_running sql_count_distinct sql_cube "
    "rel_top_k_per_group zset_rank version_diff text_bm25 text_fuzzy text_passages vector_knn vector_maxsim vector_similarity_edges fusion_rrf "
    "graph_components graph_pagerank graph_personalized_pagerank graph_triangles cypher_two_hops rule_support_closure "
    "temporal_as_of_join spatial_near_pairs stream_windows_batch ingest_field_facts"
).split()


def workloads(spark) -> dict:
    """Late interaction over 96 documents of 32 x 128 for 12 queries, and ranks from one seed on random graphs of degree 4."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from lodestrata.operators.graph import personalized_pagerank
    from lodestrata.operators.text import Bm25Index
    from lodestrata.operators.vector import maxsim_rank
    from lodestrata.runtime import materialize, table

    rng = np.random.default_rng(42)

    def multi(n: int):
        flat = pa.array(rng.normal(size=n * 32 * 128).astype(np.float32))
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, n * 32 + 1, dtype=np.int32) * 128), flat)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n + 1, dtype=np.int32) * 32), inner)
        return materialize(spark.createDataFrame(pa.table({"id": pa.array(range(n)), "vectors": vectors})), "bench-multi")

    docs, asked = multi(96), multi(12)
    out = {
        "maxsim_exact_12x96x32x128": lambda: maxsim_rank(docs, asked, 10),
        "maxsim_binary_12x96x32x128": lambda: maxsim_rank(docs, asked, 10, binary=True),
    }
    for n in (50_000, 200_000, 1_000_000):
        end = lambda seed, n=n: F.floor(F.rand(seed) * n).cast("long")
        edges = materialize(spark.range(4 * n).select(end(42).alias("src"), end(43).alias("dst"), F.lit(1.0).alias("weight")), "bench-graph")
        seed = spark.range(1).select(F.col("id"), F.lit(1.0).alias("weight"))
        out[f"ppr_{n // 1000}k_nodes"] = lambda edges=edges, seed=seed: personalized_pagerank(edges, seed, 0.15, 1e-4)
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    index = Bm25Index(table(spark, folder, "documents"), "doc_id")
    out["text_bm25_search_of_index"] = lambda: index.search("worthless trash the pathetic").orderBy(F.col("score").desc(), "id").limit(25)
    return out


def main() -> None:
    from lodestrata.queries import QUERIES
    from lodestrata.runtime import release, session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    spark = session("bench", cpus, **{"spark.driver.memory": "12g"})

    def median(run) -> float:
        took = []
        for _ in range(rounds):
            start = time.time()
            run().write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        return round(statistics.median(took), 3)

    times: dict[str, float] = {}
    for name in HEADLINE:
        times[name] = median(lambda name=name: QUERIES[name](spark, folder))
        release(spark)
    special = {name: median(run) for name, run in workloads(spark).items()}
    release(spark)
    print(
        json.dumps(
            {
                "metric": "sum of the median seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times | special,
                "sf": folder.rsplit("/sf", 1)[-1],
                "shuffle_partitions": cpus,
                "rounds": rounds,
            }
        )
    )


if __name__ == "__main__":
    main()
