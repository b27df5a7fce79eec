"""Graph algorithms over edge DataFrames (src, dst[, weight])."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import hops
from lodestrata.operators.joins import skew_join
from lodestrata.operators.packs import bounds_of, distinct, pack, packed, range_of, unpack
from lodestrata.runtime import materialize, ship


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def neighbors(edges: DataFrame, start: str, direction: str = "out", kind: str | None = None) -> DataFrame:
    """(edge_id, neighbor) of a node over (id, from_id, to_id, type), by edge id."""
    here, there = ("from_id", "to_id") if direction == "out" else ("to_id", "from_id")
    hop = edges.where(F.col(here) == start)
    hop = hop if kind is None else hop.where(F.col("type") == kind)
    return hop.select(F.col("id").alias("edge_id"), F.col(there).alias("neighbor")).orderBy("edge_id")


def chain(edges: DataFrame, starts: DataFrame, hops: list[tuple[str, str]]) -> DataFrame:
    """(start, end): nodes at the end of a fixed sequence of (type, direction) hops."""
    out = starts.select(F.col("id").alias("start"), F.col("id").alias("end"))
    for kind, direction in hops:
        here, there = ("from_id", "to_id") if direction == "out" else ("to_id", "from_id")
        hop = edges.where(F.col("type") == kind).select(F.col(here).alias("end"), F.col(there).alias("next"))
        out = out.join(hop, "end").select("start", F.col("next").alias("end"))
    return out.distinct()


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    """(id, depth): nodes within ``max_depth`` hops along src -> dst, or all that are reached.

    Only the frontier meets the edges in each round; rounds are written to the
    shared folder, and the loop ends with an empty frontier.
    """
    seen = materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "bfs")
    frontier = seen
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        reached = frontier.select(F.col("id").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialize(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes that the seeds reach, themselves included."""
    return bfs(edges, seeds, None).select("id")


def shortest_path_costs(edges: DataFrame, seed: object, max_rounds: int = 10_000) -> DataFrame:
    """(id, cost): least sums of edge weights (not negative) from a node, by relaxing improved nodes only."""
    spark = edges.sparkSession
    best = materialize(spark.range(1).select(F.lit(seed).cast(edges.schema["src"].dataType).alias("id"), F.lit(0.0).alias("cost")), "sssp")
    moved = best
    for _ in range(max_rounds):
        step = moved.join(edges.select(F.col("src").alias("id"), "dst", "weight"), "id")
        step = step.groupBy(F.col("dst").alias("id")).agg(F.min(F.col("cost") + F.col("weight")).alias("new"))
        joined = step.join(best, "id", "left").where(F.col("cost").isNull() | (F.col("new") < F.col("cost")))
        moved = materialize(joined.select("id", F.col("new").alias("cost")), "sssp")
        if moved.isEmpty():
            return best
        best = materialize(best.unionByName(moved).groupBy("id").agg(F.min("cost").alias("cost")), "sssp")
    raise RuntimeError(f"path costs not done after {max_rounds} rounds")


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int, damping: float = 0.85, tolerance: float = 0.0) -> DataFrame:
    """(id, rank): (1-d)/n + d*dangling/n + d*sum(rank/outdegree); parallel edges count separately."""
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    weighted = materialize(edges.join(degree, "src").select("src", "dst", "degree"), "pr-edges")
    sources = degree.select(F.col("src").alias("id"))
    ranks = materialize(nodes.select("id", F.lit(1.0 / n).alias("rank")), "pr")
    for _ in range(rounds):
        dangling = ranks.join(sources, "id", "left_anti").agg(F.sum("rank")).first()[0] or 0.0
        sums = weighted.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("mass"))
        base = (1 - damping) / n + damping * dangling / n
        new = ranks.join(sums, "id", "left").select("id", (F.lit(base) + damping * F.coalesce("mass", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        new = materialize(new, "pr")
        ranks = new.select("id", "rank")
        if tolerance > 0 and (new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
    return ranks


def personalized_pagerank(
    edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, epsilon: float = 1e-4, max_rounds: int = 10_000, local_edges: int = 6_000_000
) -> DataFrame:
    """(id, score): synchronous forward push over (src, dst, weight).

    Every node whose residual exceeds ``epsilon * max(outdegree, 1)`` keeps
    ``alpha`` of it and passes the rest on by weight; nodes without edges keep
    ``alpha`` of what reaches them.  A graph of at most ``local_edges`` edges is
    pushed by one task in arrays; in a larger one only active nodes meet the
    edges in a round.  The push ends when no node is active, or raises.
    """
    if edges.count() <= local_edges:
        return _local_push(edges, seeds, alpha, epsilon, max_rounds)
    total = edges.groupBy("src").agg(F.sum("weight").alias("out"), F.count(F.lit(1)).alias("degree"))
    parts = materialize(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("part")), "ppr-edges")
    degree = materialize(total.select(F.col("src").alias("id"), "degree"), "ppr-degree")
    whole = seeds.agg(F.sum("weight").alias("whole"))  # one row
    state = seeds.crossJoin(F.broadcast(whole)).groupBy("id").agg(F.sum(F.col("weight") / F.col("whole")).alias("r")).withColumn("p", F.lit(0.0))
    state = materialize(state, "ppr")
    for turn in range(max_rounds + 1):
        known = state.join(degree, "id", "left")
        hot = (F.col("r") > epsilon * F.greatest(F.coalesce("degree", F.lit(0)), F.lit(1))) & F.col("degree").isNotNull()
        active = known.where(hot).select("id", "r")
        if active.isEmpty():
            break
        if turn == max_rounds:
            raise RuntimeError(f"push not done after {max_rounds} rounds")
        sent = active.join(parts.withColumnRenamed("src", "id"), "id").groupBy(F.col("dst").alias("id")).agg(F.sum((1 - alpha) * F.col("r") * F.col("part")).alias("got"))
        kept = known.select("id", F.when(hot, F.col("p") + alpha * F.col("r")).otherwise(F.col("p")).alias("p"), F.when(hot, F.lit(0.0)).otherwise(F.col("r")).alias("r"))
        state = kept.join(sent, "id", "full").select("id", (F.coalesce("r", F.lit(0.0)) + F.coalesce("got", F.lit(0.0))).alias("r"), F.coalesce("p", F.lit(0.0)).alias("p"))
        state = materialize(state, "ppr")
    # Nodes without out-edges keep their share of what reaches them.
    return state.join(degree, "id", "left").select("id", F.when(F.col("degree").isNull(), F.col("p") + alpha * F.col("r")).otherwise(F.col("p")).alias("score"))


def push_arrays(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, residual: np.ndarray, alpha: float, epsilon: float, max_rounds: int) -> np.ndarray:
    """Scores by node number of a synchronous forward push; ``residual`` is the seeds' share."""
    n = len(residual)
    order = np.argsort(src, kind="stable")
    src, dst, weight = src[order], dst[order], weight[order]
    degree, out = np.bincount(src, minlength=n), np.bincount(src, weights=weight, minlength=n)
    first = np.concatenate([[0], np.cumsum(degree)])
    part = weight / np.where(out[src] == 0, 1, out[src])
    score, limit = np.zeros(n), epsilon * np.maximum(degree, 1)
    for turn in range(max_rounds + 1):
        active = np.flatnonzero((residual > limit) & (degree > 0))
        if len(active) == 0:
            break
        if turn == max_rounds:
            raise RuntimeError(f"push not done after {max_rounds} rounds")
        held, times = residual[active], degree[active]
        score[active] += alpha * held
        residual[active] = 0
        if times.sum() * 4 > len(src):  # most edges are active: no need to gather them
            sent = np.zeros(n)
            sent[active] = (1 - alpha) * held
            residual = residual + np.bincount(dst, weights=sent[src] * part, minlength=n)
        else:
            at = np.repeat(first[active] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            np.add.at(residual, dst[at], np.repeat((1 - alpha) * held, times) * part[at])
    ends = degree == 0
    score[ends] += alpha * residual[ends]
    return np.where((score > 0) | (residual > 0), score, np.nan)


def _local_push(edges: DataFrame, seeds: DataFrame, alpha: float, epsilon: float, max_rounds: int) -> DataFrame:
    """The push in one task; its rows are edges, and seeds as edges without a source."""
    kind = edges.schema["src"].dataType
    rows = edges.select(F.col("src"), F.col("dst"), F.col("weight").cast("double").alias("weight"))
    rows = rows.unionByName(seeds.select(F.lit(None).cast(kind).alias("src"), F.col("id").cast(kind).alias("dst"), F.col("weight").cast("double").alias("weight")))

    def run(batches):
        table = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if table is None or table.num_rows == 0:
            return
        ids = pa.concat_arrays([*table.column("src").chunks, *table.column("dst").chunks]).drop_null().unique()
        number = lambda column: np.asarray(pa.compute.index_in(column.combine_chunks(), value_set=ids).fill_null(-1)).astype(np.int64)
        src, dst, weight = number(table.column("src")), number(table.column("dst")), np.asarray(table.column("weight").combine_chunks())
        given = src < 0
        residual = np.bincount(dst[given], weights=weight[given], minlength=len(ids))
        score = push_arrays(src[~given], dst[~given], weight[~given], residual / max(residual.sum(), 1e-300), alpha, epsilon, max_rounds)
        met = np.flatnonzero(~np.isnan(score))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(met)), pa.array(score[met])], names=["id", "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    ship(edges.sparkSession)
    return rows.coalesce(1).mapInArrow(run, StructType([StructField("id", kind), StructField("score", DoubleType())]))


def components(edges: DataFrame, nodes: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(id, component): least id of each undirected component, by hooking and contraction."""
    live = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    live = materialize(live, "comp")
    roots = materialize(nodes.select("id", F.col("id").alias("component")), "comp")
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        parent = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        parent = materialize(parent.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up")), "comp")
        a, b = parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = live.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y"))
        live = materialize(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "comp")
        step = parent.select(F.col("node").alias("component"), "up")
        # A large component's least node is a hot key.
        roots = materialize(skew_join(roots, step, "component", ["id"], how="left").select("id", F.coalesce("up", "component").alias("component")), "comp")
    else:
        raise RuntimeError(f"components not done after {max_rounds} rounds")
    return roots


def label_propagation(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """(id, label): synchronous votes of neighbours, the most frequent label, the least among equals."""
    both = materialize(undirected(edges), "lpa-edges")
    labels = materialize(nodes.select("id", F.col("id").alias("label")), "lpa")
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("best")).select("id", F.col("best.label").alias("new"))
        labels = materialize(labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label")), "lpa")
    return labels


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c; edges point from lower to higher degree, so no hub meets itself in full."""

    def visit(tile: hops.Tile) -> list[np.ndarray]:
        parts, mark = [], np.zeros(len(tile.values), bool)
        for u, _, own, middle, counts, far in tile.paths():
            own = own[own >= 0]
            mark[own] = True
            shut = np.flatnonzero(mark[far])
            mark[own] = False
            if len(shut):
                parts.append([np.full(len(shut), u), np.repeat(middle, counts)[shut], tile.values[far[shut]]])
        return list(np.sort(np.stack(hops.joined(parts, 3)), axis=0))

    return hops.numbered(edges, ["a", "b", "c"], lambda e: hops.two_hops(e, visit, "a long, b long, c long", True))


def k_truss(edges: DataFrame, k: int, max_rounds: int = 10_000, array_triangles: int = 6_000_000) -> DataFrame:
    """(src, dst): edges that stay when every edge must lie in k - 2 triangles.

    Triangles are found once.  Up to ``array_triangles`` are peeled by one task;
    more by ranges of the edges' lesser ends.  A range has all triangles of its
    edges, peels them in arrays and tells other ranges that share them, until
    no range hears of anything.  Where one node alone has too many triangles,
    rounds of joins drop those of weak edges.
    """
    live = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst")
    if k <= 2:
        return live.distinct()
    return hops.numbered(live, ["src", "dst"], lambda e: _truss(e, k, max_rounds, array_triangles))


def _truss(edges: DataFrame, k: int, max_rounds: int, array_triangles: int) -> DataFrame:
    packs = materialize(packed(triangles(edges), ["a", "b", "c"], ["a", "b"]), "truss")
    total = packs.agg(F.sum("n").alias("n")).first()["n"] or 0
    bounds = bounds_of(packs, math.ceil(total / max(1, array_triangles // 4)) if total > array_triangles else 1)
    row = pa.schema([("i", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
    ddl = "i int, kind int, n long, x binary, y binary, z binary"

    def cells(i: int, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        given = [pack(x) for x in columns] + [b""] * (3 - len(columns))
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip([i, kind, len(columns[0]), *given], row, strict=True)], schema=row)

    def deal(batches):
        """Each triangle (kind 0) to the range of its least node and to that of the next."""
        for batch in batches:
            for j in range(batch.num_rows):
                corners = [unpack(batch.column(x)[j].as_py()) for x in "abc"]
                first, second = range_of(bounds, corners[0]), range_of(bounds, corners[1])
                other = np.flatnonzero(first != second)
                at = np.concatenate([np.arange(len(first)), other])
                for i, here in hops.slices(np.concatenate([first, second[other]])):
                    yield cells(i, 0, *(x[np.sort(at[here])] for x in corners))

    def whole(cells_of: list[list[bytes]], width: int) -> list[np.ndarray]:
        return distinct(*(np.concatenate([unpack(row[x]) for row in cells_of] or [np.empty(0, np.int64)]) for x in range(width)))

    def peel(i: int, corners: list[np.ndarray], told: list[np.ndarray], first_time: bool) -> Iterator[pa.RecordBatch]:
        """Of a range: triangles that stay (kind 0) and its edges that stay (2), both but once; edges that others must drop (1) and its own that go now (3)."""
        nodes = hops.values_of(np.concatenate(corners))
        a, b, c = (hops.places(nodes, x) for x in corners)
        keys, sides = np.unique(np.concatenate([a * len(nodes) + b, a * len(nodes) + c, b * len(nodes) + c]), return_inverse=True)
        sides = sides.reshape(3, -1)
        ends = nodes[keys // max(1, len(nodes))], nodes[keys % max(1, len(nodes))]
        own = range_of(bounds, ends[0]) == i
        x, y = (hops.places(nodes, v) for v in told)
        lost = hops.places(keys, np.where((x >= 0) & (y >= 0), x * len(nodes) + y, -1))
        dead, new = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        dead[lost[lost >= 0]] = True
        before = stay = np.flatnonzero(~dead[sides].any(axis=0))
        for _ in range(max_rounds):
            support = np.bincount(sides[:, stay].reshape(-1), minlength=len(keys))
            weak = own & ~dead & (support < k - 2)
            if not weak.any():
                break
            dead |= weak
            new |= weak
            stay = stay[~weak[sides[:, stay]].any(axis=0)]
        else:
            yield cells(i, 9, keys[:1])
            return
        if first_time:
            yield cells(i, 0, *(v[stay] for v in corners))
            yield cells(i, 2, *(v[own & ~dead] for v in ends))
        elif new.any():
            yield cells(i, 3, *(v[new] for v in ends))
        first, second = range_of(bounds, corners[0][before]), range_of(bounds, corners[1][before])
        shared = np.flatnonzero(first != second)
        target, edge = np.tile((first + second - i)[shared], 3), sides[:, before[shared]].reshape(-1)
        target, edge = distinct(target[new[edge]], edge[new[edge]])
        for t, at in hops.slices(target):
            yield cells(int(t), 1, *(v[edge[at]] for v in ends))

    def begin(table: pa.Table) -> pa.Table:
        triples = list(zip(*(table.column(x).to_pylist() for x in "xyz"), strict=True))
        return pa.Table.from_batches(list(peel(table.column("i")[0].as_py(), whole(triples, 3), [np.empty(0, np.int64)] * 2, True)))

    def again(batches):
        for batch in batches:
            for r in (batch.slice(j, 1).to_pylist()[0] for j in range(batch.num_rows)):
                yield from peel(r["i"], whole([[r["x"], r["y"], r["z"]]], 3), whole([[t["x"], t["y"]] for t in r["told"]], 2), False)

    def kept(batches):
        """Edges of a range that stayed at first and did not go later."""
        for batch in batches:
            for r in (batch.slice(j, 1).to_pylist()[0] for j in range(batch.num_rows)):
                x, y = unpack(r["x"]), unpack(r["y"])
                u, v = whole([[t["x"], t["y"]] for t in r["told"] or []], 2)
                xs, ys = hops.values_of(np.concatenate([x, u])), hops.values_of(np.concatenate([y, v]))
                key, gone = (hops.places(xs, p) * len(ys) + hops.places(ys, q) for p, q in ((x, y), (u, v)))
                stays = hops.places(np.sort(gone), key) < 0
                yield pa.RecordBatch.from_arrays([pa.array(x[stays]), pa.array(y[stays])], names=["src", "dst"])

    def beside(rows: DataFrame, notes: DataFrame, how: str) -> DataFrame:
        """Rows of ranges with all notes to each."""
        size = notes.agg(F.sum(F.length("x") + F.length("y")).alias("n")).first()["n"] or 0
        told = notes.groupBy("i").agg(F.collect_list(F.struct("x", "y")).alias("told"))
        return rows.join(F.broadcast(told) if size < 32_000_000 else told, "i", how)

    dealt = packs.select("a", "b", "c").mapInArrow(deal, ddl)
    if total > array_triangles and max(r["n"] for r in dealt.groupBy("i").agg(F.sum("n").alias("n")).collect()) > 3 * array_triangles:
        return _truss_by_joins(packs, k, max_rounds)
    state = materialize(dealt.groupBy("i").applyInArrow(begin, ddl), "truss")
    found, notes = state, state.where("kind in (1, 3)")
    for _ in range(max_rounds):
        heard = found.select("i", "kind").distinct().collect()  # a few rows for each range
        if any(r["kind"] == 9 for r in heard):
            break
        targets = [r["i"] for r in heard if r["kind"] == 1]
        if not targets:
            return beside(state.where("kind = 2"), notes.where("kind = 3"), "left").mapInArrow(kept, "src long, dst long")
        rows = beside(state.where("kind = 0").where(F.col("i").isin(targets)), notes.where(F.col("i").isin(targets)), "inner")
        found = materialize(rows.mapInArrow(again, ddl), "truss")
        notes = notes.unionAll(found.where("kind in (1, 3)"))
    raise RuntimeError(f"truss not done after {max_rounds} rounds")


def _truss_by_joins(packs: DataFrame, k: int, max_rounds: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            for j in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(batch.column(x)[j].as_py())) for x in "abc"], names=list("abc"))

    found = packs.select("a", "b", "c").mapInArrow(rows, "a long, b long, c long")
    for _ in range(max_rounds):
        sides = [found.select(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ("ab", "ac", "bc")]
        support = materialize(sides[0].unionAll(sides[1]).unionAll(sides[2]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "truss")
        weak = support.where(F.col("n") < k - 2)
        if weak.isEmpty():
            return support.select("src", "dst")
        for x, y in ("ab", "ac", "bc"):
            found = found.join(weak.select(F.col("src").alias(x), F.col("dst").alias(y)), [x, y], "left_anti")
        found = materialize(found.select("a", "b", "c"), "truss")
    raise RuntimeError(f"truss not done after {max_rounds} rounds")


def walk_counts(edges: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """(id, walks): number of walks of a length from the seeds, parallel edges counted."""
    out = seeds.select("id", F.lit(1).cast("decimal(38,0)").alias("walks"))
    for _ in range(steps):
        out = out.join(edges.select(F.col("src").alias("id"), "dst"), "id").groupBy(F.col("dst").alias("id")).agg(F.sum("walks").cast("decimal(38,0)").alias("walks"))
    return out


def structural_knn(edges: DataFrame, k: int) -> DataFrame:
    """(u, v, score, rank): shared neighbours over the root of the degrees, for nodes two hops apart."""
    from pyspark.sql import Window

    def visit(tile: hops.Tile) -> list[np.ndarray]:
        parts, weight = [], 1 / np.sqrt(tile.degrees)
        for u, own, _, _, _, far in tile.paths():
            low = far.min()
            shared = np.bincount(far - low)
            at = np.searchsorted(tile.values, u) - low
            if 0 <= at < len(shared) and tile.values[low + at] == u:
                shared[at] = 0
            rough = shared * weight[low : low + len(shared)]
            # The k-th best of the best of each slice is no better than the k-th best of all.
            slices = rough[: len(rough) // 64 * 64].reshape(64, -1)
            tops = slices.max(axis=0) if slices.size else rough[:0]
            least = np.partition(tops, len(tops) - k)[len(tops) - k] * (1 - 1e-9) if len(tops) >= k else 0.0
            v = np.flatnonzero(rough >= least) if least > 0 else np.flatnonzero(shared)
            score = shared[v] / np.sqrt(float(len(own)) * tile.degrees[low + v])
            order = np.lexsort((v, -score))[:k]
            parts.append([np.full(len(order), u), tile.values[low + v[order]], score[order]])
        return hops.joined(parts, 3)

    # The k best of each node and tile.
    scored = hops.numbered(edges, ["u", "v"], lambda e: hops.two_hops(e, visit, "u long, v long, score double", False, True))
    order = Window.partitionBy("u").orderBy(F.col("score").desc(), "v")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def strongly_connected(edges: DataFrame, nodes: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, scc): least id of each strongly connected component.

    Nodes without an edge in or out are components by themselves and are trimmed
    first.  Colours (least reachable-from ids) spread forward; each colour's root
    then collects backward the nodes of its colour that reach it.
    """
    left = materialize(nodes.select("id"), "scc")
    live = materialize(edges.select("src", "dst").distinct(), "scc")
    done: DataFrame | None = None
    for turn in range(max_rounds + 1):
        while True:
            kept = left.join(live.where("src <> dst").select(F.col("src").alias("id")), "id", "left_semi").join(live.where("src <> dst").select(F.col("dst").alias("id")), "id", "left_semi")
            kept = materialize(kept, "scc")
            alone = materialize(left.join(kept, "id", "left_anti"), "scc")
            if alone.isEmpty():
                break
            part = alone.select("id", F.col("id").alias("scc"))
            done = part if done is None else done.unionByName(part)
            left, ends = kept, kept.select("id")
            live = materialize(live.join(ends.withColumnRenamed("id", "src"), "src").join(ends.withColumnRenamed("id", "dst"), "dst").select("src", "dst"), "scc")
        if left.isEmpty():
            break
        if turn == max_rounds:
            raise RuntimeError(f"strong components not done after {max_rounds} rounds")
        colour = materialize(left.select("id", F.col("id").alias("colour")), "scc")
        while True:
            better = live.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("c")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("c"))
            new = materialize(colour.join(better, "id", "left").select("id", F.least("colour", F.coalesce("c", "colour")).alias("colour"), F.col("colour").alias("old")), "scc")
            colour = new.select("id", "colour")
            if new.where("colour <> old").isEmpty():
                break
        found = materialize(colour.where("id = colour"), "scc")
        frontier = found
        while not frontier.isEmpty():
            back = frontier.select(F.col("id").alias("dst"), "colour").join(live, "dst").select(F.col("src").alias("id"), "colour").distinct()
            frontier = materialize(back.join(colour, ["id", "colour"]).join(found.select("id"), "id", "left_anti"), "scc")
            found = found.unionByName(frontier)
        found = materialize(found, "scc")
        part = found.select("id", F.col("colour").alias("scc"))
        done = part if done is None else done.unionByName(part)
        left = materialize(left.join(found.select("id"), "id", "left_anti"), "scc")
        ends = left.select("id")
        live = materialize(live.join(ends.withColumnRenamed("id", "src"), "src").join(ends.withColumnRenamed("id", "dst"), "dst").select("src", "dst"), "scc")
    return done if done is not None else nodes.select("id", F.col("id").alias("scc"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def louvain_round(edges: DataFrame, nodes: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, community): local moves by modularity gain over (src, dst, weight), in synchronous rounds.

    Nodes of even and odd hash move in turn, so that two neighbours do not swap
    communities for ever; a move needs a gain, and ties go to the least community.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).where("src <> dst")
    both = materialize(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "louvain")
    degree = materialize(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")), "louvain")
    m2 = degree.agg(F.sum("k")).first()[0] or 1.0
    state = materialize(nodes.select("id", F.col("id").alias("community")), "louvain")
    for turn in range(rounds):
        known = state.join(degree, "id", "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
        total = known.groupBy("community").agg(F.sum("k").alias("tot"))
        near = both.join(state.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("weight").alias("w"))
        own = known.select("id", "k", F.col("community").alias("now"))
        options = near.join(own, "id").join(total, "community")
        held = F.when(F.col("community") == F.col("now"), F.col("tot") - F.col("k")).otherwise(F.col("tot"))
        options = options.withColumn("gain", F.col("w") - F.col("k") * held / m2)
        stay = options.where("community = now").select("id", F.col("gain").alias("stay"))
        best = options.where("community <> now").groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), "community")).alias("b"))
        moves = best.join(stay, "id", "left").where(-F.col("b.g") > F.coalesce("stay", F.lit(0.0)) + 1e-12)
        moves = moves.where(F.pmod(F.xxhash64("id"), F.lit(2)) == turn % 2).select("id", F.col("b.community").alias("new"))
        moved = materialize(moves, "louvain")
        if moved.isEmpty() and turn % 2:
            break
        state = materialize(state.join(moved, "id", "left").select("id", F.coalesce("new", "community").alias("community")), "louvain")
    return state


def betweenness(edges: DataFrame, sources: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(id, score): shortest-path dependencies of the given sources, levels forward and back for all sources at once."""
    step = edges.select("src", "dst")
    level = materialize(sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("sigma")), "between")
    levels = [level]
    seen = level.select("s", "id")
    for _ in range(max_depth):
        reached = level.join(step, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        level = materialize(reached.join(seen, ["s", "id"], "left_anti"), "between")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "id"))
    else:
        raise RuntimeError(f"betweenness not done after {max_depth} levels")
    delta: DataFrame | None = None
    out: DataFrame | None = None
    for upper, lower in zip(levels[-2::-1], levels[:0:-1], strict=True):
        below = lower if delta is None else lower.join(delta, ["s", "id"], "left")
        below = below.select("s", F.col("id").alias("dst"), F.col("sigma").alias("sw"), (F.coalesce("d", F.lit(0.0)) if delta is not None else F.lit(0.0)).alias("dw"))
        share = upper.join(step, F.col("id") == F.col("src")).join(below, ["s", "dst"])
        delta = share.groupBy("s", "id").agg(F.sum(F.col("sigma") / F.col("sw") * (1 + F.col("dw"))).alias("d"))
        delta = materialize(delta, "between")
        part = delta.where("s <> id")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return sources.select("id", F.lit(0.0).alias("score")).where("false")
    return out.groupBy("id").agg(F.sum("d").alias("score"))


def bridges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): edges whose removal parts a component.

    An edge that lies in a triangle or a longer cycle is none; candidates are
    the edges of degree-one peeling and those outside 2-edge-connected cores,
    found by removing leaves until none is left, then checking each edge of
    the core by a search that avoids it.
    """
    e = materialize(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct(), "bridge")
    core, leaves = e, None
    while True:
        both = core.select(F.col("src").alias("id")).unionAll(core.select("dst"))
        single = both.groupBy("id").count().where("count = 1").select("id")
        cut = core.join(single.select(F.col("id").alias("src")), "src", "left_semi").unionByName(core.join(single.select(F.col("id").alias("dst")), "dst", "left_semi")).distinct()
        cut = materialize(cut, "bridge")
        if cut.isEmpty():
            break
        leaves = cut if leaves is None else leaves.unionByName(cut)
        core = materialize(core.join(cut, ["src", "dst"], "left_anti"), "bridge")
    # In the core: a spanning forest by breadth-first levels; a tree edge is a bridge if no other edge spans it.
    found = _core_bridges(core)
    return found if leaves is None else leaves.unionByName(found)


def _core_bridges(core: DataFrame) -> DataFrame:
    """Bridges of a graph without leaves by random labels: an edge is one if the sum over the cycles through it is zero.

    Every non-tree edge draws a 64-bit label; a tree edge carries the xor of the
    labels of the non-tree edges that span it, which is the xor of its subtree's
    nodes.  It is zero just for bridges (but for a chance of 2^-64 each).
    """
    both = materialize(undirected(core), "bridge")
    ids = both.select(F.col("src").alias("id")).distinct()
    roots = components(core, ids)
    level = materialize(roots.where("id = component").select("id", F.lit(0).alias("depth"), F.lit(None).cast(ids.schema["id"].dataType).alias("parent")), "bridge")
    tree = level
    depth = 0
    while not level.isEmpty():
        depth += 1
        reached = level.join(both, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        level = materialize(reached.join(tree.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent"), "bridge")
        tree = tree.unionByName(level)
    tree = materialize(tree, "bridge")
    pairs = tree.where("parent is not null").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))
    extra = core.join(pairs, ["src", "dst"], "left_anti").withColumn("x", F.xxhash64("src", "dst", F.lit(7)))
    own = extra.select(F.col("src").alias("id"), "x").unionByName(extra.select(F.col("dst").alias("id"), "x")).groupBy("id").agg(F.bit_xor("x").alias("x"))
    sums = materialize(tree.join(own, "id", "left").select("id", "depth", "parent", F.coalesce("x", F.lit(0).cast("long")).alias("x")), "bridge")
    for d in range(depth - 1, 0, -1):
        up = sums.where(F.col("depth") == d).groupBy(F.col("parent").alias("id")).agg(F.bit_xor("x").alias("u"))
        sums = materialize(sums.join(up, "id", "left").select("id", "depth", "parent", F.col("x").bitwiseXOR(F.coalesce("u", F.lit(0).cast("long"))).alias("x")), "bridge")
    return sums.where("parent is not null and x = 0").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))


def cfl_reachability(edges: DataFrame, unary: list[tuple[str, str]], binary: list[tuple[str, str, str]], max_rounds: int = 10_000) -> DataFrame:
    """(src, dst, label): labelled edges closed under productions label -> label and label -> label label."""
    facts = materialize(edges.select("src", "dst", "label").distinct(), "cfl")
    fresh = facts
    for _ in range(max_rounds):
        made = []
        for head, body in unary:
            made.append(fresh.where(F.col("label") == body).select("src", "dst", F.lit(head).alias("label")))
        for head, left, right in binary:
            for a, b in ((fresh, facts), (facts, fresh)):
                x = a.where(F.col("label") == left).select("src", F.col("dst").alias("m"))
                y = b.where(F.col("label") == right).select(F.col("src").alias("m"), "dst")
                made.append(x.join(y, "m").select("src", "dst", F.lit(head).alias("label")))
        if not made:
            break
        new = made[0]
        for part in made[1:]:
            new = new.unionByName(part)
        fresh = materialize(new.distinct().join(facts, ["src", "dst", "label"], "left_anti"), "cfl")
        if fresh.isEmpty():
            break
        facts = materialize(facts.unionByName(fresh), "cfl")
    else:
        raise RuntimeError(f"reachability not done after {max_rounds} rounds")
    return facts
