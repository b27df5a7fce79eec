"""Exact top-k search by inner product as a Voronoi kNN join.

Queries and data are both assigned to their nearest pivots.  Summaries of the
cells (numbers and radii) bound every score between a query cell and a data
cell: with pivots p and c and radii r and s, q.v lies within
r |c| + s (|p| + r) of p.c.  They, and the data vectors' own bounds
|q.v - p.v| <= r |v|, give each query cell a floor under its k-th best score.
A data cell that cannot reach the floor is pruned for the query cell as a
whole, the others vector by vector; what is left is sent there.  Cells are
solved in blocks of bounded size, and the blocks' best are merged.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import materialize, ship, small_batches


_LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class TopKParams:
    """``block``: queries solved together; ``slice_rows``: data vectors that meet them at once.

    A cell of q queries that n data vectors can reach moves
    q n / slice_rows + n q / block vectors.  ``pivots`` bounds the number of
    pivots below (as far as there are queries) and above, and with it the
    summaries on the driver.
    """

    k: int = 5
    scale: int = 256
    block: int = 4096
    slice_rows: int = 32768
    pivots: tuple[int, int] = (16, 256)


def scaled_vectors(vectors: DataFrame, p: TopKParams) -> DataFrame:
    """(vec_id, dim, v): each component times ``scale``, rounded down, as packed 64-bit integers.

    Vectors that are null or empty, or hold null or non-finite components (or
    ones beyond 64 bits), take no part; nor do rows without an id.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            flat = lists.flatten()
            values = np.floor(p.scale * np.asarray(flat.cast(pa.float64()).fill_null(np.nan)))
            good = np.isfinite(values) & (np.abs(values) < 2.0**62)
            ends = np.cumsum(sizes)
            wrong = np.concatenate([[0], np.cumsum(~good)])
            keep = (sizes > 0) & (wrong[ends] == wrong[ends - sizes]) & np.asarray(batch.column(0).is_valid())
            whole = np.where(good, values, 0).astype("<i8")
            at = np.flatnonzero(keep)
            packed = [whole[ends[i] - sizes[i] : ends[i]].tobytes() for i in at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(sizes[at].astype(np.int32)), pa.array(packed, pa.binary())], names=["vec_id", "dim", "v"]
            )

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        run, "vec_id long, dim int, v binary"
    )


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every sum fits its 53 bits, else in integers."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _least_ids(vectors: DataFrame, n: int) -> DataFrame:
    """Distinct vectors with their ``n`` least ids; copies are merged on the map side and by salted groups."""
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, n).alias("ids")
    part = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(1024)))
    part = part.groupBy("dim", "v", "salt").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, n).alias("ids"))
    part = part.groupBy("dim", "v", F.pmod("salt", F.lit(32)).alias("salt")).agg(merged)
    return part.groupBy("dim", "v").agg(merged)


class Cells:
    """Pivots, and what is known of the query and data cells around them; bounds on the scores between them."""

    def __init__(self, pivots: np.ndarray, k: int):
        n = len(pivots)
        self.pivots, self.k = pivots, k
        self.radius, self.queries = np.zeros(n), np.zeros(n, dtype=np.int64)
        self.spread, self.data = np.zeros(n), np.zeros(n, dtype=np.int64)
        self.floor = np.full(n, -np.inf)

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance from its pivot) of each vector."""
        x = x.astype(np.float64)
        square = (x**2).sum(axis=1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(axis=1)[None, :]
        cell = square.argmin(axis=1)
        return cell.astype(np.int32), np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))

    def of_vectors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score of each vector with any query of each cell."""
        x = x.astype(np.float64)
        middle, wide = x @ self.pivots.T, np.sqrt((x**2).sum(axis=1))[:, None] * self.radius[None, :]
        slack = 1e-9 * (np.abs(middle) + wide) + 1e-6
        return middle - wide - slack, middle + wide + slack

    def of_cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score between any query of a cell (rows) and any vector of a cell (columns)."""
        length = np.sqrt((self.pivots**2).sum(axis=1))
        middle = self.pivots @ self.pivots.T
        wide = self.radius[:, None] * length[None, :] + self.spread[None, :] * (length + self.radius)[:, None]
        slack = 1e-9 * (np.abs(middle) + wide) + 1e-6
        return middle - wide - slack, middle + wide + slack

    def raise_floors(self) -> None:
        """A query cell's k + 1 best score no less than that of the data cells that promise most, until they hold so many vectors."""
        least, _ = self.of_cells()
        for cell in range(len(self.pivots)):
            order = np.argsort(-least[cell], kind="stable")
            enough = np.flatnonzero(np.cumsum(self.data[order]) > self.k)
            if len(enough):
                self.floor[cell] = max(self.floor[cell], least[cell][order[enough[0]]])

    def allowed(self) -> np.ndarray:
        """Which query cells (rows) need any vector of which data cells (columns)."""
        _, most = self.of_cells()
        return (most >= self.floor[:, None]) & (self.queries > 0)[:, None] & (self.data > 0)[None, :]


def _of_dimension(data: DataFrame, asked: DataFrame, dim: int, p: TopKParams) -> DataFrame:
    """(v, best): the k + 1 best (score, vec_id) of each distinct query vector of one dimension."""
    spark = data.sparkSession
    data, asked = data.where(F.col("dim") == dim), asked.where(F.col("dim") == dim).select("v").distinct()
    n_queries = asked.count()
    n_pivots = int(min(p.pivots[1], max(min(n_queries, p.pivots[0]), -(-n_queries // p.block))))
    chosen = asked.orderBy(F.xxhash64("v"), "v").limit(n_pivots).collect()
    cells = Cells(np.stack([np.frombuffer(r["v"], "<i8") for r in chosen]).astype(np.float64), p.k)

    def locate(batches, cells=cells):
        for batch in batches:
            if batch.num_rows:
                cell, away = cells.near(_matrix(batch.column(0), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    placed = materialize(asked.mapInArrow(locate, "v binary, cell int, away double"), "knn-queries")
    data = materialize(data.select("v", "ids").mapInArrow(locate, "v binary, ids array<long>, cell int, away double"), "knn-cells")
    for df, wide, held in ((placed, cells.radius, cells.queries), (data, cells.spread, cells.data)):
        for row in df.groupBy("cell").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # one row per pivot
            wide[row["cell"]], held[row["cell"]] = row["r"] * (1 + 1e-9) + 1e-6, row["n"]

    def lower(batches):
        best = np.full((0, n_pivots), -np.inf)
        for batch in batches:
            if batch.num_rows:
                best = np.concatenate([best, cells.of_vectors(_matrix(batch.column(0), dim))[0]])
                best = -np.sort(-best, axis=0)[: p.k + 1]
        numbers = np.tile(np.arange(n_pivots, dtype=np.int32), len(best))
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(best.reshape(-1))], names=["cell", "low"])

    # Every data vector gives a floor for each query cell; the k + 1 best floors bound what its queries find.
    floors = data.select("v").mapInArrow(lower, "cell int, low double")
    floors = floors.groupBy("cell", F.pmod(F.spark_partition_id(), F.lit(64)).alias("s")).agg(_most("low", p.k + 1)).groupBy("cell")
    floors = floors.agg(F.slice(F.sort_array(F.flatten(F.collect_list("low")), asc=False), 1, p.k + 1).alias("low")).collect()
    for row in floors:  # one row per pivot
        if len(row["low"]) == p.k + 1:
            cells.floor[row["cell"]] = row["low"][-1]
    cells.raise_floors()
    allowed = cells.allowed()
    reached = allowed @ cells.data
    _LOG.info("vectors of %d: %d pivots, %.1f %% of the pairs of query cells and data vectors pruned by cells", dim, n_pivots, 100 * pruned_share(cells))

    def replicate(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            can = allowed[:, np.asarray(batch.column(2))].T & (cells.of_vectors(_matrix(batch.column(0), dim))[1] >= cells.floor[None, :])
            rows, numbers = np.nonzero(can)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["cell", "v", "ids"])

    def of_cell(numbers: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col("cell") + 1)

    blocks, parts = np.maximum(1, -(-cells.queries // p.block)), np.maximum(1, -(-reached // p.slice_rows))
    sent_data = (
        data.select("v", "ids", "cell")
        .mapInArrow(replicate, "cell int, v binary, ids array<long>")
        .withColumn("part", F.pmod(F.xxhash64("v"), of_cell(parts)).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), of_cell(blocks) - 1)))
    )
    sent_queries = placed.select(
        "cell", "v", F.pmod(F.xxhash64("v"), of_cell(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), of_cell(parts) - 1)).alias("part")
    )

    def solve(queries: pa.Table, found: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or found.num_rows == 0:
            return pa.table({"v": pa.array([], pa.binary()), "score": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64())})
        asked, given = _matrix(queries.column("v"), dim), _matrix(found.column("v"), dim)
        ids = found.column("ids").to_pylist()
        least = np.array([x[0] for x in ids])
        out_v, out_s, out_i = [], [], []
        for first in range(0, len(asked), 256):  # so many lines of scores are held at once
            names = queries.column("v").slice(first, 256).to_pylist()
            for name, line in zip(names, _products(asked[first : first + 256], given), strict=True):
                if len(line) > p.k + 1:
                    edge = np.partition(line, len(line) - p.k - 1)[len(line) - p.k - 1]
                    at = np.flatnonzero(line >= edge)
                else:
                    at = np.arange(len(line))
                at = at[np.lexsort((least[at], -line[at]))][: p.k + 1]
                best = sorted((-int(line[a]), i) for a in at for i in ids[a])[: p.k + 1]
                out_v += [name] * len(best)
                out_s += [-s for s, _ in best]
                out_i += [i for _, i in best]
        return pa.table({"v": pa.array(out_v, pa.binary()), "score": pa.array(out_s, pa.int64()), "vec_id": pa.array(out_i, pa.int64())})

    keys = ("cell", "block", "part")
    solved = sent_queries.groupBy(*keys).cogroup(sent_data.groupBy(*keys)).applyInArrow(solve, "v binary, score long, vec_id long")
    ranked = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"))
    return solved.groupBy("v").agg(F.slice(F.array_sort(F.collect_list(ranked)), 1, p.k + 1).alias("best"))


def pruned_share(cells: Cells) -> float:
    """Of all pairs of a query cell and a data vector, the share that cell bounds rule out."""
    pairs = int((cells.queries > 0).sum()) * int(cells.data.sum())
    return 1 - int((cells.allowed() @ cells.data).sum()) / pairs if pairs else 0.0


def _most(name: str, n: int) -> Column:
    return F.slice(F.sort_array(F.collect_list(name), asc=False), 1, n).alias(name)


def top_k(vectors: DataFrame, is_query: Column, p: TopKParams = TopKParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` candidates of each query row.

    ``is_query`` is a condition on vec_id.  Candidates are all ids but the
    query's own; equal scores go to the smaller id.  A row that repeats both id
    and vector counts once; vectors of other lengths are no candidates.  Null
    and non-finite vectors, and rows without an id, take no part.  Very long
    vectors are held in blocks of rows like others.  An empty table gives an
    empty result; other columns are ignored whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    small_batches(spark, 2048)
    rows = materialize(scaled_vectors(vectors, p), "knn-rows")
    data = materialize(_least_ids(rows, p.k + 1), "knn-data")
    queries = rows.where(is_query).distinct()
    found = None
    for row in queries.select("dim").distinct().orderBy("dim").collect():  # a table holds few vector lengths
        part = _of_dimension(data, queries, row["dim"], p).select(F.lit(row["dim"]).alias("dim"), "v", "best")
        found = part if found is None else found.unionByName(part)
    schema = "query_id long, rank int, vec_id long, score long"
    if found is None:
        return spark.createDataFrame([], schema)
    own = queries.join(found, ["dim", "v"]).select(
        F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda b: b["i"] != F.col("vec_id")), 1, p.k).alias("best")
    )
    return own.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"), (-F.col("b.s")).alias("score")
    )
