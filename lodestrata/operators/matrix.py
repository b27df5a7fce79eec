"""Sparse matrices as (row, col, value) frames: products over semirings, masks, unions and compressed rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.joins import skew_join
from lodestrata.operators.ordered import zrank
from lodestrata.runtime import materialize

#: By name: how two values are combined along a path, and how paths are gathered.
SEMIRINGS = {
    "plus_times": (lambda a, b: a * b, F.sum),
    "min_plus": (lambda a, b: a + b, F.min),
    "max_times": (lambda a, b: a * b, F.max),
    "or_and": (lambda a, b: ((a != 0) & (b != 0)).cast("int"), F.max),
}


def _parts(semiring: str):
    if semiring not in SEMIRINGS:
        raise ValueError(f"unknown semiring {semiring!r}")
    return SEMIRINGS[semiring]


def matrix_vector(matrix: DataFrame, vector: DataFrame, semiring: str = "plus_times", mask: DataFrame | None = None) -> DataFrame:
    """(row, value) of a matrix by a vector (row, value); a mask (row) names the rows that are wanted."""
    along, gather = _parts(semiring)
    wanted = matrix if mask is None else matrix.join(mask.select("row"), "row", "left_semi")
    joined = wanted.withColumnRenamed("value", "a").join(vector.select(F.col("row").alias("col"), F.col("value").alias("b")), "col")
    return joined.groupBy("row").agg(gather(along(F.col("a"), F.col("b"))).alias("value"))


def matrix_matrix(left: DataFrame, right: DataFrame, semiring: str = "plus_times", mask: DataFrame | None = None) -> DataFrame:
    """(row, col, value) of two matrices; a mask (row, col) names the cells that are wanted, or all are."""
    along, gather = _parts(semiring)
    a = left.select("row", F.col("col").alias("k"), F.col("value").alias("a"))
    b = right.select(F.col("row").alias("k"), "col", F.col("value").alias("b"))
    out = a.join(b, "k").groupBy("row", "col").agg(gather(along(F.col("a"), F.col("b"))).alias("value"))
    return out if mask is None else out.join(mask.select("row", "col"), ["row", "col"], "left_semi")


def elementwise_or(left: DataFrame, right: DataFrame) -> DataFrame:
    """(row, col) of the cells that either matrix holds."""
    return left.select("row", "col").unionByName(right.select("row", "col")).distinct()


def compressed_rows(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, rows) of (src, dst, weight): ids numbered in order, and for each number its targets and weights in order.

    ids: id, number.  rows: number, first (edges before it), targets, weights; parallel edges are summed.
    """
    ends = edges.select(F.col("src").alias("member")).unionByName(edges.select(F.col("dst").alias("member"))).distinct()
    ids = zrank(ends.withColumn("score", F.lit(0))).select(F.col("member").alias("id"), F.col("rank").alias("number"))
    summed = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    numbered = summed.join(ids.select(F.col("id").alias("src"), F.col("number").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("number").alias("b")), "dst")
    held = numbered.groupBy(F.col("a").alias("number")).agg(F.array_sort(F.collect_list(F.struct("b", "weight"))).alias("row"))
    rows = ids.join(held, "number", "left").select("number", F.coalesce(F.transform("row", lambda x: x["b"]), F.array().cast("array<long>")).alias("targets"), F.coalesce(F.transform("row", lambda x: x["weight"]), F.array().cast("array<double>")).alias("weights"))
    sized = running_first(rows.withColumn("n", F.size("targets")))
    return ids, sized.select("number", "first", "targets", "weights")


def running_first(rows: DataFrame) -> DataFrame:
    """Rows (number, n, ...) with first, the sum of n before each number; ranges are summed each for itself."""
    from lodestrata.operators.ordered import running_totals

    return running_totals(rows, [F.col("number")], "n").withColumn("first", (F.col("running") - F.col("n")).cast("long")).drop("running", "rank")


def semiring_provenance(derivations: DataFrame, key: list[str], trust: str, sources: Column) -> DataFrame:
    """By fact: whether it holds, its number of derivations, the best trust of one, and the sets of sources that derive it.

    A derivation is a row; ``trust`` names its product of trusts and ``sources`` its array of sources.
    """
    why = F.array_sort(F.collect_set(F.array_sort(F.array_distinct(sources)))).alias("why")
    return derivations.groupBy(*key).agg((F.max(trust) > 0).alias("holds"), F.count(F.lit(1)).alias("derivations"), F.max(trust).alias("viterbi"), why)


def overlapping(intervals: DataFrame, gap: int, width: int, run: int = 256, block: int = 16_384) -> DataFrame:
    """(a, b, apart): pairs of intervals (id, start, stop) that overlap or lie at most ``gap`` apart.

    Intervals are dealt to cells of ``width``; a pair is named by the cell of the later start, so no pair is met twice.
    Lists meet instead of rows: at most ``run`` ids of one start and stop with as many of one start.  Only the last step
    makes pairs of them, list by list, so columns of the result are long runs and repeats, which files hold in a small
    part of a byte a pair.  A cell of more than ``block`` intervals is dealt to a grid of tasks, each of about a block
    of either side; a task writes the ids of few blocks, so their dictionaries stay within Parquet's limit.
    """
    least = int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, math.ceil(intervals.count() / block))
    ranged = intervals.where("start IS NOT NULL").select("id", "start", "stop").repartitionByRange(parts, "start", "stop", "id")
    ranged = materialize(ranged.withColumn("i", F.spark_partition_id()), "intervals")

    def lists(name: str, *key: str) -> DataFrame:
        """Ids of equal keys, which keep nulls, in order."""
        found = ranged.groupBy("i", *key).agg(F.sort_array(F.collect_list(F.struct("id"))).alias("ids"))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / run).cast("int")), lambda k: F.slice("ids", k * run + 1, run))
        return found.select(*key, F.explode(cut).alias(name)).withColumn("n", F.size(name))

    cells = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") + gap) / width))
    wide = materialize(lists("as", "start", "stop").select("as", "n", F.col("start").alias("sa"), F.col("stop").alias("ea"), F.explode(cells).alias("cell")), "wide")
    one = materialize(lists("bs", "start").select("bs", "n", F.col("start").alias("sb"), F.floor(F.col("start") / width).alias("cell")), "one")
    counts = [x.groupBy("cell").agg(F.ceil(F.sum("n") / block).cast("int").alias(name)) for x, name in ((wide, "rows"), (one, "cols"))]
    grid = materialize(counts[0].join(counts[1], "cell"), "grid")  # one row for each cell

    def place(n: str, ids: str) -> Column:
        return F.pmod(F.xxhash64(ids), F.col(n)).cast("int")

    def copies(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = skew_join(wide, grid, "cell", ["as"]).select("cell", place("rows", "as").alias("r"), copies("cols").alias("c"), "sa", "ea", "as")
    right = skew_join(one, grid, "cell", ["bs"]).select("cell", copies("rows").alias("r"), place("cols", "bs").alias("c"), "sb", "bs")
    key = ["cell", "r", "c"]
    met = right.repartition(parts, *key).join(left.repartition(parts, *key), key).where((F.col("sa") <= F.col("sb")) & (F.col("sb") - F.col("ea") <= gap))
    near = met.select("sa", "sb", "bs", F.greatest(F.col("sb") - F.col("ea"), F.lit(0)).alias("apart"), F.inline("as").alias("a"))
    near = near.select("sa", "sb", "a", "apart", F.inline("bs").alias("b"))
    return near.where((F.col("sa") < F.col("sb")) | (F.col("a") < F.col("b"))).select("a", "b", "apart")


__all__ = ["SEMIRINGS", "compressed_rows", "elementwise_or", "matrix_matrix", "matrix_vector", "overlapping", "semiring_provenance"]
