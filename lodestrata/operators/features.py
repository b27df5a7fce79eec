"""A small language of features: a JSON tree compiles to one column expression, or is refused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"eq": Column.__eq__, "ne": Column.__ne__, "lt": Column.__lt__, "le": Column.__le__, "gt": Column.__gt__, "ge": Column.__ge__}
_ARITHMETIC = {"add": Column.__add__, "sub": Column.__sub__, "mul": Column.__mul__}
MAX_DEPTH, MAX_STEPS, MAX_NODES = 8, 64, 4


def _size(node: object) -> tuple[int, int]:
    """(depth, nodes) of a tree."""
    if not isinstance(node, dict):
        return 0, 0
    inner = [_size(x) for value in node.values() for x in (value if isinstance(value, list) else [value])]
    return 1 + max((d for d, _ in inner), default=0), 1 + sum(n for _, n in inner)


def compile_feature(tree: dict, counts: dict[str, Column] | None = None) -> Column:
    """The column of a tree: const, field, compare, and/or/not, arithmetic, min, max, and count or exists of a hop.

    ``counts`` maps a relation's name to the joined number of hops; a missing
    value or a comparison with one gives the tree's ``otherwise``, or null.
    """
    depth, nodes = _size(tree)
    if depth > MAX_DEPTH or nodes > MAX_STEPS:
        raise ValueError("the feature is too deep or too long")
    return _compile(tree, counts or {})


def _compile(t: dict, counts: dict[str, Column]) -> Column:
    op = t["op"]
    parts = [_compile(x, counts) for x in t.get("args", [])]
    if op == "const":
        out = F.lit(t["value"])
    elif op == "field":
        out = F.col(t["name"])
    elif op in _COMPARE and len(parts) == 2:
        out = _COMPARE[op](*parts)
    elif op in _ARITHMETIC and len(parts) == 2:
        out = _ARITHMETIC[op](*parts)
    elif op in ("min", "max") and parts:
        out = parts[0] if len(parts) == 1 else (F.least if op == "min" else F.greatest)(*parts)
    elif op in ("and", "or") and parts:
        out = reduce(Column.__and__ if op == "and" else Column.__or__, parts)
    elif op == "not" and len(parts) == 1:
        out = ~parts[0]
    elif op in ("count", "exists") and t.get("hop") in counts:
        n = F.coalesce(counts[t["hop"]], F.lit(0))
        out = n if op == "count" else n > 0
    else:
        raise ValueError(f"unsupported feature {op!r}")
    return F.coalesce(out, F.lit(t["otherwise"])) if "otherwise" in t else out


def hop_counts(rows: DataFrame, key: str, edges: DataFrame, hops: dict[str, str]) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the number of edges (from_id, type) of each named type, and those columns for ``compile_feature``."""
    if len(hops) > MAX_NODES:
        raise ValueError("too many traversals")
    names = {name: f"_hop_{at}" for at, name in enumerate(hops)}
    counted = edges.groupBy("from_id").agg(*[F.count_if(F.col("type") == kind).alias(names[name]) for name, kind in hops.items()])
    return rows.join(counted, rows[key] == counted["from_id"], "left").drop("from_id"), {name: F.col(c) for name, c in names.items()}


def feature_scores(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Rows with score: features clamped to 0..1 after their weight, summed."""
    clamped = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(name) * weight)) for name, weight in weights.items()]
    return rows.withColumn("score", reduce(Column.__add__, clamped, F.lit(0.0)))


def component_fusion(rows: DataFrame, components: str, weights: dict[str, float]) -> DataFrame:
    """Rows with score: a map column of components by name, times their weights (1 where none is named), summed."""
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
    total = F.aggregate(F.map_entries(components), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(known[e["key"]], F.lit(1.0)))
    return rows.withColumn("score", total)


def listwise_blend(rows: DataFrame, score: str, list_rank: str, n: Column, weight: float = 0.2) -> DataFrame:
    """Rows with blended: the score, and a rank from 0 in a list of n as a share from 1 down, by weight; unlisted rows get no share."""
    share = F.when(F.col(list_rank).isNull(), F.lit(0.0)).otherwise(1 - F.col(list_rank) / n)
    return rows.withColumn("blended", (1 - weight) * F.col(score) + weight * share)


def field_sort(rows: DataFrame, fields: list[tuple[str, bool]], tie: str = "id") -> DataFrame:
    """Rows in order of several fields (name, descending); missing values come last upwards and first downwards; ties by id."""
    return rows.orderBy(*[F.col(n).desc_nulls_first() if down else F.col(n).asc_nulls_last() for n, down in fields], tie)


def select_packs(packs: DataFrame, wanted: list[str], floor: float, k: int) -> DataFrame:
    """(id, score): packs (id, trust, topics) of enough trust, by the share of the wanted topics that they cover times their trust."""
    covered = F.size(F.array_intersect("topics", F.array(*[F.lit(w) for w in wanted]))) / F.lit(float(len(wanted)))
    scored = packs.where(F.col("trust") >= floor).select("id", (covered * F.col("trust")).alias("score"))
    return scored.where("score > 0").orderBy(F.col("score").desc(), "id").limit(k)
