"""A driver for rules: facts from all chosen rules with stable ids, saturation to a fixed point, and its pruning."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import materialize

Rule = Callable[[Mapping[str, DataFrame]], DataFrame]


def stable_hash(*names: str) -> Column:
    """The digest of the canonical JSON of named columns: keys in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


def fact_id(rule: Column, subject: Column) -> Column:
    return F.sha2(F.concat_ws("|", rule, subject), 256)


class RuleSet:
    """Rules by name over named base relations; a rule gives (rule, subject, confidence)."""

    def __init__(self) -> None:
        self.rules: dict[str, Rule] = {}

    def add(self, name: str, rule: Rule) -> None:
        if name in self.rules:
            raise ValueError(f"rule {name!r} is there already")
        self.rules[name] = rule

    def run(self, facts: Mapping[str, DataFrame], chosen: list[str] | None = None) -> DataFrame:
        """(fact_id, rule, subject, confidence) of the chosen rules, each fact once with its greatest confidence."""
        unknown = set(chosen or ()) - self.rules.keys()
        if unknown:
            raise KeyError(f"unknown rules {sorted(unknown)}")
        out: DataFrame | None = None
        for name in sorted(self.rules if chosen is None else chosen):
            part = self.rules[name](facts).select("rule", "subject", "confidence")
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no rules")
        once = out.groupBy("rule", "subject").agg(F.max("confidence").alias("confidence"))
        return once.select(fact_id(F.col("rule"), F.col("subject")).alias("fact_id"), "rule", "subject", "confidence")


def pack_hash(facts: DataFrame, buckets: int = 256) -> DataFrame:
    """(hash): one digest of a set of facts, whatever their order; ids are digested by their first two letters, then those digests."""
    parts = facts.select("fact_id").distinct().groupBy(F.substring("fact_id", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("fact_id")), ","), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ","), 256).alias("hash"))


def saturate(base: DataFrame, rules: list[tuple[str, list[tuple[str, str, str]]]], max_rounds: int = 10_000) -> DataFrame:
    """(pred, a, b, confidence, round): binary facts closed under Horn rules, by semi-naive rounds.

    A rule is (head, body) with a body of one or two atoms (pred, x, y) over the
    variables of head(x, y): p(x, y), or p(x, z), q(z, y).  A fact keeps its
    greatest confidence; a derived one has the product of its body's.  Rounds
    end when nothing new or more confident is found, or an error is raised.
    """
    known = materialize(base.groupBy("pred", "a", "b").agg(F.max("confidence").alias("confidence")).withColumn("round", F.lit(0)), "saturate")
    fresh = known
    for turn in range(1, max_rounds + 1):
        made: list[DataFrame] = []
        for head, body in rules:
            if len(body) == 1:
                pred, x, y = body[0]
                one = fresh.where(F.col("pred") == pred)
                made.append(one.select(F.lit(head).alias("pred"), F.col("a" if x == "x" else "b").alias("a"), F.col("b" if y == "y" else "a").alias("b"), "confidence"))
                continue
            for left, right in ((fresh, known), (known, fresh)):
                p = left.where(F.col("pred") == body[0][0]).select("a", F.col("b").alias("m"), F.col("confidence").alias("c"))
                q = right.where(F.col("pred") == body[1][0]).select(F.col("a").alias("m"), "b", F.col("confidence").alias("d"))
                made.append(p.join(q, "m").select(F.lit(head).alias("pred"), "a", "b", (F.col("c") * F.col("d")).alias("confidence")))
        new = made[0]
        for part in made[1:]:
            new = new.unionByName(part)
        new = new.groupBy("pred", "a", "b").agg(F.max("confidence").alias("confidence"))
        old = known.select("pred", "a", "b", F.col("confidence").alias("old"))
        better = new.join(old, ["pred", "a", "b"], "left").where(F.col("old").isNull() | (F.col("confidence") > F.col("old") + 1e-12))
        fresh = materialize(better.select("pred", "a", "b", "confidence", F.lit(turn).alias("round")), "saturate")
        if fresh.isEmpty():
            return known
        known = known.join(fresh.select("pred", "a", "b"), ["pred", "a", "b"], "left_anti").unionByName(fresh)
        known = materialize(known, "saturate")
    raise RuntimeError(f"saturation not done after {max_rounds} rounds")


def prune(facts: DataFrame, least: float) -> DataFrame:
    """Base facts, and derived ones of enough confidence."""
    return facts.where((F.col("round") == 0) | (F.col("confidence") >= least))


def promote(statements: DataFrame, predicate: str) -> DataFrame:
    """(from_id, to_id, type, confidence): statements (subject, predicate, object, confidence) of a predicate as edges."""
    own = statements.where(F.col("predicate") == predicate)
    return own.groupBy(F.col("subject").alias("from_id"), F.col("object").alias("to_id"), F.col("predicate").alias("type")).agg(F.max("confidence").alias("confidence"))
