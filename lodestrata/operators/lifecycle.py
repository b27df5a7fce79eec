"""Records through time and tiers: newest first, cold lookups, parked scopes, closed intervals, logs and merges by rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(items: DataFrame, tenant: str, status: str | None = None, since: int | None = None, before: int | None = None, limit: int = 100) -> DataFrame:
    """Items (id, tenant, status, updated_ms, ...) of a tenant, newest first; ``since`` is included, ``before`` is not."""
    out = items.where(F.col("tenant") == tenant)
    for given, condition in ((status, lambda v: F.col("status") == v), (since, lambda v: F.col("updated_ms") >= v), (before, lambda v: F.col("updated_ms") < v)):
        out = out if given is None else out.where(condition(given))
    return out.orderBy(F.col("updated_ms").desc(), "id").limit(limit)


def coldest_below(entries: DataFrame, cutoff: float, limit: int) -> DataFrame:
    """Entries (member, score) last read before a cutoff, the oldest first."""
    return entries.where(F.col("score") < cutoff).orderBy("score", "member").limit(limit)


def cold_lookup(cold: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, content_hash, scope) of evicted records by id."""
    return ids.select("id").distinct().join(cold.select("id", "content_hash", "scope"), "id")


def park(hot: DataFrame, parked: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """(hot, parked) after all records of a scope have left the hot tier."""
    here = F.col("scope") == scope
    return hot.where(~F.coalesce(here, F.lit(False))), parked.unionByName(hot.where(here))


def unpark(hot: DataFrame, parked: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """(hot, parked) after a scope has come back; a record written since stays as it is."""
    here = F.col("scope") == scope
    back = parked.where(here).join(hot.select("id"), "id", "left_anti")
    return hot.unionByName(back.select(*hot.columns)), parked.where(~F.coalesce(here, F.lit(False)))


def close_interval(facts: DataFrame, condition: Column, at: int) -> DataFrame:
    """Facts (..., valid_from, valid_to): those that meet a condition and hold at an instant end there; history stays."""
    open_ = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    return facts.withColumn("valid_to", F.when(F.coalesce(condition, F.lit(False)) & open_, F.lit(at)).otherwise(F.col("valid_to")))


def read_log(log: DataFrame, cursor: int, limit: int, kinds: list[str] | None = None) -> DataFrame:
    """Entries (seq, kind, ...) after a cursor in order of seq."""
    out = log.where(F.col("seq") > cursor)
    out = out if kinds is None else out.where(F.col("kind").isin(kinds))
    return out.orderBy("seq").limit(limit)


def replay(log: DataFrame, key: str) -> DataFrame:
    """The state after a log (seq, kind, key, ...): each key's last entry, unless that deletes it."""
    last = Window.partitionBy(key).orderBy(F.col("seq").desc())
    return log.withColumn("_n", F.row_number().over(last)).where("_n = 1 AND kind <> 'delete'").drop("_n")


def allowed(policy: dict[str, object]) -> Column:
    """The condition of a candidate policy: lists of scopes, repos, users and labels, a least trust, a least freshness."""
    parts: list[Column] = []
    for name in ("scope", "repo", "user"):
        if policy.get(name):
            parts.append(F.col(name).isin(policy[name]))
    if policy.get("labels"):
        parts.append(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in policy["labels"]])))
    if "least_trust" in policy:
        parts.append(F.col("trust") >= policy["least_trust"])
    if "since_ms" in policy:
        parts.append(F.col("updated_ms") >= policy["since_ms"])
    return F.coalesce(reduce(Column.__and__, parts, F.lit(True)), F.lit(False))


def across(found: list[DataFrame], k: int) -> DataFrame:
    """The k nearest (id, distance) of several searches; an id keeps its least distance."""
    both = reduce(DataFrame.unionByName, [df.select("id", "distance") for df in found])
    return both.groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id").limit(k)


def place_time_label(rows: DataFrame, box: tuple[float, float, float, float], label: str, start: int, stop: int) -> DataFrame:
    """Rows (id, lat, lon, labels, start, stop) in a box (south, west, north, east), of a label, that hold in an interval; the box may cross 180 degrees."""
    south, west, north, east = box
    lon = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    alive = (F.col("start") <= stop) & (F.coalesce("stop", F.lit(2**62)) >= start)
    return rows.where(F.col("lat").between(south, north) & lon & F.array_contains("labels", label) & alive)


def common_values(facts: DataFrame, fields: list[str]) -> DataFrame:
    """(value) that all of several fields of facts (field, value) hold."""
    own = facts.where(F.col("field").isin(fields) & F.col("value").isNotNull())
    return own.groupBy("value").agg(F.count_distinct("field").alias("n")).where(F.col("n") == len(set(fields))).select("value")


def merge_fields(left: DataFrame, right: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Two replicas merged by a rule for each field: lww (with <field>_t), union (of arrays), or sum (of deltas)."""
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    out = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    for name, rule in rules.items():
        one, two = F.col(f"a.{name}"), F.col(f"b.{name}")
        if rule == "lww":
            picked = [F.when(F.col(f"{s}.{key}").isNotNull(), F.struct(F.col(f"{s}.{name}_t").alias("t"), F.col(f"{s}.{name}").alias("v"))) for s in ("a", "b")]
            best = F.greatest(*picked)
            out += [best["v"].alias(name), best["t"].alias(f"{name}_t")]
        elif rule == "union":
            out.append(F.array_sort(F.array_distinct(F.concat(F.coalesce(one, F.array()), F.coalesce(two, F.array())))).alias(name))
        elif rule == "sum":
            out.append((F.coalesce(one, F.lit(0)) + F.coalesce(two, F.lit(0))).alias(name))
        else:
            raise ValueError(f"unknown rule {rule!r}")
    return joined.select(*out)


def contrast_pairs(claims: DataFrame, per_claim: int) -> DataFrame:
    """(a, b, score): of claims (id, topic, stance, weight) the strongest pairs of one topic and unlike stance, a bound for each claim.

    Claims of a topic meet as sides of a join on it, and only unlike stances.
    """
    a = claims.select(F.col("id").alias("a"), "topic", F.col("stance").alias("sa"), F.col("weight").alias("wa"))
    b = claims.select(F.col("id").alias("b"), "topic", F.col("stance").alias("sb"), F.col("weight").alias("wb"))
    pairs = a.join(b, "topic").where((F.col("sa") != F.col("sb")) & (F.col("a") < F.col("b"))).select("a", "b", (F.col("wa") * F.col("wb")).alias("score"))
    order = Window.partitionBy("a").orderBy(F.col("score").desc(), "b")
    return pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_claim).drop("nth")


def robots(rules: DataFrame, pages: DataFrame, agent: str) -> DataFrame:
    """(url, decision, delay) of pages (url, host, path) under rules (host, agent, kind, value).

    Kinds are allow, disallow and delay; an agent's own group counts before
    that of ``*``.  The longest rule that begins the path decides, allow among equals.
    """
    own = rules.where(F.lower("agent").isin(agent.lower(), "*")).withColumn("mine", F.lower("agent") == agent.lower())
    best = own.groupBy("host").agg(F.max("mine").alias("mine"))
    own = own.join(best, ["host", "mine"])
    paths = own.where("kind <> 'delay' AND value <> ''").select("host", "kind", "value")
    hit = pages.join(paths, "host").where(F.startswith("path", F.col("value")))
    decided = hit.groupBy("url").agg(F.max(F.struct(F.length("value").alias("n"), (F.col("kind") == "allow").alias("ok"))).alias("best"))
    delay = own.where("kind = 'delay'").groupBy("host").agg(F.max(F.col("value").cast("double")).alias("delay"))
    out = pages.join(decided, "url", "left").join(delay, "host", "left")
    return out.select("url", F.when(F.coalesce(F.col("best.ok"), F.lit(True)), "allow").otherwise("disallow").alias("decision"), "delay")


def virtual_field(c: Column, transform: str, delimiter: str = "", index: int = 0) -> Column:
    """A field made of another one: copy, lowercase, or a part (from 0) of a split; a part that is not there is null."""
    if transform == "copy":
        return c
    if transform == "lowercase":
        return F.lower(c)
    if transform == "split":
        return F.get(F.split(c, "\\Q" + delimiter + "\\E", -1), F.lit(index))
    raise ValueError(f"unknown transform {transform!r}")


def resolve_alias(name: Column, aliases: dict[str, str]) -> Column:
    """Internal names of external ones; others stay."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")
    return F.coalesce(known[name], name)
