"""Cases and the hits they rest on: expansion by groups, the case of each hit, call sites to start from, order of bundles.

Cases: case_id, ord, priority (smaller is more urgent; none: 9999), evidence_hit_ids, evidence_group_ids (arrays). Groups:
group_id, ord, hit_ids. A case's hits stay rows of (case_id, hit_id): its list in each of its hits would grow with the square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import checkpointed

LAST = 9999


def members(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """case_id, hit_id, place: hits named by a case, then those of its groups, each once, by first mention; blank ids and
    unknown groups go."""
    own = cases.select("case_id", F.posexplode("evidence_hit_ids").alias("a", "hit_id")).select("case_id", "hit_id", F.struct(F.lit(0).alias("kind"), "a", F.lit(0).alias("b")).alias("place"))
    named = cases.select("case_id", F.posexplode("evidence_group_ids").alias("a", "group_id"))
    held = groups.select("group_id", F.posexplode("hit_ids").alias("b", "hit_id"))
    by_group = named.join(held, "group_id").select("case_id", "hit_id", F.struct(F.lit(1).alias("kind"), "a", "b").alias("place"))
    rows = own.unionByName(by_group).where(F.length("hit_id") > 0)
    return rows.groupBy("case_id", "hit_id").agg(F.min("place").alias("place"))


def group_of_hit(groups: DataFrame) -> DataFrame:
    """hit_id, group_id: of several groups with a hit the last."""
    return groups.select("group_id", "ord", F.explode("hit_ids").alias("hit_id")).where(F.length("hit_id") > 0).groupBy("hit_id").agg(F.max_by("group_id", "ord").alias("group_id"))


def case_groups(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id: groups that any case names, and those of the hits that any names."""
    named = cases.select(F.explode("evidence_group_ids").alias("group_id")).where(F.length("group_id") > 0)
    hits = cases.select(F.explode("evidence_hit_ids").alias("hit_id")).distinct()
    return named.union(group_of_hit(groups).join(hits, "hit_id", "left_semi").select("group_id")).distinct()


def _sized(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """members with their case's ord, priority and number of hits."""
    rows = checkpointed(members(cases, groups))  # met twice
    total = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("total_case_hits"))
    return rows.join(total, "case_id").join(cases.select("case_id", F.col("ord").alias("case_ord"), F.coalesce("priority", F.lit(LAST)).alias("priority")), "case_id")


def case_of_hit(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """hit_id, case_id, priority, total_case_hits: the most urgent case with a hit, the first at a tie."""
    best = F.min_by(F.struct("case_id", "priority", "total_case_hits"), F.struct("priority", "case_ord"))
    return _sized(cases, groups).groupBy("hit_id").agg(best.alias("c")).select("hit_id", "c.*")


def call_sites(cases: DataFrame, groups: DataFrame, hits: DataFrame) -> DataFrame:
    """Known hits (hit_id and what else hits has) of all cases, each once, with the first case that names it and its group;
    seed_order: by case, then place."""
    first = F.min_by(F.struct("case_id", "priority", "total_case_hits", "case_ord", "place"), F.struct("case_ord", "place"))
    rows = _sized(cases, groups).groupBy("hit_id").agg(first.alias("c")).select("hit_id", "c.case_id", "c.priority", "c.total_case_hits", F.struct("c.case_ord", "c.place").alias("seed_order"))
    return rows.join(hits, "hit_id").join(group_of_hit(groups), "hit_id", "left")


def bundle_priority(bundles: DataFrame, cases: DataFrame, groups: DataFrame) -> DataFrame:
    """bundles (seed_id, ord, case_priority) plus priority: the more urgent of the seed's case and the bundle's own; to be
    sorted by priority and ord."""
    known = case_of_hit(cases, groups).select(F.col("hit_id").alias("seed_id"), F.col("priority").alias("_p"))
    out = bundles.join(known, "seed_id", "left")
    return out.withColumn("priority", F.least(F.coalesce("_p", F.lit(LAST)), F.coalesce("case_priority", F.lit(LAST)))).drop("_p")


def case_facts(seeds: DataFrame, path_facts: DataFrame) -> DataFrame:
    """case_id, seed_id, method, fact_index, fact: facts of seeds (facts: array), without method and index, and those of the
    methods on their paths (method, facts)."""
    own = seeds.select("case_id", "seed_id", F.explode("facts").alias("fact")).select("case_id", "seed_id", F.lit(None).cast("string").alias("method"), F.lit(None).cast("int").alias("fact_index"), "fact")
    return own.unionByName(path_facts.select("case_id", "seed_id", "method", F.posexplode("facts").alias("fact_index", "fact")))


def requirement_outputs(requirements: DataFrame, outputs: DataFrame) -> DataFrame:
    """outputs (requirement_id, seed_id, ...) with their requirement: the output's own seed, else the requirement's; category
    unknown where there is none."""
    known = requirements.select("requirement_id", F.col("seed_id").alias("_seed"), "category", "component_name")
    out = outputs.join(known, "requirement_id", "left")
    return out.withColumn("seed_id", F.coalesce(F.nullif("seed_id", F.lit("")), "_seed", F.lit(""))).withColumn("category", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown"))).withColumn("component_name", F.coalesce("component_name", F.lit(""))).drop("_seed")


def merged_guidance(outputs: DataFrame) -> DataFrame:
    """case_id, steps, manual_steps: those of all outputs of a case, in order of the outputs (ord) and within them."""
    cut = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce(c, F.array().cast("array<string>")).alias("s")))), lambda x: x["s"]))
    return outputs.groupBy("case_id").agg(cut(F.col("steps")).alias("steps"), cut(F.col("manual_steps")).alias("manual_steps"))
