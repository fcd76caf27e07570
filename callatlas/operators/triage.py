"""Cases, seeds and what they leave uncovered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_case(cases: DataFrame, key: str, priority: Column, order: Column) -> DataFrame:
    """The case of each hit with the lowest priority number, the first at a tie."""
    return cases.groupBy(key).agg(F.min_by(F.struct(*[c for c in cases.columns if c != key]), F.struct(priority, order)).alias("case")).select(key, "case.*")


def keep_cases(cases: DataFrame, least: float = 0.8) -> DataFrame:
    """Cases that are not to be pruned with confidence."""
    return cases.where(~(F.coalesce("should_prune", F.lit(False)) & (F.coalesce("pruning_confidence", F.lit(0.0)) >= least)))


def uncovered(groups: DataFrame, covered: DataFrame, pruned: DataFrame | None = None, key: str = "group_id") -> DataFrame:
    left = groups.join(covered, key, "left_anti")
    return left.join(pruned, key, "left_anti") if pruned is not None else left


def merge_call_sites(seeds: DataFrame) -> DataFrame:
    """Seeds of one case and caller: the best as primary, signatures and categories together."""
    out = seeds.groupBy("case_id", "caller").agg(
        F.min_by("seed_id", F.struct("priority", "ord")).alias("primary_seed"), F.array_sort(F.collect_set("seed_id")).alias("seed_ids"),
        F.array_sort(F.collect_set("signature")).alias("signatures"), F.array_sort(F.collect_set("category")).alias("categories"))
    single = F.size("categories") == 1
    return out.withColumn("category", F.when(single, F.get("categories", F.lit(0))).otherwise(F.format_string("MERGED(%d)", F.size("categories"))))


def confidence_histogram(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy(F.format_string("%.1f", "confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def platform_version(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """The smallest version at or above the wanted one, else the largest there is. have: version; wanted: id, target.

    The versions are few; each wanted row looks its place up in their sorted array.
    """
    all_versions = have.agg(F.array_sort(F.collect_set("version")).alias("versions"))
    rows = wanted.join(F.broadcast(all_versions), F.lit(True))
    at_least = F.get(F.filter("versions", lambda v: v >= F.col("target")), F.lit(0))
    return rows.select("id", "target", F.coalesce(at_least, F.element_at("versions", F.lit(-1))).alias("version"))


def last_definition(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The last defined value before each row of its key."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("last_value", F.last(value, ignorenulls=True).over(w))


def max_confidence(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key with the highest confidence, the first at a tie."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct("confidence", -F.col("ord"))).alias("r")).select(key, "r.*")


def resolve_values(uses: DataFrame, definitions: DataFrame, steps: int = 6) -> DataFrame:
    """uses (method, idx, value, and analysis_id, where there is one) plus resolved: the value behind locals and casts.

    definitions: method, idx, local, value. A step takes off a cast, or goes from a local to its last definition at or before
    the use; after `steps` steps, or without a definition, what is there stays. Definitions and uses are shuffled once, by method, and
    lie together from then on: a step is a window over a local's definitions and uses, which reads the rows of the step before once.
    """
    key = [c for c in ("analysis_id",) if c in uses.columns] + ["method"]
    asked = uses.select(*key, "idx", F.lit(1).alias("_side"), F.col("value").alias("_value"), F.struct(*uses.columns).alias("_use"))
    given = definitions.where(" and ".join(f"{c} is not null" for c in (*key, "idx", "local")))
    given = given.select(*key, "idx", F.lit(0).alias("_side"), "value", "local")
    asked = asked.withColumn("_local", F.lit(None).cast(given.schema["local"].dataType))
    given = given.select(*key, "idx", "_side", F.col("value").alias("_value"), F.lit(None).cast(asked.schema["_use"].dataType).alias("_use"), F.col("local").alias("_local"))
    rows = given.unionByName(asked).repartition(*key)
    cast = r"^\([^()]+\)\s+"
    is_use = F.col("_side") == 1
    before = Window.partitionBy(*key, "_local").orderBy("idx", "_side", F.when(~is_use, F.col("_value"))).rowsBetween(Window.unboundedPreceding, 0)
    told = F.last(F.when(~is_use, F.struct(F.col("_value").alias("value"))), ignorenulls=True).over(before)
    for _ in range(steps):
        rows = rows.withColumn("_local", F.when(~is_use, F.col("_local")).when(~F.col("_value").rlike(cast), F.col("_value")))
        rows = rows.withColumn("_told", told)
        known = is_use & F.col("_local").isNotNull() & F.col("method").isNotNull()
        plain = F.when(is_use, F.regexp_replace("_value", cast, "")).otherwise(F.col("_value"))
        rows = rows.withColumn("_value", F.coalesce(F.when(known, F.col("_told.value")), plain)).drop("_told")
    return rows.where(is_use).select(*(F.col("_use")[c].alias(c) for c in uses.columns), F.col("_value").alias("resolved"))
