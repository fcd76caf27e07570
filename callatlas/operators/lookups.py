"""Listings, subsets and contexts that a caller asks for by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOOT_ACTIONS = ("android.intent.action.BOOT_COMPLETED", "android.intent.action.LOCKED_BOOT_COMPLETED", "android.intent.action.QUICKBOOT_POWERON")


def listing(rows: DataFrame, limit: object = None, usual: int = 20, category: str | None = None) -> DataFrame:
    """The first rows by ord, of one category if given (among categories or string_categories); a limit that is no positive
    whole number counts as the usual one."""
    n = int(limit) if str(limit).isdigit() and int(limit) > 0 else usual
    if category:
        rows = rows.where(F.array_contains("categories", category) | F.array_contains(F.coalesce("string_categories", F.array().cast("array<string>")), category))
    return rows.orderBy("ord").limit(n)


def first_each(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key; a plain limit would be one for all."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def rule_subset(rules: DataFrame, keywords: DataFrame) -> DataFrame:
    """Rules whose signature contains one of a short list of keywords."""
    packed = keywords.agg(F.collect_set(F.lower("keyword")).alias("_keywords"))
    return rules.join(F.broadcast(packed), F.lit(True)).where(F.exists("_keywords", lambda k: F.contains(F.lower("signature"), k))).drop("_keywords")


def bundle_key(case_id: Column, caller: Column, seed_id: Column) -> Column:
    return F.when(case_id.isNotNull(), F.concat(F.lit("CASE:"), case_id, F.lit(":"), caller)).otherwise(F.concat(F.lit("SINGLE:"), seed_id))


def static_context(manifest: DataFrame, strings: DataFrame, most: int = 200) -> DataFrame:
    """analysis_id, permissions (sorted), starts_at_boot, strings (the first `most` by ord)."""
    near = first_each(strings, "analysis_id", ["ord"], most).groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("x"))
    near = near.select("analysis_id", F.transform("x", lambda x: x["value"]).alias("strings"))
    boot = F.arrays_overlap(F.coalesce("actions", F.array().cast("array<string>")), F.array(*map(F.lit, BOOT_ACTIONS)))
    return manifest.join(near, "analysis_id", "left").select("analysis_id", F.array_sort(F.array_distinct(F.coalesce("permissions", F.array().cast("array<string>")))).alias("permissions"), boot.alias("starts_at_boot"), F.coalesce("strings", F.array().cast("array<string>")).alias("strings"))


def fallback_cases(groups: DataFrame) -> DataFrame:
    """A case for each group, for when none was made: CASE-GRP- and the first 8 characters of the group's digest."""
    digest = F.regexp_replace("group_id", "^grp-", "")
    return groups.select("analysis_id", F.concat(F.lit("CASE-GRP-"), F.left(digest, F.lit(8))).alias("case_id"), "group_id", F.row_number().over(Window.partitionBy("analysis_id").orderBy("ord", "group_id")).alias("place"))


def component_hints(seeds: DataFrame, paths: DataFrame, manifest: DataFrame) -> DataFrame:
    """Component of each seed with a confidence: of its path's entrypoint 0.95, of a manifest name that its class ends with or
    lies in 0.8, else the class itself 0.3. seeds: seed_id, class; paths: seed_id, component; manifest: name, ord."""
    packed = manifest.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("_names"))
    rows = seeds.join(paths, "seed_id", "left").join(F.broadcast(packed), F.lit(True))
    met = F.get(F.filter("_names", lambda n: F.endswith(n, F.col("class")) | F.startswith(F.col("class"), n)), F.lit(0))
    rows = rows.withColumn("_met", met)
    return rows.select("seed_id", F.coalesce("component", "_met", "class").alias("component"), F.when(F.col("component").isNotNull(), 0.95).when(F.col("_met").isNotNull(), 0.8).otherwise(0.3).alias("confidence"))


def changed_runs(before: DataFrame, after: DataFrame, key: str = "run_id") -> DataFrame:
    """Runs that are new or whose summary differs from the last snapshot's."""
    digest = lambda d: d.select(key, F.xxhash64(*sorted(d.columns)).alias("digest"))
    return after.join(digest(after).join(digest(before), [key, "digest"], "left_anti").select(key), key, "left_semi")


def violations(rows: DataFrame, *checks: tuple[str, Column]) -> DataFrame:
    """Rows with the names of the checks that fail, for hand-offs between stages."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks)), lambda x: x.isNotNull())
    return rows.withColumn("errors", F.array_join(failed, "; ")).where("errors <> ''")


def bare_runs(folders: DataFrame, ledgers: DataFrame) -> DataFrame:
    """Run folders that no ledger names."""
    return folders.join(ledgers, ["analysis_id", "run_id"], "left_anti")
