"""Flows composed of analysed methods, and what a report says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_analysis(path_methods: DataFrame, cache: DataFrame, placeholder: str = "not analysed") -> DataFrame:
    """path_methods (flow_id, pos, method) with each method's cached analysis (method, summary, confidence, source)."""
    rows = path_methods.join(cache, "method", "left")
    return rows.withColumn("summary", F.coalesce("summary", F.lit(placeholder)))


def compose(rows: DataFrame) -> DataFrame:
    """One row for each flow: summaries in order of the path, the last framework method as sink, mean confidence of the
    methods whose source was read (0.5 without any)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "method", "summary")))
    sink = F.max_by("method", F.when(F.col("method").rlike(r"^<(android|java|javax|dalvik)\."), F.col("pos")))
    out = rows.groupBy("flow_id").agg(ordered.alias("x"), sink.alias("sink"), F.coalesce(F.avg(F.when(F.col("source") == "jadx", F.col("confidence"))), F.lit(0.5)).alias("confidence"))
    return out.select("flow_id", F.size("x").alias("n_methods"), F.array_join(F.transform("x", lambda x: x["summary"]), " → ").alias("summary"), "sink", "confidence")


def first_inputs(inputs: DataFrame) -> DataFrame:
    """Inputs of each flow, of one type and name the first."""
    return inputs.groupBy("flow_id", "type", "name").agg(F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord"))


def method_usage(path_methods: DataFrame) -> DataFrame:
    return path_methods.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("flow_id")).alias("flows")).orderBy(F.desc("n"), "method")


def call_texts(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Call-site text of each (caller, callee): that of the first edge."""
    first = edges.groupBy("caller", "callee").agg(F.min_by("callsite", "ord").alias("callsite"))
    return pairs.join(first, ["caller", "callee"], "left")


def chain_summary(effects: Column, most: int = 3) -> Column:
    return F.array_join(F.slice(effects, 1, most), "; ")


def guidance(rows: DataFrame, key: list[str]) -> DataFrame:
    """The first guidance of each key with its gaps filled."""
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in key]), "ord").alias("g")).select(*key, "g.*")
    return first.fillna({c: "unknown" for c, kind in first.dtypes if kind == "string" and c not in key})


def permissions(rows: DataFrame) -> DataFrame:
    """permission, evidence, confidence: the most confident row of each, the first at a tie. rows: permission, evidence (array),
    confidence, ord. Read in order, a row that is more confident than all before takes over their evidence; one that isn't is
    left out with its own."""
    w = Window.partitionBy("permission").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max("confidence").over(w)
    kept = rows.withColumn("_best", best).where(F.col("_best").isNull() | (F.col("confidence") > F.col("_best")))
    return kept.groupBy("permission").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"), F.max("confidence").alias("confidence"))


def coverage_level(n_calls: Column, n_guards: Column, has_entrypoint: Column, n_ambiguous: Column) -> Column:
    """COMPLETE with call sites, guards, an entrypoint and nothing ambiguous; MINIMAL with neither call sites nor guards;
    else PARTIAL."""
    whole = (n_calls > 0) & (n_guards > 0) & has_entrypoint & (n_ambiguous == 0)
    return F.when(whole, "COMPLETE").when((n_calls == 0) & (n_guards == 0), "MINIMAL").otherwise("PARTIAL")


def drifted(extracted: Column, listed: Column, most: float = 0.3) -> Column:
    """Whether the number of extracted call sites is off the listed one by more than a share of it; any is, where none is
    listed."""
    return F.when(listed == 0, extracted > 0).otherwise(F.abs(listed - extracted) / listed > most)


def feasibility(rows: DataFrame) -> DataFrame:
    """Feasibility of a flow from its steps': full if all are, blocked if any is, else partial."""
    every, any_blocked = F.every(F.col("feasibility") == "full"), F.bool_or(F.col("feasibility") == "blocked")
    return rows.groupBy("flow_id").agg(F.when(every, "full").when(any_blocked, "blocked").otherwise("partial").alias("feasibility"))


def warnings_of(*checks: tuple[Column, str]) -> Column:
    """Texts of the checks that hold, in order; never null."""
    return F.filter(F.array(*(F.when(c, t) for c, t in checks)), lambda x: x.isNotNull())


def grouped_calls(events: DataFrame) -> DataFrame:
    """tab, n, place of model calls: all, those without a seed, then each seed in order of its first call."""
    seeds = events.where("seed_id is not null").groupBy(F.col("seed_id").alias("tab")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    every = events.agg(F.lit("All").alias("tab"), F.count(F.lit(1)).alias("n"), F.lit(-2).cast("bigint").alias("first"))
    recon = events.where("seed_id is null").agg(F.lit("Recon").alias("tab"), F.count(F.lit(1)).alias("n"), F.lit(-1).cast("bigint").alias("first"))
    return every.union(recon).union(seeds.select("tab", "n", F.col("first").cast("bigint")))
