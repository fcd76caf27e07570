"""Sensitive calls: call edges matched with an API catalog, filtered, deduplicated and ranked.

Edges: analysis_id, ord, caller, callee and optional attributes. Catalog: category_id, signature, priority, weight. The catalog
and prefix lists are written by hand and joined as they come; Catalyst broadcasts them below its threshold and hashes both
sides beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signatures as S

REASONS = ("framework", "library", "not_app", "kept")
#: Weight of an edge by its source; synthetic ones by confidence high, medium, low.
STRICT_WEIGHTS = {"soot_cg": 1, "jimple_invoke": 2}
SYNTHETIC_WEIGHTS = {"threading_synthetic": (3, 5, 8), "listener_synthetic": (4, 6, 10)}


#: Parts of signatures that stand for reflection and loading of classes.
REFLECTION_PATTERNS = (
    "java.lang.reflect.Method", "java.lang.reflect.Constructor", "java.lang.reflect.Field", "java.lang.Class.forName", "java.lang.Class.getDeclaredMethod", "java.lang.Class.getMethod",
    "java.lang.Class.getDeclaredConstructor", "java.lang.Class.newInstance", "dalvik.system.DexClassLoader", "dalvik.system.PathClassLoader", "dalvik.system.InMemoryDexClassLoader", "java.lang.ClassLoader.loadClass",
)


def usable_edges(edges: DataFrame) -> DataFrame:
    return edges.where((F.length("caller") > 0) & (F.length("callee") > 0))


def filter_reason(is_framework: Column, is_library: Column, is_app: Column) -> Column:
    """First reason that drops an edge, `kept` if none does."""
    return F.when(is_framework, "framework").when(is_library, "library").when(~is_app, "not_app").otherwise("kept")


def with_framework_flag(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """is_framework of the caller: a node's own flag (null: false, last of repeated nodes), else by prefix of its class."""
    flags = nodes.groupBy("analysis_id", F.col("method").alias("caller")).agg(F.max_by(F.coalesce("is_android_framework", F.lit(False)), "ord").alias("flag"))
    return edges.join(flags, ["analysis_id", "caller"], "left").withColumn("is_framework", F.coalesce("flag", S.is_framework_name(S.class_of(F.col("caller"))))).drop("flag")


def exact_matches(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    return edges.join(catalog, edges["callee"] == catalog["signature"]).withColumn("match_type", F.lit("exact"))


def hierarchy_matches(edges: DataFrame, catalog: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Callees that the catalog misses, matched by method, return type and parameters where one class is the other's
    supertype. subtypes: class, supertype (transitive), and analysis_id, where each analysis has its own."""
    missed = edges.join(catalog.select(F.col("signature").alias("callee")).distinct(), "callee", "left_anti")
    key = lambda c: [S.method_of(c), S.return_of(c), F.array_join(S.params_of(c), ",")]
    names = ["m", "r", "p"]
    left = missed.select("*", S.class_of(F.col("callee")).alias("callee_class"), *(e.alias(n) for n, e in zip(names, key(F.col("callee")))))
    right = catalog.select("*", S.class_of(F.col("signature")).alias("catalog_class"), *(e.alias(n) for n, e in zip(names, key(F.col("signature")))))
    own = [c for c in ("analysis_id",) if c in subtypes.columns]
    either = subtypes.select(*own, F.col("class").alias("callee_class"), F.col("supertype").alias("catalog_class")).distinct()
    both = either.union(either.select(*own, F.col("catalog_class").alias("callee_class"), F.col("callee_class").alias("catalog_class"))).distinct()
    # the catalog is spread over related classes first: by method, return type and parameters alone an edge would meet every class of it
    related = left.join(right.join(both, "catalog_class"), [*own, "callee_class", *names])
    same = left.join(right.withColumn("callee_class", F.col("catalog_class")), ["callee_class", *names])
    return related.unionByName(same).drop(*names, "callee_class", "catalog_class").withColumn("match_type", F.lit("hierarchy"))


def first_hits(hits: DataFrame) -> DataFrame:
    """One hit for each caller, callee and category: the first by ord, with its id."""
    key = ["analysis_id", "caller", "callee", "category_id"]
    rest = F.struct(*[c for c in hits.columns if c not in key])
    kept = hits.groupBy(*key).agg(F.min_by(rest, "ord").alias("_first")).select(*key, "_first.*")
    return kept.withColumn("hit_id", S.sha1_id("hit-", F.col("category_id"), F.col("caller"), F.col("callee")))


def by_category(hits: DataFrame) -> DataFrame:
    return hits.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min_by("priority", S.priority_rank(F.col("priority"))).alias("priority"), F.max("weight").alias("weight"))


def ranked(hits: DataFrame, n: int | None = None) -> DataFrame:
    """Rank within an analysis: priority, then investigability and weight (both falling), then ord, caller and callee; the first
    n if given."""
    w = Window.partitionBy("analysis_id").orderBy(S.priority_rank(F.col("priority")), F.desc("investigability"), F.desc("weight"), "ord", "caller", "callee")
    out = hits.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= n) if n else out


def edge_weight(source: Column, confidence: Column, synthetic: bool = False) -> Column:
    """Whole-number weight of an edge; larger ones are less certain."""
    out = F.lit(20 if synthetic else 3)
    for name, w in STRICT_WEIGHTS.items():
        out = F.when(source == name, w).otherwise(out)
    if synthetic:
        for name, (high, medium, low) in SYNTHETIC_WEIGHTS.items():
            out = F.when(source == name, F.when(confidence == "high", high).when(confidence == "medium", medium).otherwise(low)).otherwise(out)
        out = F.when(source == "callback_synthetic", 25).otherwise(out)
    return out


def best_edges(edges: DataFrame, weight: Column) -> DataFrame:
    """One edge for each pair of methods: least weight, then source, then ord. The minimum is combined before the shuffle."""
    tie = F.when(F.col("edge_source") == "soot_cg", 0).when(F.col("edge_source") == "jimple_invoke", 1).otherwise(2)
    rest = [c for c in edges.columns if c not in ("analysis_id", "caller", "callee")]
    rows = edges.select("analysis_id", "caller", "callee", F.struct(weight.alias("w"), tie.alias("t"), "ord").alias("k"), F.struct(*rest).alias("v"))
    best = rows.groupBy("analysis_id", "caller", "callee").agg(F.min_by("v", "k").alias("v"), F.min("k").alias("k"))
    return best.select("analysis_id", "caller", "callee", "v.*", F.col("k.w").alias("weight"))


def investigability(reachable: Column, length: Column, path: Column, component_type: Column, is_app: Column) -> Column:
    """struct<score, reachable, path_len, component_known, caller_is_app, reflection_free, reflection_sites>: how well static
    analysis can follow a hit. Reachable 0.25; a path of up to 3 hops 0.15, 6 0.10, 10 0.05, reachable or not; a known
    component 0.20; a caller of the app 0.10; no reflection on the path, an empty one included, 0.20."""
    sites = F.filter(F.array(*map(F.lit, REFLECTION_PATTERNS)), lambda p: F.exists(F.coalesce(path, F.array().cast("array<string>")), lambda m: F.contains(m, p)))
    known, free = F.coalesce(component_type, F.lit("Unknown")) != "Unknown", F.size(sites) == 0
    near = F.when(length <= 3, 0.15).when(length <= 6, 0.10).when(length <= 10, 0.05).otherwise(0.0)
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    score = F.least(part(reachable, 0.25) + near + part(known, 0.20) + part(is_app, 0.10) + part(free, 0.20), F.lit(1.0))
    return F.struct(F.round(score, 6).alias("score"), reachable.alias("reachable"), length.alias("path_len"), known.alias("component_known"), is_app.alias("caller_is_app"), free.alias("reflection_free"), sites.alias("reflection_sites"))


def component_contexts(hits: DataFrame, components: DataFrame) -> DataFrame:
    """Component of the caller's class; of several types of one name the later in order activity, service, receiver, provider."""
    order = F.array_position(F.array(*map(F.lit, ("activity", "service", "receiver", "provider"))), F.col("component_type"))
    one = components.groupBy("analysis_id", F.col("name").alias("caller_class")).agg(F.max_by("component_type", order).alias("component_type"))
    return hits.withColumn("caller_class", S.class_of(F.col("caller"))).join(one, ["analysis_id", "caller_class"], "left")


def missing_bridges(starts: DataFrame, runs: DataFrame) -> DataFrame:
    """Call sites that start work (caller, callsite) without an edge to what they run."""
    return starts.join(runs, ["analysis_id", "caller", "callsite"], "left_anti")
