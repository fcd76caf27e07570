"""Control-flow path documents: how a sensitive call is reached, edge by edge, and what guards it.

paths: analysis_id, method, dist, path (methods from an entrypoint to the method, the first ones where it was cut), as
`plans.graph.paths` gives them. edges: one for each analysis_id, caller, callee, with callsite, edge_source, edge_layer, pattern,
confidence, weight, as `hits.best_edges` gives them; a column that is not there counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import checkpointed

#: Most methods of a path, the sensitive one included.
MOST = 20
_ATTRIBUTES = {"callsite": "string", "edge_source": "string", "edge_layer": "string", "pattern": "string", "confidence": "string", "weight": "bigint"}
_EDGE = "struct<caller:string,callee:string," + ",".join(f"{n}:{k}" for n, k in _ATTRIBUTES.items()) + ">"
_NONE = f"cast(array() as array<{_EDGE}>)"


def _described(edges: DataFrame) -> DataFrame:
    """analysis_id, caller, callee, edge: its ends and attributes."""
    attributes = [(F.col(n) if n in edges.columns else F.lit(None)).cast(k).alias(n) for n, k in _ATTRIBUTES.items()]
    return edges.select("analysis_id", "caller", "callee", F.struct("caller", "callee", *attributes).alias("edge"))


def edges_along(rows: DataFrame, edges: DataFrame, key: list[str], path: str = "path", keep_unknown: bool = False) -> DataFrame:
    """key, edges: those between neighbours of a path (an array of at most MOST methods), in its order. A pair that is no edge is
    left out, or kept with its ends alone."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda k: F.struct(k.alias("place"), F.element_at(path, k).alias("caller"), F.element_at(path, k + 1).alias("callee")))
    steps = rows.where(F.size(path) > 1).select("analysis_id", *key, F.inline(pairs))
    met = steps.join(_described(edges), ["analysis_id", "caller", "callee"], "left" if keep_unknown else "inner")
    bare = F.struct("caller", "callee", *(F.lit(None).cast(k).alias(n) for n, k in _ATTRIBUTES.items()))
    one = F.struct("place", F.coalesce("edge", bare).alias("edge"))
    return met.groupBy("analysis_id", *key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["edge"]).alias("edges"))


def edges_needed(sinks: DataFrame, paths: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """The edges that documents of these sinks can name: between neighbours on the paths to their callers, and between a sink's own
    ends. They are found in one pass, so that the steps after it meet as many edges as documents have, not the whole graph."""
    ends = ["analysis_id", "caller", "callee"]
    callers = sinks.select("analysis_id", F.col("caller").alias("method")).distinct()
    way = paths.join(callers, ["analysis_id", "method"], "left_semi").select("analysis_id", F.slice("path", 1, most).alias("path"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.struct(F.element_at("path", k).alias("caller"), F.element_at("path", k + 1).alias("callee")))
    named = way.where(F.size("path") > 1).select("analysis_id", F.inline(pairs)).union(sinks.select(*ends)).distinct()
    return checkpointed(edges.join(checkpointed(named), ends, "left_semi"))


def reachability(sinks: DataFrame, paths: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """sinks (analysis_id, sink_id, caller, callee, and others) plus reachable, path_len, path_cost, example_path, example_edges.

    The path to the caller is followed by the sensitive method, unless it ends with it, and its edges by the edge between the two,
    where there is one, whose weight is added; path and edges are then cut to `most` methods. Edges along a path are found
    once for each caller, however many sinks it has. A caller without a path is not reachable: nulls and empty arrays.
    """
    callers = sinks.select("analysis_id", F.col("caller").alias("method")).distinct()
    led = paths.join(callers, ["analysis_id", "method"], "left_semi").select("analysis_id", "method", "dist", F.slice("path", 1, most).alias("path"))
    led = led.join(edges_along(led, edges, ["method"]), ["analysis_id", "method"], "left").withColumnsRenamed({"method": "caller", "edges": "_edges"})
    last = _described(edges).withColumnRenamed("edge", "_last")
    rows = sinks.join(led, ["analysis_id", "caller"], "left").join(last, ["analysis_id", "caller", "callee"], "left")
    here, found = F.col("dist").isNotNull(), F.coalesce("_edges", F.expr(_NONE))
    added = here & (F.element_at("path", -1) != F.col("callee"))
    with_sink = added & F.col("_last").isNotNull()
    path = F.when(added, F.concat("path", F.array("callee"))).otherwise(F.coalesce("path", F.expr("cast(array() as array<string>)")))
    every = F.when(with_sink, F.concat(found, F.array("_last"))).otherwise(found)
    kept = F.slice(path, 1, most)
    cost = F.col("dist") + F.when(with_sink, F.coalesce("_last.weight", F.lit(0))).otherwise(0)
    return rows.select(*sinks.columns, here.alias("reachable"), F.when(here, F.size(kept) - 1).alias("path_len"), F.when(here, cost).alias("path_cost"), F.when(here, kept).otherwise(F.expr("cast(array() as array<string>)")).alias("example_path"),
                       F.when(F.size(path) > most, F.slice(every, F.lit(1), F.size(kept) - 1)).otherwise(every).alias("example_edges"))


def is_branch(stmt: Column) -> Column:
    """Whether a statement guards others: an if, a switch, a jump or a comparison."""
    text = F.trim(stmt)
    out = F.startswith(text, F.lit("if ")) | F.startswith(text, F.lit("switch "))
    for sign in (" goto ", " == ", " != ", " < ", " > "):
        out = out | F.contains(text, F.lit(sign))
    return out


def path_documents(reached: DataFrame, edges: DataFrame, slices: DataFrame, most_branches: int | None = None) -> DataFrame:
    """One document for each sink of `reachability`: its columns, path_methods, edges, branch_conditions, status.

    A reachable sink has its example path and edges (status full); another has its caller and the sensitive method, with what is
    known of the edge between them (partial), and so has a path whose edges are all unknown. branch_conditions:
    array<struct<idx, unit_id, stmt>> of the guards in the sink's slice. slices: analysis_id, sink_id, idx, unit_id, stmt. A document is one
    value, so guards are what has to fit; `most_branches` keeps the first ones by place, chosen before they are collected.
    """
    key = ["analysis_id", "sink_id"]
    ends = F.when(F.col("caller") == F.col("callee"), F.array("caller")).otherwise(F.array("caller", "callee"))
    full = F.size("example_path") > 0
    rows = reached.withColumn("path_methods", F.when(full, F.col("example_path")).otherwise(ends))
    plain = edges_along(rows.where(F.size("example_edges") == 0), edges.select("analysis_id", "caller", "callee", *(["callsite"] if "callsite" in edges.columns else [])), ["sink_id"], "path_methods", True)
    guards = slices.where(is_branch(F.col("stmt"))).select(*key, F.col("idx").cast("bigint").alias("idx"), "unit_id", "stmt")
    if most_branches is not None:
        guards = guards.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("idx"))).where(F.col("_n") <= most_branches).drop("_n")
    guards = guards.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("idx", "unit_id", "stmt"))).alias("branch_conditions"))
    out = rows.join(plain.withColumnRenamed("edges", "_plain"), key, "left").join(guards, key, "left")
    none = F.expr("cast(array() as array<struct<idx:bigint,unit_id:string,stmt:string>>)")
    return out.select(*reached.columns, "path_methods", F.when(F.size("example_edges") > 0, F.col("example_edges")).otherwise(F.coalesce("_plain", F.expr(_NONE))).alias("edges"), F.coalesce("branch_conditions", none).alias("branch_conditions"), F.when(full, "full").otherwise("partial").alias("status"))
