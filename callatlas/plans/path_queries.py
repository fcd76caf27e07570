"""Registered queries over paths in the graph of purchases: customers are entrypoints, parts, suppliers and nations follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pathdocs as P
from . import adapters as A
from . import graph
from .durable import checkpointed
from .queries import _roots, query


def _sinks(t) -> DataFrame:
    """A supplier is a caller; two of three call their nation, which is an edge, the others an interface that is none. Every tenth
    has a twin that nothing reaches, whose edge to the nation is known to it alone."""
    s, nation = F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")
    own = t.supplier.select(s.alias("sink_id"), s.alias("caller"), F.when(F.col("s_suppkey") % 3 > 0, nation).otherwise(F.concat(F.lit("api"), "s_suppkey")).alias("callee"))
    twin = F.concat(F.lit("z"), "s_suppkey")
    other = t.supplier.where("s_suppkey % 10 = 0").select(twin.alias("sink_id"), twin.alias("caller"), nation.alias("callee"))
    return own.unionByName(other).withColumn("analysis_id", F.lit("tpch"))


@query
def control_flow_paths(t) -> DataFrame:
    """Path documents of all sinks: methods, edges with their attributes, guards of the slice (a supplier's lines)."""
    links = A.purchase_graph(t)
    twins = t.supplier.where("s_suppkey % 20 = 0").select(F.lit("tpch").alias("analysis_id"), F.concat(F.lit("z"), "s_suppkey").alias("caller"), F.concat(F.lit("n"), "s_nationkey").alias("callee"), F.lit(7).cast("bigint").alias("weight"), F.col("s_suppkey").alias("ord"))
    links = checkpointed(links.unionByName(twins))
    source = F.when(F.startswith("caller", F.lit("c")), "soot_cg").when(F.startswith("caller", F.lit("p")), "jimple_invoke").otherwise("threading_synthetic")
    edges = links.withColumn("edge_source", source).withColumn("callsite", F.concat(F.lit("at "), "caller", F.lit(" "), "callee")).withColumn("pattern", F.when(F.startswith("caller", F.lit("s")), "thread_start"))
    paths = checkpointed(graph.paths(graph.weighted_distances(links, _roots(t))))
    line = F.concat("l_orderkey", F.lit("-"), "l_linenumber")
    stmt = F.when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("if $i == "), "l_quantity", F.lit(" goto 3"))).when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit(" switch "), "l_partkey")).otherwise(F.concat(F.lit("$i = "), "l_partkey"))
    slices = t.lineitem.select(F.lit("tpch").alias("analysis_id"), F.concat(F.lit("s"), "l_suppkey").alias("sink_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), line.alias("unit_id"), stmt.alias("stmt"))
    edges = P.edges_needed(_sinks(t), paths, edges)
    docs = P.path_documents(P.reachability(_sinks(t), paths, edges), edges, slices)
    of_edge = lambda e: F.concat_ws("/", e["callsite"], e["edge_source"], e["pattern"], e["weight"].cast("string"))
    guards = F.col("branch_conditions")
    return docs.select("sink_id", "status", "reachable", F.col("path_len").cast("bigint").alias("path_len"), "path_cost", F.array_join("path_methods", ">").alias("path"), F.array_join(F.transform("edges", of_edge), "|").alias("edges"),
                       F.size(guards).cast("bigint").alias("n_guards"), F.get(guards, F.lit(0))["stmt"].alias("first_guard"), F.try_element_at(guards, F.lit(-1))["unit_id"].alias("last_guard"))
