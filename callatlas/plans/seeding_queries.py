"""Registered query of the chain of seeds: what the tables have of customers, orders and lines as three sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import seeding
from . import adapters as A
from .queries import query


@query
def seed_chain(t) -> DataFrame:
    """Customers are analyses: finished, dear lines are calls of catalog methods; orders are files that a remote, or by their
    status a local, search found. Seeds by source and category for each customer."""
    catalog = t.part.select(A.callee_of(F.col("p_type"), F.col("p_partkey")).alias("signature"), F.col("p_type").alias("category"), F.col("p_partkey").alias("ord")).where("ord % 100 < 40")
    catalog = catalog.withColumn("signature", F.replace("signature", F.lit("call("), F.concat(F.lit("m"), F.col("ord") % 4, F.when(F.col("ord") % 4 > 0, "xx").otherwise(""), F.lit("("))))
    orders = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("analysis_id"), "o_orderstatus")
    part = t.part.select("p_partkey", "p_type")
    lines = t.lineitem.where("l_linestatus = 'F' and l_quantity > 45").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    name = F.concat(F.lit("m"), F.col("l_partkey") % 4, F.when(F.col("l_partkey") % 4 > 0, "xx").otherwise(""), F.lit("("))
    calls = lines.select("analysis_id", A.caller_of(F.lit(1), F.col("l_suppkey")).alias("caller"), F.replace(A.callee_of(F.col("p_type"), F.col("l_partkey")), F.lit("call("), name).alias("callee"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("offset"))
    files = orders.select("analysis_id", F.concat(F.lit("m"), F.col("o_orderkey") % 4, F.when(F.col("o_orderkey") % 4 > 0, "xx").otherwise("")).alias("method_name"), F.concat("o_orderkey", F.lit(".java")).alias("file_path"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    found = seeding.seeds(calls, files.where("o_orderstatus = 'O'").drop("o_orderstatus"), files.where("o_orderstatus <> 'O'").drop("o_orderstatus"), catalog)
    return found.groupBy("analysis_id", "source", "category", "confidence").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("caller_method").alias("callers"))
