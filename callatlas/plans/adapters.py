"""The driver's tables, reshaped into the tables of program graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Our own small catalog: part type, category, priority, weight.
CATEGORIES = (("PROMO", "CAT_PROMO", "CRITICAL", 0.9), ("ECONOMY", "CAT_ECONOMY", "HIGH", 0.6), ("STANDARD", "CAT_STANDARD", "MEDIUM", 0.4), ("LARGE", "CAT_LARGE", "LOW", 0.2))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def caller_of(nation: Column, supplier: Column) -> Column:
    return F.concat(F.lit("<tpch.n"), nation, F.lit(".S"), supplier, F.lit(": void run()>"))


def callee_of(kind: Column, part: Column) -> Column:
    return F.concat(F.lit("<tpch."), F.lower(kind), F.lit(".P"), part % 100, F.lit(": void call(int)>"))


def edges(t: Tables) -> DataFrame:
    """Suppliers call parts, once for each line item."""
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity").join(s, "l_suppkey").join(p, "l_partkey")
    return rows.select(
        F.lit("tpch").alias("analysis_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), caller_of(F.col("s_nationkey"), F.col("l_suppkey")).alias("caller"), callee_of(F.col("p_type"), F.col("l_partkey")).alias("callee"),
        F.when(F.col("l_returnflag") == "A", "soot_cg").when(F.col("l_returnflag") == "N", "jimple_invoke").otherwise("threading_synthetic").alias("edge_source"),
        F.when(F.col("l_linestatus") == "F", "high").otherwise("medium").alias("confidence"), "l_suppkey", "s_nationkey")


def catalog(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(k, c, p, w) for k, c, p, w in CATEGORIES], "kind string, category_id string, priority string, weight double")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(99))))
    return rows.select("category_id", "priority", "weight", callee_of(F.col("kind"), F.col("part")).alias("signature"))


def reasoned(e: DataFrame) -> DataFrame:
    """Edges with the reason that drops them: every tenth supplier is framework, every seventh nation a library, nations
    above 20 not the app's."""
    from ..operators.hits import filter_reason

    return e.withColumn("reason", filter_reason(F.col("l_suppkey") % 10 == 0, F.col("s_nationkey") % 7 == 0, F.col("s_nationkey") <= 20))


def hits(t: Tables) -> DataFrame:
    from ..operators.hits import exact_matches, first_hits

    found = first_hits(exact_matches(reasoned(edges(t)).where("reason = 'kept'"), catalog(t)))
    return found.withColumn("investigability", F.lit(0.05) * (F.col("l_suppkey") % 11))


def category_sets(t: Tables) -> DataFrame:
    """Event types of a user on a day."""
    return t.events.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("categories"))


def purchase_graph(t: Tables) -> DataFrame:
    """Customer to order's part to supplier to nation, as weighted edges, one for each pair; of all orders."""
    end = lambda letter, key: F.concat(F.lit(letter), key)
    c2p = F.struct(end("c", F.col("o_custkey")).alias("caller"), end("p", F.col("l_partkey")).alias("callee"), F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("weight"))
    p2s = F.struct(end("p", F.col("l_partkey")).alias("caller"), end("s", F.col("l_suppkey")).alias("callee"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("weight"))
    # both edges of a line from one join
    lines = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.inline(F.array(c2p, p2s)))
    s2n = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("caller"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("callee"), F.lit(1).alias("weight"), F.col("s_suppkey").alias("ord"))
    rows = lines.unionByName(s2n)
    return rows.groupBy("caller", "callee").agg(F.min("weight").cast("bigint").alias("weight"), F.min("ord").alias("ord")).select(F.lit("tpch").alias("analysis_id"), "*")


def ledger(t: Tables) -> DataFrame:
    """Events as a run ledger: a user is a run, the event type a stage, odd events ends."""
    return t.events.select("user_id", F.col("event_type").alias("stage"), "event_type", F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("kind"), "ts", F.col("event_id").alias("ord"), "value")
