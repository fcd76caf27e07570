"""Registered queries over hand-offs: orders as documents, their lines as claims, customers as seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import handoffs as H
from .durable import checkpointed
from .queries import query


def _text(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}": "'), value, F.lit('"'))


def _claim(kind: Column, words: Column, sources: Column, tail: Column) -> Column:
    head = F.concat_ws(", ", _text("claim_id", F.lit("c001")), _text("claim_type", kind), F.lit('"tier1_field": "observable_effects", "unit_id": "u", "resolved_by": "cfg"'), _text("interpretation", words), F.concat(F.lit('"source_unit_ids": '), sources))
    return F.concat(F.lit("{"), head, tail, F.lit("}"))


@query
def hand_off_schemas(t) -> DataFrame:
    """A third of the orders are claims, a third structures, a third behaviours with a claim for each line."""
    key, some = F.col("o_orderkey"), F.lit('["u"]')
    share = lambda tenths: F.concat(F.floor(tenths / 10), F.lit("."), tenths % 10)
    # behaviours alone hold lines: those of other orders are in no document
    lines = t.lineitem.where("l_orderkey % 3 not in (0, 1)").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") != "A").alias("sourced")))).alias("x"))
    # texts are made from the lines behind the shuffle
    line = lambda x: _claim(F.lit("effect"), F.concat(F.lit("part "), x["l_partkey"]), F.when(~x["sourced"], "[]").otherwise(some), F.concat(F.lit(', "confidence": '), share(x["l_linenumber"] * 3)))
    own = _claim(F.when(F.col("o_orderstatus") == "F", "effect").otherwise(F.col("o_orderstatus")), F.lit("reads the device"), some, F.when(key % 5 == 0, "").otherwise(', "confidence": 1'))
    seed = F.when(key % 4 == 1, key.cast("string")).otherwise(F.concat(F.lit('"'), key, F.lit('"')))
    structure = F.when(key % 7 == 0, "broken {").otherwise(F.concat(F.lit('{"seed_id": '), seed, F.lit(', "api_calls": [{}], "extraction_coverage": "partial", "extraction_confidence": 0.5}')))
    behaviour = F.concat(F.lit('{"seed_id": "s", "claims": ['), F.coalesce(F.array_join(F.transform("x", line), ", "), F.lit("")), F.lit("]}"))
    kind = F.when(key % 3 == 0, "claim").when(key % 3 == 1, "structure").otherwise("behaviour")
    rows = t.orders.join(lines, "o_orderkey", "left").select("o_orderkey", kind.alias("kind"), F.when(key % 3 == 0, own).when(key % 3 == 1, structure).otherwise(behaviour).alias("body"))
    return H.validated(rows, F.col("kind")).select("o_orderkey", "kind", "ok", F.array_join("errors", "; ").alias("errors"))


def _calls(t) -> tuple[DataFrame, ...]:
    """Lines as calls of their customer (lines of one number in an order are one unit); what is returned or unfinished is claimed,
    open or looked up."""
    seeds = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), "o_custkey").alias("seed_id"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity").join(seeds, "l_orderkey")
    rows = checkpointed(rows).withColumn("unit_id", F.concat("l_orderkey", F.lit("-"), "l_linenumber"))
    claims = rows.where("l_returnflag <> 'R' or l_linenumber > 2").withColumn("claim_type", F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") >= 6), "input").otherwise("effect"))
    open_ = rows.where("l_linestatus = 'O' and l_quantity > 25")
    unit = ["seed_id", "unit_id"]
    return rows.select(*unit), claims.select(*unit, "claim_type"), open_.select(*unit), rows.where("l_quantity > 30").select(*unit), open_.where("l_quantity > 40").select(*unit)


@query
def claim_coverage(t) -> DataFrame:
    found = H.claim_coverage(*_calls(t))
    return found.withColumns({"coverage": F.round("coverage", 9), "unresolved_ratio": F.round("unresolved_ratio", 9)})


@query
def unclaimed_calls(t) -> DataFrame:
    calls, claims, *_ = _calls(t)
    return H.unclaimed(calls, claims)
