"""Registered queries that run as streams over what Spark derives from the driver's tables.

Each writes its input to the shared folder in stages and goes through the stream after each stage, with one checkpoint, so that
what is in the result has passed a restart. The results are those of a batch over the whole table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming import ledger as L
from ..streaming import progress as P
from ..streaming import runs as R
from ..streaming import tail as T
from . import adapters as A
from .durable import shared_folder
from .queries import query

STAGES = "analysis_id string, run_id string, stage string, started timestamp, ended timestamp, n_events bigint"
STAGE = ["analysis_id", "run_id", "stage"]


def _place(t) -> str:
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def _ledger(t) -> DataFrame:
    """Events as the lines of eight analyses' ledgers: a user is a run, the type of an event its stage."""
    kind = F.when(F.col("event_id") % 2 == 0, "stage.start").otherwise("stage.end")
    return t.events.select(F.pmod("user_id", F.lit(8)).cast("string").alias("analysis_id"), F.col("ts").cast("string").alias("ts"), kind.alias("event_type"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("stage"), F.col("event_id").cast("string").alias("ref"))


def _seconds(found: DataFrame) -> DataFrame:
    return found.select(*STAGE, F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n_events")


@query
def ledger_tail(t) -> DataFrame:
    """Eight ledgers that grow: events up to the middle of their ids are written and taken through, then the others are added to
    the same files, and the stream goes on from its checkpoint. State of each stage of each run."""
    at = _place(t)
    middle = t.events.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("m"))
    halves = _ledger(t).withColumn("file", F.concat(F.lit("ledger-"), "analysis_id")).withColumn("id", F.col("ref").cast("bigint"))
    for half in (halves.join(middle, F.col("id") <= F.col("m")), halves.join(middle, F.col("id") > F.col("m"))):
        T.append_ledgers(half.drop("m"), f"{at}/ledgers", "file", ["id"])
        state = L.stage_state(T.tail_ledger(t.spark, f"{at}/ledgers"))
        P.run_batches(state, P.upsert(f"{at}/out"), f"{at}/state")
    return _seconds(P.latest(t.spark, f"{at}/out", STAGES, STAGE))


@query
def ledger_stream_available_now(t) -> DataFrame:
    """The events as files of JSON lines, through the ledger stream to its end: state of each stage of each run."""
    at = _place(t)
    _ledger(t).write.json(f"{at}/ledgers")
    return _seconds(L.run_available(L.stage_state(L.stream_ledger(t.spark, f"{at}/ledgers")), f"{at}/out", f"{at}/state", STAGES, STAGE))


def _used(t) -> DataFrame:
    """Line items as places of methods on paths: an order is a path, its parts the methods. A tenth of them are the platform's."""
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type")
    part = F.col("l_partkey") % 100
    method = F.when(part % 10 == 3, F.concat(F.lit("<java.util.P"), part, F.lit(": void call(int)>"))).otherwise(A.callee_of(F.col("p_type"), F.col("l_partkey")))
    return t.lineitem.select("l_partkey", "l_linenumber").join(p, "l_partkey").select((F.col("l_partkey") % 2).cast("string").alias("analysis_id"), method.alias("method"), part.alias("part"), "l_linenumber")


@query
def progressive_methods(t) -> DataFrame:
    """Methods while they are analysed, in three batches: the first lines of the orders use them; the other lines do, and parts
    1 and 2 of four have an analysis; part 3 has one without source, and part 2's comes again."""
    at, spark = _place(t), t.spark
    used = _used(t)
    used.write.parquet(f"{at}/used")
    used = spark.read.schema(used.schema).parquet(f"{at}/used")
    methods = used.select("analysis_id", "method", "part").distinct()
    when = lambda k: F.lit(f"2024-01-01 00:0{k}:00").cast("timestamp").alias("at")
    kind = F.col("part") % 4

    def analyses(number: int, which: Column, jadx: Column) -> DataFrame:
        return methods.where(which).select("analysis_id", "method", when(number), jadx.alias("jadx_available"), F.concat(F.lit("part "), "part").alias("function_summary"), (F.col("part") / 100).alias("confidence"))

    first = used.where("l_linenumber <= 3").select("analysis_id", "method", when(0))
    second = used.where("l_linenumber > 3").select("analysis_id", "method", when(1))
    two, three = analyses(1, kind.isin(1, 2), kind == 1), analyses(2, kind.isin(2, 3), kind == 2)
    for uses, found in ((first, two.limit(0)), (second, two), (second.limit(0), three)):
        uses.write.mode("append").parquet(f"{at}/uses")
        found.write.mode("append").parquet(f"{at}/analyses")
        events = P.events_of(spark.readStream.schema(uses.schema).parquet(f"{at}/uses"), spark.readStream.schema(found.schema).parquet(f"{at}/analyses"))
        P.run_batches(P.method_progress(events), P.upsert(f"{at}/out"), f"{at}/state")
    return P.latest(spark, f"{at}/out").withColumn("confidence", F.round("confidence", 6))


@query
def run_list_changes(t) -> DataFrame:
    """Changes of the list of runs over five snapshots: the users with an event up to one, two, three, four quarters of the ids, and
    the last once more; a seventh of them is taken from the third. The first two go through in one batch."""
    at, spark = _place(t), t.spark
    last = t.events.agg(F.max("event_id").alias("most"))
    for batch in ((1, 2), (3,), (4,), (5,)):
        for number in batch:
            seen = t.events.join(last, F.col("event_id") * 4 <= F.col("most") * min(number, 4))
            runs = seen.groupBy(F.pmod("user_id", F.lit(5)).cast("string").alias("analysis_id"), F.col("user_id").cast("string").alias("run_id")).agg(F.max_by("event_type", "event_id").alias("end_status"), F.count(F.lit(1)).alias("event_count"))
            runs = runs.where(F.col("run_id").cast("bigint") % 7 != 0) if number == 3 else runs
            R.snapshot_rows(runs, number, 8).write.mode("append").parquet(f"{at}/snapshots")
        changes = R.run_list_changes(spark.readStream.schema(R.ROWS).parquet(f"{at}/snapshots"))
        P.run_batches(changes, P.upsert(f"{at}/out"), f"{at}/state", "append")
    found = spark.read.schema(R.CHANGES).parquet(f"{at}/out")
    return found.select("snapshot", "run_id", "change", F.get_json_object("run", "$.end_status").alias("end_status"), F.get_json_object("run", "$.event_count").cast("bigint").alias("event_count"))
