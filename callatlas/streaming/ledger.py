"""Run-event ledgers, in batch and as streams. The same functions serve both where the aggregation allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts string, event_type string, analysis_id string, run_id string, stage string, status string, error string, ref string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; blank and malformed lines are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).where(F.coalesce(*[F.col(c.split(" ")[0]) for c in SCHEMA.split(", ")]).isNotNull())


def stream_ledger(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """The same of a growing folder of JSON line files."""
    return spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_each).json(path).where(F.coalesce("event_type", "run_id", "ts").isNotNull())


def parsed(ts: Column) -> Column:
    return F.try_to_timestamp(ts)


def stage_durations(events: DataFrame, key: list[str]) -> DataFrame:
    """First start, last end and seconds of each stage. events: key columns, stage, kind (start or end), ts."""
    start = F.min(F.when(F.col("kind") == "start", F.col("ts"))).alias("started")
    end = F.max(F.when(F.col("kind") == "end", F.col("ts"))).alias("ended")
    out = events.groupBy(*key, "stage").agg(start, end)
    return out.withColumn("seconds", (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6)


def run_summary(events: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """First event, last event and number of events of each run."""
    return events.groupBy(*key).agg(F.min_by("event_type", order).alias("first_event"), F.max_by("event_type", order).alias("last_event"), F.count(F.lit(1)).alias("n_events"))


def event_level(event_type: Column, status: Column, error: Column) -> Column:
    return F.when(error.isNotNull() | status.isin("error", "failed"), "error").when(event_type.contains("warn") | (status == "warning"), "warning").otherwise("info")


def timeline(events: DataFrame) -> DataFrame:
    """Events with `at`, by which, and then by `ord`, they are in order: the time, or the input order where the time can't be read.
    The caller sorts, as far as it needs an order."""
    return events.withColumn("at", F.coalesce(F.unix_micros(F.col("ts").try_cast("timestamp")), F.col("ord")))


def stage_state(events: DataFrame) -> DataFrame:
    """Starts and ends of stages, of a stream as its running state: one row for each stage of a run. Events may come in any order
    and none is too late, so the state has all stages ever seen; no bound would be safe for runs of any length."""
    seen = events.withColumn("at", F.try_to_timestamp("ts"))
    return seen.groupBy("analysis_id", "run_id", "stage").agg(F.min(F.when(F.col("event_type") == "stage.start", F.col("at"))).alias("started"), F.max(F.when(F.col("event_type") == "stage.end", F.col("at"))).alias("ended"), F.count(F.lit(1)).alias("n_events"))


def run_available(stream: DataFrame, folder: str, checkpoint: str, schema: str, key: list[str]) -> DataFrame:
    """Everything that is there now, through the stream: the latest row of each key. Batches write what they changed to the folder,
    so nothing passes through the driver."""
    from .progress import latest, run_batches, upsert

    run_batches(stream, upsert(folder), checkpoint)
    return latest(stream.sparkSession, folder, schema, key)
