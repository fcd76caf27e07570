"""Progress of methods as their analyses come in: keyed state, timers and an upsert sink.

A method is `pending` from the moment that a path uses it, and `complete` or `no_jadx` once its analysis is there. The artifact
that shows this is written while the work goes on, so it is a table of latest rows that every batch brings up to date.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Classes whose methods are the platform's and are not analysed.
PLATFORM = ("<android.", "<java.", "<javax.", "<dalvik.")

KEY = ["analysis_id", "method"]
STATE = "used bigint, analysed boolean, jadx_available boolean, function_summary string, confidence double"
ROW = "analysis_id string, method string, usage_count bigint, jadx_available boolean, analysis_status string, function_summary string, confidence double"
PARTIAL = f"analysis_id string, method string, at timestamp, {STATE}"
#: State is kept in RocksDB, which timers need and which holds more keys than an executor's heap.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def events_of(uses: DataFrame, analyses: DataFrame) -> DataFrame:
    """One stream of both kinds of events. uses: analysis_id, method, at, one row for each place of a method on a path; analyses:
    analysis_id, method, at, jadx_available, function_summary, confidence. Uses of the platform's methods are left out."""
    own = ~F.coalesce(*(F.when(F.startswith("method", F.lit(p)), F.lit(True)) for p in PLATFORM), F.lit(False))
    used = uses.where(own).select(*KEY, "at", F.lit(1).cast("bigint").alias("used"), F.lit(False).alias("analysed"), F.lit(None).cast("boolean").alias("jadx_available"), F.lit(None).cast("string").alias("function_summary"), F.lit(0.0).alias("confidence"))
    done = analyses.select(*KEY, "at", F.lit(0).cast("bigint").alias("used"), F.lit(True).alias("analysed"), F.coalesce("jadx_available", F.lit(False)).alias("jadx_available"), "function_summary", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return used.unionByName(done)


def _combined(batches: Iterator) -> Iterator:
    """Uses of a method within an Arrow batch as one row, so that a busy method does not travel row by row."""
    import pandas as pd

    for rows in batches:
        used = rows[~rows["analysed"]].groupby(KEY, dropna=False, as_index=False).agg(used=("used", "sum"), at=("at", "max"))
        out = pd.concat([used.assign(analysed=False, jadx_available=None, function_summary=None, confidence=0.0), rows[rows["analysed"]]])
        yield out[["analysis_id", "method", "at", "used", "analysed", "jadx_available", "function_summary", "confidence"]]


class MethodProgress(StatefulProcessor):
    """Counts a method's uses, keeps its latest analysis and gives its row when either changes. A method that is analysed is
    forgotten `keep_ms` of event time after its last event; one that is pending is kept until its analysis comes."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", STATE)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        used, analysed, jadx, summary, confidence = self.state.get() if self.state.exists() else (0, False, None, None, 0.0)
        before = (used, analysed, jadx, summary, confidence)
        last, newest = 0, None
        for part in rows:
            used += int(part["used"].sum())
            last = max(last, int(part["at"].max().timestamp() * 1000)) if part["at"].notna().any() else last
            done = part[part["analysed"]]
            for x in done.itertuples():
                order = (x.at.timestamp() if pd.notna(x.at) else float("-inf"), x.function_summary or "", bool(x.jadx_available), x.confidence)
                if newest is None or order > newest:
                    newest = order
                    analysed, jadx, summary, confidence = True, bool(x.jadx_available), x.function_summary, float(x.confidence)
        self.state.update((used, analysed, jadx, summary, confidence))
        if analysed:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.keep_ms)
        if (used, analysed, jadx, summary, confidence) != before and used:
            status = "pending" if not analysed else "complete" if jadx else "no_jadx"
            yield pd.DataFrame([[*key, used, bool(jadx), status, summary if jadx else None, confidence]], columns=[c.split(" ")[0] for c in ROW.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def method_progress(events: DataFrame, keep_seconds: int = 86_400, late: str = "1 hour") -> DataFrame:
    """Rows of methods that a stream of events changes: analysis_id, method, usage_count, jadx_available, analysis_status,
    function_summary, confidence.

    A row is pending without an analysis, complete with one from source, no_jadx with one without; a summary is given for the
    second only. An analysis of a method that no path uses waits for its first use. Of several analyses of one batch the latest
    counts, and a later batch's replaces it; null keys are keys like any other.
    """
    for name, value in STORE.items():
        events.sparkSession.conf.set(name, value)
    rows = events.select(*KEY, "at", "used", "analysed", "jadx_available", "function_summary", "confidence").mapInPandas(_combined, PARTIAL)
    keyed = rows.withWatermark("at", late).groupBy(*KEY)
    return keyed.transformWithStateInPandas(MethodProgress(keep_seconds * 1000), ROW, "Update", "EventTime")


def upsert(folder: str):
    """A sink for foreachBatch: rows of a batch as the folder batch=<number>, overwritten when the batch is repeated, so a repeated
    batch changes nothing. A row's key appears once in a batch."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def latest(spark: SparkSession, folder: str, schema: str = ROW, key: list[str] = KEY) -> DataFrame:
    """The artifact: of each key the row of the last batch that has it."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(folder)
    values = [c for c in rows.columns if c not in (*key, "batch")]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("row"))
    return newest.select(*key, *(F.col("row")[c].alias(c) for c in values))


def compacted(spark: SparkSession, folder: str, schema: str = ROW, key: list[str] = KEY) -> str:
    """A new folder with the artifact as its first batch, which may go on from there: later batches have greater numbers."""
    target = f"{folder}-{uuid.uuid4().hex}"
    latest(spark, folder, schema, key).write.parquet(f"{target}/batch=-1")
    return target


def run_batches(stream: DataFrame, sink, checkpoint: str, mode: str = "update") -> None:
    """Takes a stream through what is there now, batch by batch, into the sink; the checkpoint tells where the last call ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()


def totals(artifact: DataFrame) -> DataFrame:
    """analysis_id, total_unique, analyzed_count (complete), with_jadx."""
    count = lambda c: F.count(F.when(c, 1))
    return artifact.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("total_unique"), count(F.col("analysis_status") == "complete").alias("analyzed_count"), count(F.col("jadx_available")).alias("with_jadx"))
