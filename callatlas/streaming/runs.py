"""Changes of the list of runs: of each snapshot of the list only what differs from the one before it."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .progress import STORE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = "snapshot bigint, bucket int, analysis_id string, run_id string, run string, expected bigint"
CHANGES = "snapshot bigint, analysis_id string, run_id string, change string, run string"


def snapshot_rows(runs: DataFrame, number: int, buckets: int = 64) -> DataFrame:
    """A snapshot of the list as rows for `run_list_changes`: one for each run, with its columns as JSON, and one for each bucket with
    the number of runs in it. Runs are dealt to buckets by hash, so the list is compared in as many parts; an empty bucket has
    its row too, or runs that went would not be missed. runs: analysis_id, run_id (together distinct), and any others."""
    bucket = F.pmod(F.xxhash64("analysis_id", "run_id"), F.lit(buckets)).cast("int")
    own = runs.select(F.lit(number).cast("bigint").alias("snapshot"), bucket.alias("bucket"), "analysis_id", "run_id", F.to_json(F.struct(*sorted(runs.columns)), {"ignoreNullFields": "false"}).alias("run"), F.lit(None).cast("bigint").alias("expected"))
    n = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    every = runs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(n, "bucket", "left")
    marks = every.select(F.lit(number).cast("bigint").alias("snapshot"), "bucket", F.lit(None).cast("string").alias("analysis_id"), F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("string").alias("run"), F.coalesce("n", F.lit(0)).alias("expected"))
    return own.unionByName(marks)


class ListChanges(StatefulProcessor):
    """Of a bucket: a digest of each run of the last whole snapshot, and the rows of snapshots that are not whole yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.digests = handle.getMapState("digests", "analysis_id string, run_id string", "digest string")
        self.waiting = handle.getMapState("waiting", "snapshot bigint, analysis_id string, run_id string", "run string")
        self.expected = handle.getMapState("expected", "snapshot bigint", "n bigint")
        self.last = handle.getValueState("last", "snapshot bigint")

    def handleInputRows(self, key, rows, timerValues):
        import hashlib

        import pandas as pd

        last = self.last.get()[0] if self.last.exists() else None
        held: dict = {}
        expected = {s: n for (s,), (n,) in self.expected.iterator()}
        for (s, a, r), (run,) in list(self.waiting.iterator()):
            held.setdefault(s, {})[a, r] = run
        was_waiting = {s: set(v) for s, v in held.items()}
        was_expected = set(expected)
        for part in rows:
            for x in part.itertuples():
                if last is not None and x.snapshot <= last:
                    continue
                if pd.notna(x.expected):
                    expected[int(x.snapshot)] = int(x.expected)
                else:
                    held.setdefault(int(x.snapshot), {})[x.analysis_id, x.run_id] = x.run
        out = []
        for s in sorted(expected):
            current = held.get(s, {})
            if len(current) < expected[s]:
                break
            before = {k: d for k, (d,) in ((tuple(k), d) for k, d in self.digests.iterator())}
            for k, run in sorted(current.items()):
                digest = hashlib.sha256(run.encode()).hexdigest()
                if before.get(k) != digest:
                    out.append((s, *k, "changed" if k in before else "added", run))
                    self.digests.updateValue(k, (digest,))
            for k in sorted(before.keys() - current.keys()):
                out.append((s, *k, "removed", None))
                self.digests.removeKey(k)
            last = s
            self.last.update((s,))
        for s in [s for s in set(held) | set(expected) if last is not None and s <= last]:
            for k in was_waiting.get(s, ()):
                self.waiting.removeKey((s, *k))
            if s in was_expected:
                self.expected.removeKey((s,))
            held.pop(s, None)
            expected.pop(s, None)
        for s, current in held.items():
            for k, run in current.items():
                if k not in was_waiting.get(s, ()):
                    self.waiting.updateValue((s, *k), (run,))
        for s in expected.keys() - was_expected:
            self.expected.updateValue((s,), (expected[s],))
        if out:
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def run_list_changes(snapshots: DataFrame) -> DataFrame:
    """Differences between each snapshot and the one before it, as a stream: snapshot, analysis_id, run_id, change (added, changed or
    removed), run (JSON; null if removed). A snapshot without differences gives nothing.

    snapshots: a stream of `snapshot_rows`. The state has a digest for each run, not the list. Snapshots are taken in order of their
    numbers; rows of one may come in several batches and are kept until the bucket has all of them; one that comes after a
    later one was taken is passed over. The first snapshot's runs are all added.
    """
    for name, value in STORE.items():
        snapshots.sparkSession.conf.set(name, value)
    keyed = snapshots.groupBy("bucket")
    return keyed.transformWithStateInPandas(ListChanges(), CHANGES, "Append", "None")
