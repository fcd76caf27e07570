"""Tails of growing ledgers: a streaming source whose offsets are files and byte positions.

Spark's own file source takes a file once, when it first sees it. A ledger is one file to which lines are added for as long as a
run lasts, so this source remembers for each file up to which byte its lines were handed on. Only whole lines count: what
follows the last line feed is still being written. Positions live in the query's checkpoint, so a restart goes on at the very
byte, and a batch that has to be repeated reads the same bytes again.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .ledger import SCHEMA

#: The source runs in Python workers, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that are read at a time.
BLOCK = 1 << 20
LINES = "path string, event_id bigint, line string"


def opened(path: str):
    """File system and path of a URI or an absolute path; file:/x, as Spark writes it, is file:///x."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def ledger_files(path: str, suffix: str) -> dict[str, int]:
    """Sizes of the files of a path: of itself, or of all in the folder that end with the suffix. None if there is nothing yet."""
    from pyarrow import fs

    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return {info.path: info.size}
    if info.type == fs.FileType.NotFound:
        return {}
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return {x.path: x.size for x in found if x.type == fs.FileType.File and x.path.endswith(suffix) and not x.base_name.startswith((".", "_"))}


def line_end(store, path: str, size: int, block: int = 1 << 16) -> int:
    """Position behind the last line feed among the first `size` bytes, searched from the end."""
    with store.open_input_file(path) as f:
        hi = size
        while hi > 0:
            lo = max(0, hi - block)
            f.seek(lo)
            found = f.read(hi - lo).rfind(b"\n")
            if found >= 0:
                return lo + found + 1
            hi = lo
    return 0


@dataclass
class Span(InputPartition):
    """Lines of a file that begin at `low` or behind it and before `high`; `first` is where the batch's lines begin."""

    path: str
    first: int
    low: int
    high: int


def lines_of(store, span: Span, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(position, line without its line feed) of a span. A line that began before it belongs to the span before."""
    with store.open_input_file(span.path) as f:
        at = span.low
        skip = span.low > span.first
        if skip:  # the byte before tells whether a line begins here
            at = span.low - 1
        f.seek(at)
        rest = b""
        while at < span.high:
            piece = f.read(block)
            if not piece:
                return
            lines = (rest + piece).split(b"\n")
            rest = lines.pop()
            for line in lines:
                if skip:
                    skip = False
                elif at < span.high:
                    yield at, line
                else:
                    return
                at += len(line) + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.from_start = options.get("from", "start").lower() != "end"
        self.split_bytes = int(options.get("splitBytes", 32 << 20))
        self.wait_seconds = float(options.get("waitSeconds", 30))
        self.began = time.monotonic()
        self.seen = False

    def _ends(self) -> dict[str, int]:
        store, _ = opened(self.path)
        files = ledger_files(self.path, self.suffix)
        self.seen = self.seen or bool(files)
        return {path: line_end(store, path, size) for path, size in sorted(files.items())}

    def initialOffset(self) -> dict:
        return {} if self.from_start else self._ends()

    def latestOffset(self) -> dict:
        ends = self._ends()
        if not self.seen and time.monotonic() - self.began > self.wait_seconds:
            raise FileNotFoundError(f"no ledger at {self.path} after {self.wait_seconds:.0f} s")
        return ends

    def partitions(self, start: dict, end: dict) -> list[Span]:
        out = []
        for path, high in sorted(end.items()):
            low = start.get(path, 0)
            if high < low:
                raise ValueError(f"ledger {path} was cut from {low} to {high} bytes")
            out += [Span(path, low, at, min(high, at + self.split_bytes)) for at in range(low, high, self.split_bytes)]
        return out

    def read(self, partition: Span) -> Iterator:
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), pa.array([i for i, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], ["path", "event_id", "line"])

        store, _ = opened(self.path)
        rows, held = [], 0
        for position, line in lines_of(store, partition):
            text = line.decode("utf-8", "replace").strip()
            if text:
                rows.append((position, text))
                held += len(line)
            if held > BLOCK:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


class LedgerTail(DataSource):
    """The source `ledger_tail`. Options: path (a file or a folder), suffix (.jsonl), from (start, or end: only lines that are
    added later; a file that comes later is read whole), splitBytes, waitSeconds (for the first file; then the query fails)."""

    @classmethod
    def name(cls) -> str:
        return "ledger_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """The lines of growing files as a stream: path, event_id, line.

    event_id is the position of a line's first byte in its file, so within a file ids rise, over restarts too, and never repeat.
    Blank lines are left out, and so is a line whose line feed is not there yet. Bytes that are no UTF-8 are replaced. Files are
    expected to grow only: a shorter one ends the query. An added stretch is read in parts of splitBytes by as many tasks. The
    checkpoint holds one number for each file.
    """
    spark.dataSource.register(LedgerTail)
    reader = spark.readStream.format("ledger_tail").option("path", path)
    for name, value in options.items():
        reader = reader.option({"from_": "from"}.get(name, name), str(value))
    return reader.load()


def tail_ledger(spark: SparkSession, path: str, **options) -> DataFrame:
    """Events of growing JSON line files as a stream: path, event_id and the columns of a ledger. Malformed lines, and those without
    any known column, are left out, as in a batch."""
    broken = "_broken"
    event = F.from_json("line", f"{SCHEMA}, {broken} string", {"columnNameOfCorruptRecord": broken})
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    rows = tail_lines(spark, path, **options).select("path", "event_id", event.alias("e")).where(F.col(f"e.{broken}").isNull())
    return rows.select("path", "event_id", *(F.col(f"e.{c}").alias(c) for c in names)).where(F.coalesce(*names).isNotNull())


def append_ledgers(events: DataFrame, folder: str, name: str, order: list[str], size: int = 8 << 20) -> None:
    """Adds rows as JSON lines to the ledgers of a folder, one file for each value of the column `name`, in the given order.

    A ledger has one writer, the task that has its rows. It writes a new copy (the old bytes, then the new lines) under another
    name and moves it into place, so a task that is repeated adds nothing twice: the copy starts from the size that the
    ledger had before the job. Rows pass through in Arrow batches; a ledger is never held in memory. Columns: all of events.
    """
    import pyarrow as pa

    sizes = ledger_files(folder, ".jsonl")

    def write(batches):
        import uuid

        store, root = opened(folder)
        current, out, target, temporary = None, None, "", ""

        def close():
            if out is not None:
                out.close()
                store.move(temporary, target)

        for batch in batches:
            for ledger, line in zip(batch["ledger"].to_pylist(), batch["line"].to_pylist()):
                if ledger != current:
                    close()
                    current, target = ledger, f"{root}/{ledger}.jsonl"
                    temporary = f"{root}/.{ledger}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                    left = sizes.get(target, 0)
                    if left:
                        with store.open_input_file(target) as old:
                            while left and (piece := old.read(min(size, left))):
                                out.write(piece)
                                left -= len(piece)
                out.write(line.encode() + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["ledger"])

    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    others = [c for c in events.columns if c != name]
    rows = events.select(F.col(name).cast("string").alias("ledger"), F.to_json(F.struct(*others), {"ignoreNullFields": "true"}).alias("line"), *(F.col(c).alias(f"_by{k}") for k, c in enumerate(order)))
    rows = rows.repartition("ledger").sortWithinPartitions("ledger", *(f"_by{k}" for k in range(len(order)))).select("ledger", "line")
    rows.mapInArrow(write, "ledger string").write.format("noop").mode("overwrite").save()
