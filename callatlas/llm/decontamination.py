"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark, one scan of each text.

Every window of w words of an item holds a whole block of (w + 1) // 2 words that begins at a multiple of that length, so the
automaton needs the items' aligned blocks only, as sequences of word numbers: about one node for each word of the benchmark. Where
a block occurs, the words around it tell which windows do.
"""

from __future__ import annotations

from array import array
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, kept, small_batches, text_bytes

#: ASCII characters that are no digit and no letter become spaces; all bytes from 0x80 on belong to words.
WORDS_ONLY = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A block in more places than this is looked up by the windows around it instead of place by place.
MANY = 8

RUN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = "doc_id bigint, text_key bigint, n_words bigint, item_ids array<string>, runs array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"


def normalise(text: bytes) -> list[bytes]:
    """Words of a text: A-Z in lower case, split at every other ASCII character."""
    return text.lower().translate(WORDS_ONLY).split()


class Index:
    """The automaton of a slice of the benchmark. items: (ids, text), each text once."""

    def __init__(self, items: list[tuple[list[str], bytes]], window: int):
        self.window, self.block = window, (window + 1) // 2
        self.number: dict[bytes, int] = {}  # words from 1; 0 is any other word
        self.words, self.first, self.ids = array("I"), array("Q"), []
        patterns: dict[tuple, list[int]] = {}
        for ids, text in items:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in normalise(text)]
            if not own:
                continue
            at = len(self.words)
            self.first.append(at)
            self.ids.append(tuple(sorted(ids)))
            self.words.extend(own)
            if len(own) < window:
                patterns.setdefault(tuple(own), []).append(-len(self.ids))
            else:
                for k in range(0, len(own) - self.block + 1, self.block):
                    patterns.setdefault(tuple(own[k : k + self.block]), []).append(at + k)
        self.first.append(len(self.words))
        self.automaton = None
        if patterns:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, places in patterns.items():
                self.automaton.add_word(key, (len(key), self._around(places) if len(places) > MANY else places))
            self.automaton.make_automaton()

    def _item(self, place: int) -> int:
        return int(np.searchsorted(np.frombuffer(self.first, np.uint64), place, "right")) - 1

    def _around(self, places: list[int]) -> dict:
        """(words before, the words of the window outside the block): items, of all windows around the places of one block."""
        out: dict = {}
        rest = self.window - self.block
        for p in places:
            if p < 0:
                out.setdefault(None, set()).add(-p - 1)
                continue
            item = self._item(p)
            low, high = self.first[item], self.first[item + 1]
            for before in range(rest + 1):
                a, b = p - before, p - before + self.window
                if a >= low and b <= high:
                    out.setdefault((before, *self.words[a:p], *self.words[p + self.block : b]), set()).add(item)
        return {k: tuple(v) for k, v in out.items()}

    def scan(self, text: bytes) -> tuple[int, list[int], set[str]]:
        """Number of words, sorted indices of the hit words, ids of the items with an occurring window."""
        words = normalise(text)
        if not words or self.automaton is None:
            return len(words), [], set()
        seen = tuple(map(self.number.get, words, repeat(0)))
        items: set[int] = set()
        marks = None
        for last, (size, places) in self.automaton.iter(seen):
            for a, b, found in self._windows(seen, last - size + 1, size, places):
                if marks is None:
                    marks = np.zeros(len(words) + 1, np.int64)
                marks[a] += 1
                marks[b] -= 1
                items.update(found)
        ids = {i for k in items for i in self.ids[k]}
        return len(words), [] if marks is None else np.flatnonzero(np.cumsum(marks[:-1]) > 0).tolist(), ids

    def _windows(self, seen: tuple, at: int, size: int, places):
        """(first word, word after the last, items) of occurring windows around a pattern that occurs at a word."""
        rest, after = self.window - self.block, at + size
        if isinstance(places, dict):
            if None in places:
                yield at, after, places[None]
            for before in range(max(0, rest - len(seen) + after), min(rest, at) + 1):
                found = places.get((before, *seen[at - before : at], *seen[after : after + rest - before]))
                if found:
                    yield at - before, after + rest - before, found
            return
        for p in places:
            if p < 0:
                yield at, after, (-p - 1,)
                continue
            item = self._item(p)
            low, high = self.first[item], self.first[item + 1]
            left = right = 0
            while left < rest and left < at and p - left > low and self.words[p - left - 1] == seen[at - left - 1]:
                left += 1
            q = p + size
            while right < rest and after + right < len(seen) and q + right < high and self.words[q + right] == seen[after + right]:
                right += 1
            if left + right >= rest:
                yield at - left, after + right, (item,)


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """Code point offsets (end exclusive) of the words of a text."""
    spaced = np.frombuffer(text.lower().translate(WORDS_ONLY), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], spaced.view(np.int8), [0])))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return list(zip(points[np.flatnonzero(edge == 1)].tolist(), points[np.flatnonzero(edge == -1)].tolist()))


def hit_runs(text: bytes, hits: list[int]) -> list[dict]:
    """Runs of neighbouring hit words: first and last word, and their span in the original text."""
    out: list[dict] = []
    if hits:
        spans = word_spans(text)
        for k in hits:
            if out and k == out[-1]["last"] + 1:
                out[-1] |= {"last": k, "end": spans[k][1]}
            else:
                out.append({"first": k, "last": k, "start": spans[k][0], "end": spans[k][1]})
    return out


def united(runs: list[dict]) -> list[dict]:
    """Runs that overlap or touch become one."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: (r["first"], r["last"])):
        if out and r["first"] <= out[-1]["last"] + 1:
            if r["last"] > out[-1]["last"]:
                out[-1] |= {"last": r["last"], "end": r["end"]}
        else:
            out.append(dict(r))
    return out


def _slices(benchmark: DataFrame, automaton_words: int):
    """(key, broadcast items) of about `automaton_words` words each, one at a time; each distinct text once, with all its ids."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = durable(items.groupBy("text").agg(F.collect_set("item_id").alias("ids")).withColumn("words", F.regexp_count("text", F.lit(WORD))).where("words > 0"))
    total = items.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // automaton_words))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        shared = spark.sparkContext.broadcast([(r["ids"], r["text"].encode()) for r in part.select("ids", "text").toLocalIterator()])
        yield n, f"{spark.sparkContext.applicationId} {shared._jbroadcast.id()}", shared


def _scan(docs: DataFrame, name: str, shared, window: int) -> DataFrame:
    def run(batches):
        index = kept(name, lambda: Index(shared.value, window))
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch["doc_id"].to_pylist(), batch["text_key"].to_pylist(), batch["bytes"]):
                text = text.as_py()
                n, hits, ids = index.scan(text)
                rows.append((doc_id, key, n, sorted(ids), hit_runs(text, hits)))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(RUN))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "text_key", "n_words", "item_ids", "runs"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_bytes().alias("bytes")).mapInArrow(run, SCHEMA)


def _union(key, table):
    """What several slices found in one text."""
    runs = united([r for x in table["runs"].to_pylist() for r in x])
    ids = sorted({i for x in table["item_ids"].to_pylist() for i in x})
    return pa.table([table["doc_id"][:1], table["text_key"][:1], pa.array([ids], pa.list_(pa.string())), pa.array([runs], pa.list_(RUN))], ["doc_id", "text_key", "item_ids", "runs"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, automaton_words: int = 1_500_000) -> DataFrame:
    """Which words of each document lie in a passage of the benchmark.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A window is `window` consecutive words of an
    item; an item of fewer words, but not none, is one window. Returns one row for each row of docs: doc_id, n_words,
    n_hit, item_ids (sorted strings), spans (code points of the original text, end exclusive, neighbours joined).

    Null and empty texts have no words; a null item_id still marks words but is in no item_ids; repeated rows, of either
    table, give repeated and equal rows; long texts are scanned in linear time; without items nothing is hit. An automaton takes
    some 130 bytes for each word of its items and is built once in a Python worker; one of more than `automaton_words` words,
    counted before anything is sent, is made in slices of about so many, and the texts are scanned once for each. The driver
    holds one slice at a time, and what the slices found is written before it is united, so `automaton_words` bounds memory
    and changes no result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    every, parts = None, []
    for n, name, shared in _slices(benchmark, automaton_words):
        found = _scan(docs, name, shared, window)
        if n == 1:
            return _result(found)
        if every is None:
            every = found = durable(found)
        parts.append(durable(found.where(F.size("runs") > 0).dropDuplicates(["doc_id", "text_key"])))
        shared.unpersist()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    schema = "doc_id bigint, text_key bigint, item_ids array<string>, runs array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
    hits = hits.drop("n_words").groupBy("doc_id", "text_key").applyInArrow(_union, schema)
    hits = hits.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "item_ids", "runs")
    rows = every.select("doc_id", "text_key", "n_words")
    rows = rows.join(hits, rows["doc_id"].eqNullSafe(hits["d"]) & (rows["text_key"] == hits["t"]), "left")
    none = lambda c: F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c)
    return _result(rows.select("doc_id", "n_words", none("item_ids"), none("runs")))


def _result(rows: DataFrame) -> DataFrame:
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1)
    spans = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "item_ids", spans.alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, automaton_words: int = 1_500_000) -> DataFrame:
    """The rows of docs, with all their columns, without a word in a passage of the benchmark (see find_contamination).

    Rows of null and empty texts stay; repeated rows stay or go together; long texts are scanned whole; columns of any name
    are kept; without items all rows stay, and an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    for n, name, shared in _slices(benchmark, automaton_words):

        def run(batches, name=name, shared=shared):
            index = kept(name, lambda: Index(shared.value, window))
            for batch in batches:
                clean = [not index.scan(t.as_py())[1] for t in batch["_bytes"]]
                yield batch.drop_columns(["_bytes"]).filter(pa.array(clean, pa.bool_()))

        rows = docs.select(F.struct(*docs.columns).alias("row"), text_bytes().alias("_bytes"))
        docs = rows.mapInArrow(run, rows.drop("_bytes").schema).select("row.*")
        if n > 1:  # else every slice's automaton would be in memory at once
            docs = durable(docs)
    return docs
