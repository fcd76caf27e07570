"""Quality classifier: overlapping heuristic labellers, expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches, text_bytes
from .weak import expectation_maximisation, logistic

WIDTH = 1 << 12
#: Fixed word list: frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset("the of and to in a is that for it on with as was by at be this are or from le la les de des un une et en que qui dans pour au du sur par ou avec der die das und ist von den mit zu ein eine auf nicht sich el los las y es por con para su lo".encode().split())
LETTERS = bytes(c for c in range(256) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
CAPITALS = bytes(range(65, 91))
MARKS = b"#$%&*+/<=>@[\\]^_`{|}~!"
LABELLERS = ("length", "letters", "marks", "capitals", "repetition", "function words", "word length", "lone marks", "variety")


def statistics(text: bytes) -> tuple[float, ...]:
    """Words, and shares: letters, marks, capitals of ASCII letters, words like the one before, function words, letters a
    word, lone marks; and distinct words squared for each word. Too few words to tell give a share in the middle, for which no labeller votes."""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    letters = len(text) - len(text.translate(None, LETTERS))
    ascii_letters = len(text) - len(text.translate(None, LETTERS[:52])) or 1
    lower = Counter({w.lower(): 0 for w in counts})
    for w, k in counts.items():
        lower[w.lower()] += k
    function = sum(lower[w] for w in FUNCTION_WORDS if w in lower)
    lone = sum(k for w, k in counts.items() if len(w) == 1 and not w.isalnum() and w[0] < 128)
    again = sum(map(eq, words, islice(words, 1, None)))
    return (len(words), letters / size, (size - len(text.translate(None, MARKS))) / size if text else 0.0, (len(text) - len(text.translate(None, CAPITALS))) / ascii_letters if ascii_letters >= 30 else 0.2, again / n if n >= 10 else 0.1, function / n if n >= 30 else 0.04, letters / n, lone / n, len(counts) ** 2 / n if n >= 10 else 4.0)


#: (for, against): a labeller is for a text, or against it, if its statistic lies in the range, else it has no vote.
RANGES = (
    ((4.5, 1e12), (-1, 0.5)), ((0.70, 1.01), (-1, 0.40)), ((-1, 0.015), (0.05, 1.01)), ((-1, 0.12), (0.40, 9)),
    ((-1, 0.05), (0.20, 9)), ((0.06, 9), (-1, 0.02)), ((2.5, 12), (16, 1e12)), ((-1, 0.02), (0.15, 9)),
    ((6, 1e12), (-1, 2.5)),
)


#: A bad text is bad in one way: at least half of them pass any one labeller. A good text fails one in at most 2 %.
LEAST = (0.5, 0.98)


def votes(stats: tuple[float, ...]) -> str:
    return "".join("+" if a[0] < x <= a[1] else "-" if b[0] < x <= b[1] else "." for x, (a, b) in zip(stats, RANGES))


def features(text: bytes, stats: tuple[float, ...]) -> np.ndarray:
    """Hashed features of unit length: byte trigrams by frequency, and each statistic's interval."""
    out = np.zeros(WIDTH)
    b = np.frombuffer(text, np.uint8)
    for k in range(0, max(len(b) - 2, 0), 1 << 20):
        part = b[k : k + (1 << 20) + 2].astype(np.uint32)
        if len(part) > 2:
            h = (part[:-2] * np.uint32(2654435761)) ^ (part[1:-1] * np.uint32(2246822519)) ^ (part[2:] * np.uint32(3266489917))
            out += np.bincount(h >> np.uint32(20), minlength=WIDTH)
    norm = np.linalg.norm(out)
    if norm:
        out /= norm
    for k, x in enumerate(stats):
        step = int(np.log2(x + 1)) if k in (0, 6, 8) else int(min(x, 2) * 20)
        out[(k * 1000003 + step * 7919 + 12345) * 2654435761 % (1 << 32) >> 20] += 0.7
    return out


@dataclass
class QualityModel:
    chances: np.ndarray
    share: float
    posterior: dict[str, float]
    weights: np.ndarray
    bias: float

    def score(self, text: bytes, stats: tuple[float, ...]) -> float:
        return float(features(text, stats) @ self.weights) + self.bias


def _labelled(docs: DataFrame) -> DataFrame:
    """text key, votes and bytes of each text."""

    def run(batches):
        for batch in batches:
            cast = [votes(statistics(t.as_py())) for t in batch["bytes"]]
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array(cast, pa.string())], ["k", "votes"])

    return docs.select(F.xxhash64("text").alias("k"), text_bytes().alias("bytes")).mapInArrow(run, "k bigint, votes string")


def train_quality(docs: DataFrame, sample: int = 1500) -> QualityModel:
    """Learn from unlabelled documents (text; other columns are ignored).

    All texts are put to the labellers; the numbers of their vote patterns (at most 3 to the power of 9) go to the driver,
    where expectation-maximisation gives each labeller's accuracy and each pattern's posterior. The scorer is fitted on at
    most `sample` texts that the posterior calls good and as many that it calls bad, different ones, of the lowest text hashes.
    """
    small_batches(docs.sparkSession)
    patterns = {r["votes"]: r["n"] for r in _labelled(docs).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    chances, share, posterior = expectation_maximisation(patterns, len(LABELLERS), prior=0.8, least=LEAST)

    def run(batches):
        for batch in batches:
            for k, t in zip(batch["k"].to_pylist(), batch["bytes"]):
                p = posterior[votes(statistics(t.as_py()))]
                if not 0.1 < p < 0.9:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([p > 0.5]), pa.array([p], pa.float64()), pa.array([t.as_py()], pa.binary())], ["k", "good", "p", "bytes"])

    keyed = docs.select(F.xxhash64("text").alias("k"), "text")
    x, target = np.empty((2 * sample, WIDTH), np.float32), []
    for good in (True, False):
        expected = sum(n for v, n in patterns.items() if (posterior[v] >= 0.9 if good else posterior[v] <= 0.1))
        # a hash range that holds the sample several times over, so that few texts are carried to the driver's choice; copies
        # may leave it with fewer different texts, and it is widened until the sample is full or all texts are in
        share_of, begin = min(1.0, 8 * sample / max(expected, 1)), len(target)
        while True:
            bound = min(-(1 << 63) + int(share_of * (1 << 64)), (1 << 63) - 1)
            near = keyed.where(F.col("k") <= F.lit(bound)).select("k", text_bytes().alias("bytes"))
            rows = near.mapInArrow(run, "k bigint, good boolean, p double, bytes binary").where(F.col("good") == good).dropDuplicates(["k"])
            for r in rows.orderBy("k", "bytes").limit(sample).select("p", "bytes").toLocalIterator():
                t = bytes(r["bytes"])
                x[len(target)] = features(t, statistics(t))
                target.append(r["p"])
            if share_of >= 1 or len(target) - begin >= sample:
                break
            share_of = min(1.0, 8 * share_of)
            del target[begin:]
    y = np.array(target)
    if not len(y):
        return QualityModel(chances, share, posterior, np.zeros(WIDTH), 0.0)
    balance = np.where(y > 0.5, 1 / max((y > 0.5).sum(), 1), 1 / max((y <= 0.5).sum(), 1))
    w, b = logistic(x[: len(y)], y, balance)
    return QualityModel(chances, share, posterior, w, b)


def score_quality(docs: DataFrame, model: QualityModel, columns: tuple[str, ...] = ("doc_id",), least: float = -1.0) -> DataFrame:
    """`columns` of docs, votes, posterior, score (log odds of the linear scorer) and keep (score >= least) of each text.

    Null and empty texts have no words and are judged like any other text; repeated rows get equal results; an empty table
    gives no rows; vote patterns that training has not met have a null posterior.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*columns, text_bytes().alias("_bytes"))
    schema = T.StructType(kept.schema.fields[:-1]).add("votes", "string").add("posterior", "double").add("score", "double").add("keep", "boolean")

    def run(batches):
        m = model  # goes with the function: WIDTH weights and at most 3**9 posteriors
        for batch in batches:
            cast, scores = [], []
            for t in batch["_bytes"]:
                text = t.as_py()
                stats = statistics(text)
                cast.append(votes(stats))
                scores.append(m.score(text, stats))
            arrays = [batch.column(k) for k in range(batch.num_columns - 1)]
            more = [pa.array(cast, pa.string()), pa.array([m.posterior.get(v) for v in cast], pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= least for s in scores], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*arrays, *more], [*batch.schema.names[:-1], "votes", "posterior", "score", "keep"])

    return kept.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of docs, with all their columns, whose text the scorer does not reject."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score_quality(rows, model, ("row",)).where("keep").select("row.*")
