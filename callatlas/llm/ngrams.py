"""Language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of its bigram, its unigram and the uniform distribution, with
weights that depend on how often the context was seen. The weights are learned by expectation-maximisation on counts from
which each training token is held out in its turn (deleted).

The corpus is packed into blocks of token numbers. Each block asks, by hash range, for the corpus-wide counts of its distinct
words and bigrams, and is answered in the same order, so what is shuffled follows the distinct keys of each block, no table
of all words is ever in one place, and each document is scored where its block is.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._common import durable, small_batches, text_bytes

#: No word holds a space, so no word has these hashes but by chance.
END = xxh64_intdigest(b" end", 0)
#: Buckets of context counts: none, then powers of two.
BUCKETS = 40
#: Ratios of probabilities are counted in steps of 2 ** (1 / STEPS); code 0 is a ratio of zero.
STEPS, MIDDLE = 8, 4096
WEIGHT_FLOOR = 1e-6

BLOCK = "block bigint, train_tokens bigint, train_docs bigint, ids binary, null_ids binary, held binary, lengths binary, words binary, numbers binary"
ASK = "bucket int, block bigint, keys binary, counts binary"
ANSWER = "bucket int, block bigint, counts binary, distinct bigint"
SCORED = "block bigint, train_tokens bigint, train_docs bigint, ids binary, null_ids binary, held binary, lengths binary, numbers binary, word_counts binary, pair_counts binary, distinct bigint"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def tokens(text: bytes) -> np.ndarray:
    """Hashes of a text's words (A-Z in lower case) and of its end."""
    words = text.lower().split()
    return np.fromiter(map(xxh64_intdigest, words, repeat(0)), np.uint64, len(words)) if words else np.zeros(0, np.uint64)


def _b(a: np.ndarray) -> bytes:
    """An array as bytes: byte planes, so that high bytes lie together, by Zstandard."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _a(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * kind.itemsize, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()


def _sorted(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _b(np.diff(keys, prepend=np.uint64(0)))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _rows(batch: pa.RecordBatch):
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def pack(ids: list, held: list[bool], texts: list[np.ndarray], number: int) -> tuple:
    """One block: words are numbered by falling frequency, so that most numbers are small and compress well."""
    lengths = np.array([len(t) + 1 for t in texts], np.int32)
    flat = np.concatenate([x for t in texts for x in (t, np.array([END], np.uint64))])
    words, numbers, freq = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(-freq, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    numbers = rank[numbers]
    held_ = np.array(held, bool)
    return (number, int(lengths[~held_].sum()), int((~held_).sum()), _b(np.array([i or 0 for i in ids], np.int64)), _b(np.array([i is None for i in ids], np.uint8)), _b(held_.view(np.uint8)), _b(lengths),
            _b(words[order]), _b(numbers))


def _blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    def run(batches):
        schema, part, k = _schema(BLOCK), TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0
        for batch in batches:
            for doc_id, out, text in zip(batch["doc_id"].to_pylist(), batch["held"].to_pylist(), batch["bytes"]):
                ids.append(doc_id)
                held.append(out)
                texts.append(tokens(text.as_py()))
                size += len(texts[-1]) + 1
                if size >= block_tokens:
                    yield _batch([pack(ids, held, texts, (part << 32) + k)], schema)
                    ids, held, texts, size, k = [], [], [], 0, k + 1
        if ids:
            yield _batch([pack(ids, held, texts, (part << 32) + k)], schema)

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.crc32(name) % 10 == 0).alias("held"), text_bytes().alias("bytes"))
    return rows.mapInArrow(run, BLOCK)


class Block:
    """A block's tokens, and its distinct bigrams in order of (context number, word number)."""

    def __init__(self, r: dict):
        self.lengths = _a(r["lengths"], np.int32)
        self.held = _a(r["held"], np.uint8).astype(bool)
        self.numbers = _a(r["numbers"], np.uint32).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.base = int(self.numbers.max()) + 2  # the number that no word has stands for the begin of a text
        before = np.empty_like(self.numbers)
        before[1:] = self.numbers[:-1]
        before[self.first] = self.base - 1
        self.pairs, self.pair = np.unique(before * self.base + self.numbers, return_inverse=True)
        self.train = np.repeat(~self.held, self.lengths)

    def hashes(self, words: np.ndarray, bits: int) -> np.ndarray:
        """Hashes of the distinct bigrams: so many bits, at the upper end."""
        h = np.append(words, np.uint64(0x5EED))
        a, b = h[self.pairs // self.base], words[self.pairs % self.base]
        k = (a ^ a >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
        k = (k ^ k >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (k ^ k >> np.uint64(32)) & np.uint64((1 << 64) - (1 << 64 - bits))


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, a range of hashes, begins in sorted keys."""
    bounds = [(k << 64) // buckets for k in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(bounds, np.uint64)), [len(keys)]))


def _asks(blocks: DataFrame, buckets: int, bits: int) -> DataFrame:
    def run(batches):
        schema = _schema(ASK)
        for batch in batches:
            for r in _rows(batch):
                block, words = Block(r), _a(r["words"], np.uint64)
                counted = (words, np.bincount(block.numbers[block.train], minlength=len(words))), (block.hashes(words, bits), np.bincount(block.pair[block.train], minlength=len(block.pairs)))
                for kind, (keys, counts) in enumerate(counted):
                    order = np.argsort(keys)
                    keys, counts = keys[order], counts[order].astype(np.uint32)
                    edges = _edges(keys, buckets)
                    rows = [(kind * buckets + k, r["block"], _sorted(keys[a:b]), _b(counts[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
                    for k in range(0, len(rows), 64):
                        yield _batch(rows[k : k + 64], schema)

    return blocks.mapInArrow(run, ASK)


def _answers(asks: DataFrame, buckets: int) -> DataFrame:
    def run(key, table):
        asked = [np.cumsum(_a(x.as_py(), np.uint64), dtype=np.uint64) for x in table["keys"]]
        counts = [_a(x.as_py(), np.uint32) for x in table["counts"]]
        _, where = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        distinct = int((total > 0).sum()) if key[0].as_py() < buckets else 0
        back = [_b(t) for t in np.split(total[where], cuts)]
        return pa.table([table["bucket"], table["block"], pa.array(back, pa.binary()), pa.array([distinct] + [0] * (len(back) - 1), pa.int64())], schema=_schema(ANSWER))

    return asks.groupBy("bucket").applyInArrow(run, ANSWER)


def _answered(blocks: DataFrame, answers: DataFrame, buckets: int, bits: int) -> DataFrame:
    def run(left, right):
        r = left.to_pylist()[0]
        block, words = Block(r), _a(r["words"], np.uint64)
        got = sorted(zip(right["bucket"].to_pylist(), range(right.num_rows)))
        out = []
        for kind, keys in enumerate((words, block.hashes(words, bits))):
            parts = [_a(right["counts"][k].as_py(), np.int64) for b, k in got if b // buckets == kind]
            found = np.concatenate(parts)
            if len(found) != len(keys):
                raise ValueError(f"block {r['block']} asked for {len(keys)} counts and got {len(found)}")
            counts = np.empty(len(keys), np.int64)
            counts[np.argsort(keys)] = found
            out.append(_b(counts))
        distinct = sum(right["distinct"].to_pylist())
        row = (r["block"], r["train_tokens"], r["train_docs"], r["ids"], r["null_ids"], r["held"], r["lengths"], r["numbers"], *out, distinct)
        return pa.Table.from_batches([_batch([row], _schema(SCORED))])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORED)


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


class Counts:
    """Corpus-wide counts for each token of an answered block: of its context, of itself, of its bigram."""

    def __init__(self, r: dict, train_docs: int):
        self.block = Block(r)
        words = np.append(_a(r["word_counts"], np.int64), train_docs)  # a text begins once in each document
        at, to = self.block.pairs // self.block.base, self.block.pairs % self.block.base
        self.context, self.word, self.both = words[at], words[to], _a(r["pair_counts"], np.int64)


def _deleted(answered: DataFrame, n: int, v: int, docs: int) -> DataFrame:
    """bucket, two, one, n: how many training tokens have which (coded) ratios of deleted estimates to the uniform one."""

    def code(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-300)) * STEPS).astype(np.int64) + MIDDLE, 0)

    def run(batches):
        schema = _schema("bucket int, two int, one int, n bigint")
        for batch in batches:
            for r in _rows(batch):
                c = Counts(r, docs)
                times = np.bincount(c.block.pair[c.block.train], minlength=len(c.both))
                seen = np.flatnonzero(times)
                context, word, both = c.context[seen] - 1, c.word[seen] - 1, c.both[seen] - 1
                two = code(np.where(context > 0, both / np.maximum(context, 1), 0) * (v + 1))
                one = code(word / max(n - 1, 1) * (v + 1))
                key, where = np.unique((bucket_of(context) << 32) | (two << 16) | one, return_inverse=True)
                sums = np.bincount(where, weights=times[seen]).astype(np.int64)
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key >> 16 & 0xFFFF).astype(np.int32)), pa.array((key & 0xFFFF).astype(np.int32)), pa.array(sums)], schema=schema)

    return answered.mapInArrow(run, "bucket int, two int, one int, n bigint")


def learn_weights(rows: list[tuple[int, int, int, int]], rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) for each bucket by expectation-maximisation; a bucket without tokens takes those of
    the next lower one that has some."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    data = np.array(rows, np.int64).reshape(-1, 4)
    known = None
    for b in range(BUCKETS):
        part = data[data[:, 0] == b]
        if len(part):
            ratios = np.stack([np.where(part[:, k] > 0, np.exp2((part[:, k] - MIDDLE) / STEPS), 0) for k in (1, 2)] + [np.ones(len(part))], 1)
            w, n = np.full(3, 1 / 3), part[:, 3].astype(float)
            for _ in range(rounds):
                share = ratios * w
                share *= (n / share.sum(1))[:, None]
                w = np.maximum(share.sum(0) / n.sum(), WEIGHT_FLOOR)
                w /= w.sum()
            known = w
        if known is not None:
            weights[b] = known
    return weights


def _scores(answered: DataFrame, weights: np.ndarray, n: int, v: int, docs: int) -> DataFrame:
    def run(batches):
        schema = _schema(SCORES)
        for batch in batches:
            for r in _rows(batch):
                c = Counts(r, docs)
                w = weights[bucket_of(c.context)]
                bigram = np.where(c.context > 0, c.both / np.maximum(c.context, 1), 0)
                p = np.log10(w[:, 0] * bigram + w[:, 1] * (c.word / max(n, 1)) + w[:, 2] / (v + 1))
                base = np.log10((c.word + 0.1) / (n + 0.1 * (v + 1)))
                sums = [np.add.reduceat(x[c.block.pair], c.block.first) for x in (p, base, (c.word > 0).astype(np.int64))]
                ids = pa.array(_a(r["ids"], np.int64), mask=_a(r["null_ids"], np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(c.block.held), pa.array(c.block.lengths.astype(np.int64)), pa.array(sums[2]), pa.array(sums[1]), pa.array(sums[0])], schema=schema)

    return answered.mapInArrow(run, SCORES)


def score_documents(docs: DataFrame, block_tokens: int = 1 << 20) -> DataFrame:
    """log10 probability of each text under a model learned from the documents that are not held out.

    docs: doc_id, text; other columns are ignored. Tokens are words (runs of other characters than \\x20 and \\x09-\\x0D,
    A-Z in lower case) and one end; a null text is empty and has its end alone. Documents with crc32(doc_id as text) mod 10
    = 0 are held out (null doc_id: as the empty text). base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens;
    score sums log10 of the interpolated bigram model, whose vocabulary has one more word for all unknown ones. Without any
    training document N and V are 0 and all words are unknown.

    Returns one row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Repeated rows
    count as often as they occur and get equal scores. An empty table gives no rows. docs must
    give the same rows in the same order when a lost part is read again, as tables do. Words are told apart by
    64-bit hashes, bigrams by 20 bits more than their number has. `block_tokens` bounds a task's memory: a block closes with the document that reaches it.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, size // (11 * block_tokens))
    bits = min(64, 20 + (size // 6).bit_length())  # a bigram shares its hash with another at odds of 2**-20, at any size
    # dealt once and read twice, by the questions and with the answers; a lost part is packed again from its own input
    blocks = _blocks(docs, block_tokens).repartition("block")
    answers = _answers(_asks(blocks, buckets, bits), buckets)
    answered = durable(_answered(blocks, answers, buckets, bits))
    sums = (F.coalesce(F.sum(c), F.lit(0)) for c in ("train_tokens", "train_docs", "distinct"))
    n, train_docs, v = answered.agg(*sums).first()
    deleted = _deleted(answered, n, v, train_docs).groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    weights = learn_weights([tuple(r) for r in deleted.collect()])
    return _scores(answered, weights, n, v, train_docs).withColumn("train_tokens", F.lit(n).cast("bigint"))


def perplexity(score: float, n_tokens: int) -> float:
    return math.pow(10, -score / n_tokens)
