import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from callatlas.llm import ngrams as N


def words(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [words(t) for i, t in rows if not held(i)]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(["<s>", *t], t))
    context = Counter(h for t in train for h in ["<s>", *t[:-1]])
    n, v = sum(one.values()), len(one)
    code = lambda x: round(math.log2(x) * N.STEPS) + N.MIDDLE if x > 0 else 0
    bucket = lambda c: min(int(math.log2(c)) + 1, N.BUCKETS - 1) if c > 0 else 0
    seen = Counter()
    for (h, w), k in two.items():
        c = context[h] - 1
        seen[bucket(c), code((k - 1) / c * (v + 1) if c else 0), code((one[w] - 1) / max(n - 1, 1) * (v + 1))] += k
    weights = N.learn_weights([(*k, m) for k, m in seen.items()])
    out = []
    for i, t in rows:
        base = score = 0.0
        known = 0
        for h, w in zip(["<s>", *words(t)], words(t)):
            l2, l1, l0 = weights[bucket(context[h])]
            score += math.log10(l2 * (two[h, w] / context[h] if context[h] else 0) + l1 * one[w] / max(n, 1) + l0 / (v + 1))
            base += math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1)))
            known += one[w] > 0
        out.append((i, held(i), len(words(t)), known, n, base, score))
    return out


@pytest.mark.parametrize("block_tokens", [1 << 20, 50])
def test_matches_brute_force(spark, block_tokens):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "é", "The", "the"]
    rows = [(k, " ".join(rng.choice(vocabulary[: rng.randint(2, 64)]) for _ in range(rng.randint(0, 40)))) for k in range(120)]
    rows += [(200, None), (201, ""), (201, ""), (None, "w1 w2"), (202, "w1 \t\n w2"), (203, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, score string").repartition(5)
    got = sorted((tuple(r) for r in N.score_documents(docs, block_tokens).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-6, abs=1e-9)
        assert math.isfinite(a[6]) and a[6] < 0


def test_no_training_documents(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    r = N.score_documents(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0) and math.isfinite(r["score"])


def test_empty(spark):
    assert N.score_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_weights_are_distributions():
    w = N.learn_weights([(0, 0, N.MIDDLE, 5), (3, N.MIDDLE + 40, N.MIDDLE + 8, 100)])
    assert np.allclose(w.sum(1), 1) and w[3, 0] > 0.9 and w[0, 0] < 0.01 and np.array_equal(w[4], w[3])
