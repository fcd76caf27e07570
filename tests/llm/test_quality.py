import random

import numpy as np
import pytest
from callatlas.llm import quality as Q
from callatlas.llm.weak import expectation_maximisation, logistic

WORDS = "the of and river mountain to in light walks slowly green a is that house for with window old".split()


def good(rng):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) * (rng.random() < 0.05) for _ in range(rng.randint(40, 200))) + "."


def bad(rng):
    kind = rng.randrange(4)
    words = good(rng).split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in words)
    if kind == 2:
        return " | ".join(words)
    return " ".join(w for w in words[:4] for _ in range(30))


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(1)
    rows = [(k, good(rng) if k % 6 else bad(rng), "clash") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, votes string")
    return docs, Q.train_quality(docs, sample=100)


def test_tells_good_from_bad(spark, trained):
    docs, model = trained
    rng = random.Random(2)
    held = spark.createDataFrame([(k, good(rng) if k % 2 else bad(rng)) for k in range(200)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["keep"] for r in Q.score_quality(held, model).collect()}
    assert all(got[k] for k in got if k % 2) and sum(not got[k] for k in got if k % 2 == 0) >= 97
    assert {r["doc_id"]: r["score"] for r in Q.score_quality(docs, model).collect()} == {r["doc_id"]: r["score"] for r in Q.score_quality(docs.repartition(7), Q.train_quality(docs.repartition(3), 100)).collect()}


def test_edges(spark, trained):
    _, model = trained
    rows = [(1, None), (2, ""), (3, "a"), (4, good(random.Random(3)) * 5000), (5, "x"), (5, "x"), (None, "the house")]
    got = Q.score_quality(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()
    assert len(got) == len(rows) and all(np.isfinite(r["score"]) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert [r["score"] for r in got if r["doc_id"] == 1] == [r["score"] for r in got if r["doc_id"] == 2]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    model = Q.train_quality(none)
    assert Q.score_quality(none, model).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(5)
    right = [0.95, 0.8, 0.7, 0.6]
    counts, truth = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.7
        v = "".join("." if rng.random() < 0.3 else "+-"[y != (rng.random() < p)] for p in right)
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, []).append(y)
    chances, share, posterior = expectation_maximisation(counts, 4)
    assert abs(share - 0.7) < 0.03
    assert all(abs(chances[1, k, 0] - p) < 0.04 and abs(chances[0, k, 1] - p) < 0.06 for k, p in enumerate(right))
    assert all(abs(posterior[v] - np.mean(t)) < 0.1 for v, t in truth.items() if len(t) > 300)
    assert expectation_maximisation({}, 4)[2] == {}


def test_logistic_separates():
    x = np.array([[0, 1], [1, 0], [0.1, 0.9], [0.8, 0.1]])
    w, b = logistic(x, np.array([0.0, 1, 0.1, 0.9]), np.ones(4))
    assert ((x @ w + b > 0) == [False, True, False, True]).all()
