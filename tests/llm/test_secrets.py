import math
import random
import re
import time

import pytest
from callatlas.llm import secrets as S
from pyspark.sql import functions as F

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def brute(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


RANDOM = random.Random(1)
PIECES = ["token", "Token: ", "token=token:abcdefgh ", "API_KEY = '", "apikey\"", " = ", "=", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 3, "deadbeef", "password: hunter2 ", "secret:abc", " ", "é😀", "\n", "x", "tKen"]


def texts():
    out = ["".join(RANDOM.choice(PIECES) for _ in range(RANDOM.randint(1, 14))) for _ in range(150)]
    return [*out, *ORDINARY, *PLANTED, " ".join(ORDINARY + PLANTED), None, "", "token=" + "a" * 100_000, "password" + " " * 50_000, "ab " * 60_000 + "0123456789abcdef" * 3]


ORDINARY = """3f2504e0-4f89-41d3-9a0c-0305e82c3301 2024-01-15T10-30-45Z-backup /home/user/projects/app2/build /usr/local/lib/python3/dist-packages
ThisIsACamelCaseClassNameFactory data/train-00001-of-00256 ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz getInternationalization manager_configuration
responsibilities_fingerprints MAX_CONNECTION_TIMEOUT_SECONDS com/google/android/gms/location 00000000000000000000 ==================== --------------------""".split()
PLANTED = ["q8ZrT2vLx0PnB7KdYwF3sJ5hGm", "Zx81Kq0vBnM3TyWl9PfRcD2a", "kqzvxjwpfhbtmygcnrdlse", "c2VjcmV0LWtleS1mb3ItdGVzdHMtb25seQ", "R7fK/2mQ+xZ9vLtB4nWc8sYpD1hJ6gTe"]


@pytest.fixture(scope="module")
def model(spark):
    words = ["configuration_manager", "internationalization", "getElementsByClassName", "document-fingerprints", "responsibilities", "unquestionably_long_identifier"]
    docs = spark.createDataFrame([(k, f"the {w} of it", "clash") for k, w in enumerate(words * 5)] + [(99, None, "x"), (100, "", "x")], "doc_id bigint, text string, source string")
    return S.trained_on(docs)


texts_of = texts()


def moves(value):
    at = lambda c: ord(c) - 32 if 32 <= ord(c) < 128 else 95
    return [at(a) * 96 + at(b) for a, b in zip(value, value[1:])]


def mean(model, value):
    return sum(model.ratios[m] for m in moves(value)) / (len(value) - 1)


def test_training_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice("abcxyz019_-") for _ in range(rng.randint(0, 30))), rng.random() < 0.5, rng.choice("pq")) for _ in range(300)] + [(None, True, "q")]
    got = S.train(spark.createDataFrame(rows, "value string, random boolean, source string"))
    held = {r["value"] for r in spark.createDataFrame(rows, "value string, random boolean, source string").where(S._held()).collect()}
    log = {}
    for kind in (True, False):
        joints = []
        for source in "pq":
            counts = [0] * 9216
            for v, r, s in rows:
                if r == kind and s == source and v is not None and len(v.encode()) > 1 and v not in held:
                    for m in moves(v):
                        counts[m] += 1
            joints.append(counts)
        joint = [sum(c[k] / sum(c) for c in joints) / 2 for k in range(9216)]
        rows_, single = [sum(joint[a * 96 : a * 96 + 96]) for a in range(96)], [(sum(joint[b::96]) + 1e-3 / 96) / 1.001 for b in range(96)]
        log[kind] = [math.log((x + 1e-4 * single[k % 96]) / (rows_[k // 96] + 1e-4)) for k, x in enumerate(joint)]
    want = [a - b for a, b in zip(log[True], log[False])]
    for v, r, _ in rows:
        if v:
            assert all(abs(want[m] - got.ratios[m]) < 1e-3 for m in moves(v))


def test_base_spans_match_brute_force(spark, model):
    rows = [(k, t, "clash") for k, t in enumerate(texts_of)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "token: abcdef", "x")], "doc_id bigint, text string, base string")
    got = S.scan_secrets(docs, model).withColumn("out", S.spans_text(F.filter("spans", lambda s: s["kind"] != "markov"))).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        text = rows[r["doc_id"]][1] if r["doc_id"] is not None else "token: abcdef"
        assert r["out"] == ",".join(brute(text)), text


def test_markov_spans_match_brute_force(spark, model):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts_of)], "doc_id bigint, text string")
    for r in S.scan_secrets(docs, model).collect():
        text = texts_of[r["doc_id"]] or ""
        want = [m.span() for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text) if mean(model, m[0]) >= model.least]
        assert [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "markov"] == want


def test_random_tokens_are_told_from_identifiers(spark, model):
    docs = spark.createDataFrame([(k, f"é {t} .") for k, t in enumerate(ORDINARY + PLANTED)], "doc_id bigint, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in S.scan_secrets(docs, model).collect()}
    assert [t for k, t in enumerate(ORDINARY) if got[k]] == []
    assert [t for k, t in enumerate(PLANTED) if got[len(ORDINARY) + k] != [("markov", 2, 2 + len(t))]] == []
    assert model.errors[0] < 0.01 and model.errors[1] < 0.05
    clean = {r["doc_id"]: r["text"] for r in S.redact_secrets(docs, model).collect()}
    assert all(clean[k] == f"é {t} ." for k, t in enumerate(ORDINARY)) and all(clean[len(ORDINARY) + k] == "é <SECRET> ." for k in range(len(PLANTED)))


def test_long_tokens_and_many_tokens_take_linear_time(spark, model):
    rng = random.Random(2)
    token = "".join(rng.choice(S.BASE62) for _ in range(1_000_000))
    many = [token[k : k + 24] for k in range(0, 600_000, 24)]
    docs = spark.createDataFrame([(1, token), (2, "ü " + " ".join(many))], "doc_id bigint, text string")
    docs.limit(0).count(), S.scan_secrets(docs.where("doc_id = 3"), model).count()  # starts the threads
    began = time.time()
    got = {r["doc_id"]: r for r in S.scan_secrets(docs, model).select("doc_id", F.size("spans").alias("n"), F.element_at("spans", -1)["end"].alias("last")).collect()}
    assert time.time() - began < 40
    assert (got[1]["n"], got[1]["last"]) == (1, 1_000_000)
    assert abs(got[2]["n"] - len(many)) < 0.02 * len(many)
    clean = {r["doc_id"]: r["text"] for r in S.redact_secrets(docs, model).collect()}
    assert clean[1] == "<SECRET>" and clean[2].count("<SECRET>") == got[2]["n"]


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(k, [rng.randint(0, 9) for _ in range(n)]) for k, n in enumerate((0, 1, 127, 128, 129, 1000))]
    from itertools import accumulate

    for r in spark.createDataFrame(rows, "k int, v array<int>").select("k", S.running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), S.running(F.col("v"), F.greatest, F.lit(0)).alias("m")).collect():
        assert r["s"] == list(accumulate(rows[r["k"]][1])) and r["m"] == list(accumulate(rows[r["k"]][1], max))


def test_redaction_and_training_on_documents(spark):
    docs = spark.createDataFrame([(1, "a é token = \"abcdef123\" b"), (2, "token=deadbeefdeadbeefdeadbeef z"), (3, None)], "doc_id bigint, text string")
    found = S.scan_secrets(docs, S.trained_on(docs))
    got = {r["doc_id"]: r["t"] for r in found.select("doc_id", S.redact(F.col("spans"), F.col("text")).alias("t")).collect()}
    assert got == {1: 'a é <SECRET>" b', 2: "<SECRET> z", 3: ""}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.scan_secrets(docs, S.trained_on(docs)).count() == 0
