import random
import re
import time

from callatlas.llm import pii as P
from callatlas.llm import queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, text) if passes(k, m[0])]


PIECES = ["a", ".", "@", "b-", "%", "_", "1", "22", "255", "256", " ", "+", "(", ")", "-", "4111 1111 1111 1111", "4111-1111-1111-1112", "x@y.z", "é", "😀", "٣", "+1 (499) 555-6503", "10.0.0.1", "\n", "0001"]


def test_base_spans_match_the_patterns():
    rng = random.Random(1)
    for _ in range(6000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        assert P.base_spans(text) == brute(text), text


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" + " " * 300_000, "a@b" * 100_000, "1 " * 150_000, "Aa Bb " * 50_000):
        P.candidates(text, P.base_spans(text))
    assert time.time() - began < 20


NAMES = ["Mary Smith", "José García", "Élodie Dupont", "ANNA KARENINA", "Anna Wolfeschlegelsteinhausen", "Christopher McAllister", "Juan Carlos Ortega", "John F. Kennedy", "Jean-Claude O’Neill"]
OTHER = ["Lorem Dolor Sit Amet Elit Sed", "Page Three", "Lake Superior", "Public License", "Ipsum Street"]


def corpus(rng, n):
    """Documents with the spans planted in them: (doc_id, text, planted, plain ones)."""
    out = []
    for k in range(n):
        words = ["lorem", "ipsum", "dolor", "elit", "12"] * rng.randint(1, 5)
        rng.shuffle(words)
        number = f"{rng.randint(2, 9)}{rng.randint(10, 99)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        card = "".join(rng.choice("0123456789") for _ in range(16))
        handle = f"user{k}.{'x' * (k % 90)} (at) example (dot) {rng.choice(['org', 'com', 'co (dot) uk'])}"
        name, other = NAMES[k % len(NAMES)], rng.choice(OTHER)
        text, planted, plain = [
            (f"Please call {name} at {number} or mail x@y.org", [name, number], []),
            (f"see {other} in volume {rng.randint(10**6, 10**8)} on page {rng.randint(10**6, 10**7)}", [], [other]),
            (f"contact {handle} today", [handle], []),
            (f"Dear {name}, your card {card} is here", [name, card], []),
            (f"hash a{rng.randint(10**8, 10**9)}b of {other}. And {rng.randint(10**7, 10**8)}% more", [], [other]),
        ][k % 5]
        out.append((k, " ".join(words) + " " + text, planted, plain))
    return out


def test_planted_spans_are_found_and_plain_ones_left_alone(spark):
    rows = corpus(random.Random(3), 600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = P.train_pii(docs)
    found = {r["doc_id"]: r for r in P.find_pii(docs, model).collect()}
    right = wrong = missed = 0
    for k, text, planted, _ in rows:
        got = {text[s["start"] : s["end"]] for s in found[k]["extra"]}
        base = {text[s["start"] : s["end"]] for s in found[k]["base"]}
        right += len(got & set(planted))
        wrong += len(got - set(planted))
        missed += len(set(planted) - got - base)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95, (right, wrong, missed)


def test_names_are_whole_words():
    spans = lambda text: [text[c.start : c.end] for c in P.candidates(text, []) if c.kind == "name"]
    for name in NAMES:
        assert spans(f"so {name} said") == [name]
    assert spans("xxJohn Smith") == [] and spans("John Smith2 x") == [] and spans("The Dr Anna Smith") == ["Anna Smith"] and spans("He. Ended There. Oh") == ["Ended There"]
    text = "a" * 200 + "b@" + "x (at) " + "d" * 100 + " (dot) com"
    assert [text[c.start : c.end] for c in P.candidates(text, []) if c.kind == "handle"] == ["x (at) " + "d" * 100 + " (dot) com"]
    text = "1234 " * 12 + "x"
    assert [(c.kind, c.start, c.end) for c in P.candidates(text, [])] == [("number", 0, 59)]


def test_expectation_maximisation_matches_row_by_row():
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        truth = rng.random() < 0.3
        rows.append("".join("." if rng.random() < 0.3 else "+" if (rng.random() < 0.8) == truth else "-" for _ in range(4)))
    from collections import Counter

    from callatlas.llm.weak import expectation_maximisation

    chances, share, posterior = expectation_maximisation(Counter(rows), 4, 0.2, 0.85, rounds=20, better=0.6)
    c, s = {1: [0.85] * 4, 0: [0.15] * 4}, 0.2  # the chance of a vote for it, in each class
    for _ in range(20):
        p = []
        for v in rows:
            like = {k: s if k else 1 - s for k in (0, 1)}
            for k in like:
                for x, q in zip(v, c[k]):
                    like[k] *= q if x == "+" else 1 - q if x == "-" else 1
            p.append(like[1] / (like[0] + like[1]))
        for k in (0, 1):
            for j in range(4):
                yes = sum(q if k else 1 - q for q, v in zip(p, rows) if v[j] == "+") + 0.1
                no = sum(q if k else 1 - q for q, v in zip(p, rows) if v[j] == "-") + 0.1
                c[k][j] = max(yes / (yes + no), 0.6) if k else min(yes / (yes + no), 0.4)
        s = sum(p) / len(p)
    assert abs(share - s) < 1e-9 and all(abs(posterior[v] - q) < 1e-9 for v, q in zip(rows, p))
    assert all(abs(chances[k, j, 0] - c[k][j]) < 1e-9 for k in (0, 1) for j in range(4))


def test_edges_and_query(spark, tmp_path):
    rows = [(1, None, "c"), (2, "", "c"), (3, "😀 a@b.c", "c"), (3, "😀 a@b.c", "c"), (None, "10.0.0.1", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] or -1, r["n_email"], r["n_ip"], r["spans"]) for r in queries.op1_pii(spark, str(tmp_path)).collect())
    assert got == [(-1, 0, 1, "ip:0:8"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:2:7"), (3, 1, 0, "email:2:7")]
    assert all(r["n_spans"] == r["n_email"] + r["n_ip"] + r["n_extra"] for r in queries.op1_pii(spark, str(tmp_path)).collect())
    assert P.find_pii(docs.limit(0), P.train_pii(docs.limit(0))).count() == 0
