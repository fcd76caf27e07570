import random

import numpy as np
import pytest
import xxhash
from callatlas.llm import simhash as S


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, threshold):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= threshold:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return {(x, least[find(i)]) for i, x in enumerate(ids)}


@pytest.mark.parametrize("threshold", [1, 2, 3, 5])
def test_every_close_pair_meets_at_a_home_anchor(threshold):
    rng = random.Random(threshold)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, threshold)):
            b ^= 1 << bit
        met = False
        for first, bits in S.blocks_of(threshold):
            x = np.array([v >> first & (1 << bits) - 1 for v in (a, b)], np.uint64)
            i, anchor, home = S.anchors(x, bits)
            homes = {(int(k), int(v)) for k, v, h in zip(i, anchor, home) if h}
            every = {(int(k), int(v)) for k, v in zip(i, anchor)}
            assert len(every) == len(i)
            met |= any((0, v) in homes and (1, v) in every for _, v in every) and any((1, v) in homes and (0, v) in every for _, v in every)
        assert met


def documents(rng, n=160):
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(20, 120))) for _ in range(n // 8)]
    out = []
    for k in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["x", "yy", "ZZ"])
        out.append((k, "\t".join(words) if k % 5 else " ".join(words)))
    return out


@pytest.mark.parametrize("most_homes", [4096, 3])
def test_matches_brute_force(spark, monkeypatch, most_homes):
    rng = random.Random(7)
    rows = [*documents(rng), (900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "é ü"), (905, "é ü"), (None, "one"), (906, "w " * 200_000)]
    if most_homes != 4096:
        monkeypatch.setattr(S.link_fingerprints, "__defaults__", (3, 0, most_homes))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for i, t in rows if i is not None]
    assert sorted({(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in got if r["doc_id"] is not None}) == sorted({(i, f) for (i, t), f in zip([r for r in rows if r[0] is not None], fps)})
    ids = [i for i, t in rows if i is not None]
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_components(ids, fps, 3)
    assert next(r["component_id"] for r in got if r["doc_id"] is None) == 903


def similar(rng, words, share):
    """A copy with so large a share of its words replaced."""
    out = list(words)
    for k in rng.sample(range(len(out)), max(1, round(share * len(out)))):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(x & y) / max(len(x | y), 1)


@pytest.mark.parametrize("most_homes", [4096, 3])
def test_representatives_match_brute_force(spark, monkeypatch, most_homes):
    if most_homes != 4096:
        monkeypatch.setattr(S.link_fingerprints, "__defaults__", (3, 0, most_homes))
    rng = random.Random(11)
    rows = documents(rng, 120)
    rows += [(None, rows[3][1]), (None, rows[3][1] + " x"), (None, "alone in null"), (None, "alone in null"), (3, rows[3][1]), (200, None), (201, ""), (7, "another text of seven")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, least string")
    keys = [r["k"] for r in docs.selectExpr("xxhash64(text) k").collect()]
    sig = [S.fingerprints((t or "").encode(), 2, families=S.FAMILIES) + S.fingerprints((t or "").encode(), 5, families=S.CHECKS) for _, t in rows]
    most = S.most_bits(0.8, 64 * S.CHECKS)
    root = list(range(len(rows)))
    bits = lambda a, b: bin(a ^ b).count("1")
    for i in range(len(rows)):
        for j in range(i):
            near = any(bits(sig[i][k], sig[j][k]) <= 5 for k in range(S.FAMILIES))
            if near and sum(bits(sig[i][k], sig[j][k]) for k in range(S.FAMILIES, len(sig[i]))) <= most:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    least = {}
    for k, (i, _) in enumerate(rows):
        own = (i is None, i or 0, keys[k])
        least[root[k]] = min(own, least.get(root[k], own))
    want = [(None if last else i, k) for last, i, k in least.values()]
    order = lambda xs: sorted(xs, key=str)
    assert order((r["doc_id"], r["text_key"]) for r in S.representatives(docs).collect()) == order(want)
    kept = S.keep_representatives(docs)
    assert kept.columns == docs.columns and order((r["doc_id"], r["text"]) for r in kept.collect()) == order({(i, t) for (i, t), k in zip(rows, keys) if (i, k) in set(want)})


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, pairs, apart = [], [], []
    for k in range(300):
        words = [vocabulary[min(int(rng.expovariate(0.02)), 399)] for _ in range(rng.randint(60, 400))]
        copy = similar(rng, words, rng.choice([0.005, 0.01, 0.015, 0.02, 0.06, 0.1]))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        j = jaccard(words, copy)
        (pairs if j >= 0.8 else apart if j < 0.55 else []).append(2 * k + 1)
    kept = {r["doc_id"] for r in S.keep_representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(pairs) > 100 and len(apart) > 30
    assert sum(k not in kept for k in pairs) / len(pairs) >= 0.93
    assert sum(k in kept for k in apart) / len(apart) >= 0.95 and all(2 * k in kept for k in range(300))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.near_duplicates(empty).count() == 0 and S.keep_representatives(empty).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(50)}
