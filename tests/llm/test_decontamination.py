import random
import re

import pytest
from callatlas.llm.decontamination import find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items, window):
    words, spans = WORD.findall(lower(text)), [m.span() for m in WORD.finditer(lower(text))]
    hit, ids = set(), set()
    for item_id, t in items:
        w = WORD.findall(lower(t))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            part = w[i : i + window]
            for j in range(len(words) - len(part) + 1):
                if words[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    ids.update(() if item_id is None else (str(item_id),))
    marked = {k for s in (spans[j] for j in hit) for k in range(*s)}
    return len(words), len(hit), sorted(ids), marked


@pytest.mark.parametrize("slice_words", [1_500_000, 7])
def test_matches_brute_force(spark, slice_words):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice(["a", "b", "É", "ñ9"]) for _ in range(rng.randint(1, 9)))) for k in range(8)]
    items += [(10, "A, b! a"), (11, None), (12, "  ...  "), (10, "other text 77"), (None, "b b b b")]
    texts = [" ".join(rng.choice(["A", "b", "É", "ñ9,", "zz", "--", "😀"]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "a", "A b-a", "\x00a\x00b a", "x " * 50_000 + "a b a"]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "b b b b", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string")
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string")
    got = find_contamination(docs, bench, window=4, automaton_words=slice_words).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, _ in rows:
        want[i] = brute(t, items, 4)
    for r in got:
        n, hits, ids, marked = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], list(r["item_ids"])) == (n, hits, ids)
        text = next(t for i, t, _ in rows if i == r["doc_id"]) or ""
        inside = {k for s in r["spans"] for k in range(s["start"], s["end"])}
        assert marked <= inside and all(not WORD.match(lower(text[k])) for k in inside - marked)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[:4] for r in find_contamination(docs, none).collect()] == [(1, 2, 0, [])]
    assert find_contamination(docs.limit(0), none).count() == 0


def test_blocks_in_many_items_match_brute_force():
    """Items that share their beginnings, so that blocks have many places, and some that are repeated."""
    from callatlas.llm.decontamination import Index

    rng = random.Random(8)
    for window in (1, 2, 3, 4, 5, 10):
        items = [(k, "w x y z v " * rng.randint(0, 2) + " ".join(rng.choice("abw") for _ in range(rng.randint(0, 14)))) for k in range(60)]
        index = Index([([str(k)], t.encode()) for k, t in items], window)
        for _ in range(60):
            text = " ".join(rng.choice(["w x y z v", "a", "b", "w", items[rng.randrange(60)][1]]) for _ in range(rng.randint(0, 6)))
            n, hits, ids = index.scan(text.encode())
            assert (n, len(hits), sorted(ids)) == brute(text, items, window)[:3]


def test_automaton_of_a_large_benchmark_is_bounded():
    """A slice of the default size is built within some 130 bytes a word, apart from its words' own names."""
    import subprocess
    import sys

    code = """
import random, resource, sys
from callatlas.llm.decontamination import Index
rng = random.Random(1)
items = [([str(k)], " ".join(f"w{rng.randrange(50_000)}" for _ in range(100)).encode()) for k in range(15_000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
index = Index(items, 10)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
text = b"x " * 50 + items[77][1][:300] + b" x"
assert index.scan(text)[2] == {"77"}
"""
    mb = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(sys.path)}).stdout)
    assert mb < 400, mb
