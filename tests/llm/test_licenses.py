import random
from collections import defaultdict
from math import floor

from callatlas.llm import licenses as L
from callatlas.llm.queries import op13_licenses

TEMPLATES = L.default_templates()


def covered(hits):
    return {t + k for t in hits for k in range(3)}


def brute(text, templates=TEMPLATES):
    """Every diagonal of every template is walked over."""
    w = L.words_of(text or "")
    base = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    spans = []
    for label, form in templates:
        t = L.words_of(form)
        slack = max(1, floor(len(t) * (1 - L.SHARE) + 1e-9))
        at = defaultdict(list)
        where = defaultdict(list)
        for j in range(len(t) - 2):
            where[tuple(t[j : j + 3])].append(j)
        for i in range(len(w) - 2):
            for j in where.get(tuple(w[i : i + 3]), ()):
                at[i - j].append(j)
        groups = []
        for d in sorted(at):
            if groups and d - groups[-1][-1] <= slack:
                groups[-1].append(d)
            else:
                groups.append([d])

        def span(ds):
            places = [d + j for d in ds for j in at[d]]
            return min(places), max(places) + 3, len(set().union(*(covered(at[d]) for d in ds)))

        ok = lambda s: s[2] >= L.SHARE * len(t) - 1e-9 and s[1] - s[0] <= len(t) + slack
        for g in groups:
            tried = [span(g)] if ok(span(g)) else [s for s in map(span, ([d] for d in g)) if ok(s)]
            spans += [(s[0], s[1], s[2] / len(t), s[2], label) for s in tried]
    best, end = [], None
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if end is None or s[0] >= end:
            best.append([])
        best[-1].append(s)
        end = max(end or 0, s[1])
    best = [max((share, n, label) for _, _, share, n, label in group) for group in best]
    starts = [i for i, _ in base]
    of_base = {x for _, x in base}
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(of_base)), ",".join(sorted(of_base | {b[2] for b in best})), max((b[0] for b in best), default=0.0)


def edited(rng, text, times):
    words = text.split()
    for _ in range(times):
        k = rng.randrange(len(words))
        words[k : k + rng.choice([0, 1])] = rng.choice([[], ["other"], ["other", "words"]])
    return " ".join(words)


def planted(seed=13):
    rng = random.Random(seed)
    fill = lambda n: " ".join(rng.choice("the of software license is and in this under by general public rights cc by-nc 4.0 été 😀".split()) for _ in range(n))
    texts = [None, "", "!!", "mit", "CC-BY", "cc by cc by\ncc  BY", "All Rights Reserved. all rights; reserved", "general public license " * 3, "ccby cc_by", "ALL RİGHTS RESERVED", "the K license cc bKy"]
    for label, form in TEMPLATES:
        texts += [fill(rng.randint(0, 30)) + " " + form + "\n" + fill(rng.randint(0, 30)), edited(rng, fill(5) + " " + form, rng.randint(1, 5)), form.upper(), " ".join(form.split()[: len(form.split()) // 2])]
    texts += [" ".join(f for _, f in rng.sample(TEMPLATES, 5)) for _ in range(8)]
    texts += ["Released under the MIT License. " * 300, "licensed under the of licensed under the " * 200, fill(30_000), TEMPLATES[0][1] + " " + fill(40_000) + " " + L.TEXTS["isc"]]
    return texts


def result(r):
    return tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"))


def test_scan_matches_brute_force(spark):
    texts = planted()
    rows = list(enumerate(texts)) + [(None, "Released under the MIT License."), (5, texts[5]), (5, texts[5]), (5, "Released under the MIT License.")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, label string, key int").repartition(6)
    got = sorted(((r["doc_id"], *result(r)) for r in L.scan_licenses(docs).collect()), key=str)
    want = sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert got == want


def test_every_template_is_found_with_a_changed_word(spark):
    rows = []
    for k, (label, form) in enumerate(TEMPLATES):
        words = form.split()
        mid = len(words) // 2
        rows += [(k, label, form), (k + 1000, label, "Before it. " + form + " And after.")]
        if len(L.words_of(form)) >= 30:
            rows += [(k + 2000, label, " ".join([*words[:mid], "changed", *words[mid + 1 :]])), (k + 3000, label, " ".join([*words[:mid], "put in", *words[mid:]])), (k + 4000, label, " ".join([*words[:mid], *words[mid + 2 :]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, label string, text string")
    for r in L.scan_licenses(docs).join(docs.select("doc_id", "label"), "doc_id").collect():
        assert r["label"] in r["labels"].split(","), r
        assert [s["label"] for s in r["spans"]] == [r["label"]] and r["score"] >= 0.8, r


def test_near_licenses_are_told_apart(spark):
    says = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0", "Licensed under the GNU Lesser General Public License, version 3": "lgpl-3.0", L.TEXTS["bsd-2-clause"]: "bsd-2-clause", L.TEXTS["gpl-2.0-or-later"]: "gpl-2.0-or-later"}
    docs = spark.createDataFrame(list(enumerate(says)), "doc_id bigint, text string")
    got = {r["doc_id"]: [s["label"] for s in r["spans"]] for r in L.scan_licenses(docs).collect()}
    assert got == {k: [label] for k, label in enumerate(says.values())}


def test_copies_and_other_templates(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "'x y z one two three four five six' as text").repartition(9)
    got = L.scan_licenses(docs, [("own", "One, two, three! Four five; six"), ("short", "x y z")], {"y z one": "phrase"}).collect()
    assert len(got) == 500 and {(r["n_base"], r["first_word"], r["labels"], r["score"]) for r in got} == {(1, 1, "own,phrase,short", 1.0)}
    assert {(s["start"], s["end"], s["label"]) for s in got[0]["spans"]} == {(0, 3, "short"), (3, 9, "own")}


def test_empty(spark):
    assert L.scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_query_matches_brute_force(spark, tmp_path):
    rows = list(enumerate(planted(14)))[:60]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, op13_licenses(spark, str(tmp_path)).collect()), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
