import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from callatlas.llm.audit import audit_filters, failures
from callatlas.llm.queries import op12_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Every order is run over the rows, filter by filter."""
    good, toxic, first = set(), set(), {}
    for i, q, t in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if t == 1 else set()
    rows = []
    for i, text, lang in docs:
        text = text or ""
        if i is not None:
            first[text] = min(i, first.get(text, i))
        rows.append((i, text, lang or ""))
    judged = []
    for i, text, part in rows:
        w = WORDS.findall(text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        judged.append((part, fails, i in good, i in toxic))
    removed_by, out = defaultdict(Counter), []
    parts = {p for p, *_ in judged}
    for part in parts:
        own = [x for x in judged if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                removed_by[part][f] += len(gone)
                out.append([part, order, step, len(left), len(gone), sum(x[1][f] for x in own) - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)])
    return sorted((*r, removed_by[r[0]][r[1][r[2] - 1]]) for r in out)


def some_docs(n=260, seed=12):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["Ab", "word", "x$", "ZED", "é😀", "one\ttwo", str(k)]) + str(rng.randrange(rng.choice([3, 500]))) for _ in range(rng.choice([0, 4, 90, 130, 200]))) for k in range(70)]
    return [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(n)]


def test_orders_match_a_run_of_every_order(spark):
    docs = some_docs()
    docs += [(3, None, "en"), (999, None, "fr"), (None, "same", "en"), (None, "same", "en"), (7000, "same", "en"), (7001, "same", None), (7000, "same", "en"), (7002, "Long " * 30_000, "xx"), (-1, "", "fr")]
    labels = [(k, k % 3 % 2, k % 5 == 0) for k in range(0, 260, 2)] + [(4, 0, 1), (4, 1, None), (4, None, 0), (None, 1, 1), (7001, 1, 1), (123456, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, lang string, mask int, part int").repartition(6)
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id bigint, quality int, toxic int, lang string")
    got = audit_filters(frame, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_copies_are_few_rows(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'a copy' as text", "if(id % 2 = 0, 'en', 'de') as lang").repartition(7)
    rows = failures(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert sorted((r["part"], r["mask"], r["n"]) for r in rows) == [("de", 17, 1500), ("en", 1, 1), ("en", 17, 1499)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert audit_filters(none, marks).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, lang string")
    assert sorted(map(tuple, audit_filters(one, marks.limit(0)).collect())) == brute([(1, None, None)], [])


def test_query_reads_both_tables(spark, tmp_path):
    docs = some_docs(60, 3)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, k % 2) for k in range(50)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert sorted(map(tuple, op12_audit(spark, str(tmp_path)).collect())) == brute(docs, [(k, 1, k % 2) for k in range(50)])
