import hashlib
import random
import re

import pytest
from callatlas.llm import infill as I
from callatlas.llm.queries import op11_infill
from pyspark.sql import functions as F

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, share=100, spm=50):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    d = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in I.MARKS) or h[2] % 100 >= share:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def texts(rng, count):
    pieces = ["\n", "\n\n", "line\n", "é😀", "\r\n", "a b", "<", "P>", "<S", "\x85", " ", "x" * 5000, "end\n" * 900]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(count)]


@pytest.mark.parametrize("size", [1, 3, 64, I.LEAF])
def test_splits_agree_with_slices(size):
    rng = random.Random(size)
    for text in [*texts(rng, 12), "", "\n", "no end", "a\nb"]:
        text = text[:6000]
        units, tree = UNIT.findall(text), I.rope(text, size)
        assert I.text_of(tree) == text and (tree is None or (tree.units, tree.points) == (len(units), len(text)))
        for k in {0, 1, len(units) // 2, len(units), len(units) + 1, rng.randint(0, len(units))}:
            a, b = I.split_units(tree, k)
            assert (I.text_of(a), I.text_of(b)) == ("".join(units[:k]), "".join(units[k:]))
            assert (a.units if a else 0, b.units if b else 0) == (min(k, len(units)), max(len(units) - k, 0))
        for k in {0, 1, len(text) // 3, len(text)}:
            a, b = I.split_points(tree, k)
            assert (I.text_of(a), I.text_of(b)) == (text[:k], text[k:])


def test_trees_stay_flat():
    tree = I.rope("x\n" * 20_000, 1)
    rng = random.Random(1)
    for _ in range(40):
        a, b = I.split_units(tree, rng.randint(0, tree.units))
        tree = I.join(b, a)
    assert tree.units == 20_000 and tree.height <= 1.45 * 15 + 2

    def check(r):
        if r.left is None:
            return r.units, r.points
        assert abs(r.left.height - r.right.height) <= 1
        x, y = check(r.left), check(r.right)
        assert (r.units, r.points) == (x[0] + y[0], x[1] + y[1])
        return r.units, r.points

    check(tree)


def test_marks_across_leaves():
    for size in (1, 2, 5):
        assert I.rank_of(I.rope("ab\ncd<\nS>ef", size), "<\nS>") == 5
    assert I.rank_of(I.rope("abc"), "<S>") == -1 and I.rank_of(None, "<S>") == -1


def test_forms_match_brute_force_and_come_back(spark):
    rng = random.Random(11)
    rows = [(k, t) for k, t in enumerate(texts(rng, 150))]
    rows += [(900, None), (901, ""), (902, "holds <P> mark\nx"), (903, "<M>"), (904, "\n" * 50_000), (905, "word " * 60_000), (None, "a\nb\nc\nd"), (906, "same\nrow"), (906, "same\nrow"), (-7, "<\nS><\nP>\n<<S"), (907, "<P"), (908, "one")]
    docs = spark.createDataFrame([(*r, "clash", 1.5, [r[0]]) for r in rows], "doc_id bigint, text string, output string, n double, row array<bigint>").repartition(5)
    formed = I.form_texts(docs)
    assert formed.columns == ["doc_id", "text", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    out = I.restore_texts(formed.drop("text")).collect()
    key = lambda r: (str(r[0]), r[5])
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")) for r in out), key=key) == sorted((brute(*r) for r in rows), key=key)
    assert all(r["row"] == [r["doc_id"]] for r in out)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_parameters(spark):
    rows = [(k, f"a{k}\nb\nc\n") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["form"], r["output"]) for r in I.form_texts(docs, share=40, spm=10).collect()}
    assert got == {k: brute(k, t, 40, 10)[2::3] for k, t in rows}
    assert 60 < sum(f != "plain" for f, _ in got.values()) < 100
    marks = ("[pre]", "[suf]", "[mid]")
    back = I.restore_texts(I.form_texts(docs, marks=marks), marks=marks)
    assert back.where("restored != text").count() == 0 and back.where("output like '%[mid]%'").count() == 200
    with pytest.raises(ValueError):
        I.form_texts(docs, marks=("aba", "<S>", "<M>"))


def test_bytes_that_are_no_utf8_are_kept(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('610AFF0A62') as string)").alias("text"))
    r = I.restore_texts(I.form_texts(docs)).select(F.hex(F.col("restored").cast("binary")).alias("h"), "n").first()
    assert (r["h"], r["n"]) == ("610AFF0A62", 3)


def test_empty_table(spark):
    assert I.restore_texts(I.form_texts(spark.createDataFrame([], "doc_id bigint, text string"))).collect() == []


def test_query_matches_brute_force(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(texts(random.Random(5), 60))] + [(None, None), (70, "q\nr")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_infill(spark, str(tmp_path)).collect()
    want = [(r[0], r[1], r[2], r[3], r[4], sha(r[5]), sha(r[6])) for r in (brute(*x) for x in rows)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
