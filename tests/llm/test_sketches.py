import functools
import hashlib
import random
import re
import struct

import pytest
import xxhash
from callatlas.llm import sketches as S
from callatlas.llm.queries import op8_sketches
from pyspark.sql import functions as F


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(a[0], a[1][: len(a[1]) - len(a[1]) // 3] + b[1][: len(a[1]) // 3]) for a, b in zip(order, order[1:] + order[:1])]


def got(docs):
    out = S.edited_sketches(docs).select("*", S.text_of(F.col("sketch")).alias("f")).collect()
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_edited_texts_match_brute_force(spark, partitions):
    rng = random.Random(2)
    rows = [(k * 3, " ".join(rng.choice(["a", "bb", "é😀", "dog", "cat", "x\ty"]) for _ in range(rng.randint(0, 90)))) for k in range(120)]
    rows += [(1, ""), (-5, "one"), (None, "the last"), (7, "word " * 60_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, sketch string").repartition(partitions)
    out = got(docs)
    assert sorted((str(r["doc_id"]), r["edited"]) for r in out) == sorted((str(i), t) for i, t in edited(rows))
    text = dict(rows)
    assert all(r["n_chars"] == len(text[r["doc_id"]]) for r in out)


def test_repeated_rows_follow_each_other(spark):
    rows = [(1, "abcdef"), (1, "abcdef"), (1, "abcdef"), (0, "uvwxyz"), (2, None)]
    out = sorted(r["edited"] for r in got(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert out == sorted(["abcdab", "abcdab", "abcduv", "uvwx", ""])


def test_single_and_empty(spark):
    schema = "doc_id bigint, text string"
    one = got(spark.createDataFrame([(4, "abcdef")], schema))
    assert [(r["edited"], r["near_next"]) for r in one] == [("abcdab", 1.0)]
    assert got(spark.createDataFrame([], schema)) == []


def test_likeness_estimates_jaccard_and_containment(spark):
    rng = random.Random(3)
    long = [str(rng.random()) for _ in range(8000)]
    part = long[:3000] + [str(rng.random()) for _ in range(1000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(part)), (3, " ".join(long))], "id int, text string")
    rows = docs.withColumn("h", S.word_hashes(F.col("text"))).select("id", S.sketch(F.col("h")).alias("s"))
    a, b, c = (r["s"] for r in rows.orderBy("id").collect())
    assert a == c and abs(len(a) / 7996 - 1 / 8) < 0.02
    pair = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    r = pair.select(S.likeness(F.col("a"), F.col("b"), F.lit(False)).alias("j"), S.containment(F.col("b"), F.col("a")).alias("c"), S.merged(F.col("a"), F.col("b")).alias("m")).first()
    assert abs(r["j"] - 2996 / (7996 + 1000)) < 0.05 and abs(r["c"] - 0.75) < 0.06
    assert r["m"] == sorted(set(a) | set(b))


def test_digest_is_of_utf8(spark):
    docs = spark.createDataFrame([(1, "é😀x")], "doc_id bigint, text string")
    r = S.edited_sketches(docs).select(F.sha2("edited", 256).alias("s")).first()
    assert r["s"] == hashlib.sha256("é😀é".encode()).hexdigest()


def sketch_by_hand(text, shingle=5, share=1 / 8):
    """Sorted hashes of a text's shingles below the bound, with XXH64 of its own."""
    fold = lambda values: functools.reduce(lambda seed, v: xxhash.xxh64_intdigest(struct.pack("<Q", v), seed), values, 42)
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    grams = {fold(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} if len(words) >= shingle else {fold(words)} if words else set()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return sorted(signed(h) for h in grams if h >> 1 < int(share * (1 << 63)))


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = ["a", "bb", "é😀", "dog", "cat", "x\ty", "Ö", "\n"]
    rows = [(k * 2, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 6, 40, 300])))) for k in range(70)]
    rows += [(501, rows[30][1]), (500, rows[30][1]), (503, None), (502, ""), (504, "one"), (505, "one"), (-3, "w " * 9000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    order = [(i, t or "") for i, t in sorted(rows, key=lambda r: -r[0])]
    text_of = lambda s: "".join(f"{h % (1 << 64):016x}" for h in s)
    like = lambda a, b, same: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else float(same)
    want = {}
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        edit = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        own, new, following = sketch_by_hand(t), sketch_by_hand(edit), sketch_by_hand(after)
        want[i] = (len(t), hashlib.sha256(edit.encode()).hexdigest(), text_of(own), text_of(new), like(own, new, edit == t), like(own, following, t == after))
    got = {r["doc_id"]: tuple(r[c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) for r in op8_sketches(spark, str(tmp_path)).collect()}
    assert got == want and len({v[2] for v in got.values()}) > 20
