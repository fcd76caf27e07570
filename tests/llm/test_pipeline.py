import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from callatlas.llm.mixing import source_targets
from pyspark.sql import functions as F

WORDS = "the of and river mountain to in light walks slowly green a is that house for with window old stone quiet".split()


def prose(rng, n=None):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing", "er", "ly", "ness", "ment"]) * rng.randint(0, 2) for _ in range(n or rng.randint(60, 160))) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    at = tmp_path_factory.mktemp("sf")
    items = [prose(rng, 30) for _ in range(6)]
    rows = {k: prose(rng) for k in range(240)}
    what = {k: "clean" for k in rows}
    for k in range(240, 280):
        rows[k], what[k] = rows[k - 240], "copy"
    for k in range(280, 310):
        words = rows[k - 200].split()
        words[rng.randrange(5, len(words) - 5)] = "changed"
        rows[k], what[k] = " ".join(words), "near"
    for k in range(310, 360):
        words = prose(rng).split()
        rows[k], what[k] = (" ".join(w.upper() + "!!" for w in words) if k % 2 else " ".join(f"{w}### |" for w in words)), "junk"
    for k in range(360, 366):
        rows[k], what[k] = prose(rng) + " " + items[k - 360].upper() + " " + prose(rng), "leak"
    for k in range(366, 376):
        rows[k], what[k] = prose(rng) + f' token = "{rng.getrandbits(160):040x}" ' + prose(rng), "secret"
    rows[376], what[376] = None, "null"
    table = [(k, t, "en", f"src{k % 3}" if k % 11 else None, len(t or ""), "extra") for k, t in rows.items()] + [(5, rows[5], "en", "src2", len(rows[5]), "extra")]
    spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, what


def stages(spark, at):
    docs = spark.read.parquet(f"{at}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.durable(stage(spark, out[-1], at)))
    return out


def test_stages_take_effect(spark, folder):
    at, rows, what = folder
    tables = stages(spark, at)
    ids = [sorted(r["doc_id"] for r in t.select("doc_id").collect()) for t in tables]
    by = lambda kind: {k for k, w in what.items() if w == kind}
    assert all(t.columns == tables[0].columns for t in tables[1:5])
    assert not set(ids[1]) & by("junk") and by("clean") | by("copy") | by("near") | by("leak") | by("secret") <= set(ids[1])
    assert not set(ids[2]) & by("copy") and len(set(ids[2]) & by("near")) <= 4 and by("clean") <= set(ids[2]) and len(ids[2]) == len(set(ids[2]))
    assert set(ids[2]) - set(ids[3]) == by("leak") and set(ids[3]) >= by("clean") | by("secret")
    assert ids[4] == ids[3]
    text = {r["doc_id"]: r for r in tables[4].collect()}
    for k in ids[4]:
        want = re.sub(r'token = "[0-9a-f]{40}', "<SECRET>", rows[k]) if rows[k] is not None else None
        assert text[k]["text"] == want and text[k]["n_chars"] == len(want or "")
    assert {r["row"] for r in tables[4].select("row").collect()} == {"extra"}
    sizes = defaultdict(int)
    for r in text.values():
        sizes[r["source"]] += len((r["text"] or "").split())
    target = {s: t for s, _, t in source_targets(list(sizes.items()), (1, 2, 3), 3)}
    taken = defaultdict(int)
    for r in tables[5].collect():
        assert 0 < r["taken"] <= 3 * r["size"] and r["size"] == len(text[r["doc_id"]]["text"].split())
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_run_is_all_stages(spark, folder):
    at = folder[0]
    key = lambda t: sorted(map(str, t.collect()))
    assert key(corpus_pipeline.run(spark, at)) == key(stages(spark, at)[-1])


def test_empty_table(spark, folder, tmp_path):
    at = folder[0]
    spark.read.parquet(f"{at}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
