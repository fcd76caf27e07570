from collections import defaultdict

from callatlas.llm.mixing import mix, source_targets


def test_targets_are_capped_and_reshared():
    assert source_targets([("a", 100), ("b", 100)], (1, 2, 3), 3) == [("a", 100, 200 / 3), ("b", 100, 400 / 3)]
    got = source_targets([(None, 10), ("b", 1000), ("a", 10)], (1, 2, 3), 3)
    assert [g[0] for g in got] == ["a", "b", None]
    assert got[0][2] == 30 and got[2][2] == 30 and got[1][2] == 960
    assert source_targets([("a", 0), ("b", 0)], (1, 2, 3), 3) == [("a", 0, 0.0), ("b", 0, 0.0)]
    assert source_targets([], (1,), 3) == []


def test_mix_meets_its_targets(spark):
    rows = [(k, "w " * (k % 17), f"s{k % 3}" if k % 7 else None, "clash") for k in range(400)]
    rows += [(500, "one two three", "rare", "x"), (500, "one two three", "rare", "x"), (501, None, "rare", "x"), (502, "", "none", "x"), (None, "a b", "s0", "x"), (None, "c", None, "x"), (503, "long " * 100_000, "s1", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string")
    got = mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    taken, size, target, n = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        n[r["source"]] += 1
        target[r["source"]] = r["target"]
    for s in taken:
        assert abs(taken[s] - target[s]) <= 1 + 2 and target[s] <= 3 * size[s]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())


def test_only_ties(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")] * 9 + [(2, "x", "t")], "doc_id bigint, text string, source string")
    got = mix(docs).collect()
    assert len({r["taken"] for r in got if r["source"] == "s"}) == 1  # ties share alike
    assert sum(r["taken"] for r in got if r["source"] == "t") == 3


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
