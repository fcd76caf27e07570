"""Graph loops that go on for more rounds than the bounds they once had."""

from callatlas.plans import graph as G


def test_slice_of_a_long_method(spark, monkeypatch):
    # the rounds need no disk here, which is most of their time
    monkeypatch.setattr(G, "checkpointed", lambda df: df.coalesce(1).checkpoint())
    units = spark.createDataFrame([("m", str(k), [str(k + 1)]) for k in range(106)], "method string, unit_id string, succs array<string>")
    seeds = spark.createDataFrame([("s", "m", "105")], "seed_id string, method string, unit_id string")
    assert sorted(int(r["unit_id"]) for r in G.backward_slice(units, seeds).collect()) == list(range(106))


def test_closure_of_a_long_chain_and_a_cycle(spark, monkeypatch):
    monkeypatch.setattr(G, "checkpointed", lambda df: df.coalesce(1).checkpoint())
    links = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(68)] + [("x", "y"), ("y", "x")], "child string, parent string")
    want = {(f"c{a}", f"c{b}", b - a) for a in range(68) for b in range(a + 1, 69)} | {("x", "y", 1), ("y", "x", 1), ("x", "x", 2), ("y", "y", 2)}
    assert {tuple(r) for r in G.closure(links).collect()} == want
