from callatlas.operators import pathdocs as P
from callatlas.plans import graph
from pyspark.sql import functions as F

EDGES = [("e", "a", 1, "cg"), ("a", "b", 2, "cg"), ("b", "sink", 5, "listener"), ("b", "c", 1, "cg"), ("x", "sink", 1, "cg")]


def made(spark, sinks, most=20, edges=EDGES, roots=("e",)):
    g = spark.createDataFrame([("1", a, b, w, s, f"at {a}>{b}") for a, b, w, s in edges], "analysis_id string, caller string, callee string, weight bigint, edge_source string, callsite string")
    reached = graph.paths(graph.weighted_distances(g, spark.createDataFrame([("1", r) for r in roots], "analysis_id string, method string")), most)
    s = spark.createDataFrame([("1", f"{a}>{b}", a, b) for a, b in sinks], "analysis_id string, sink_id string, caller string, callee string")
    units = spark.createDataFrame([("1", "b>sink", k, f"u{k}", t) for k, t in enumerate(["if $i == 0 goto u2", "r = 1", " switch x", "$b = $c < $d", "goto u1", "return"])], "analysis_id string, sink_id string, idx int, unit_id string, stmt string")
    rows = P.reachability(s, reached, g, most)
    return {r["sink_id"]: r for r in P.path_documents(rows, g, units).collect()}, rows, g, units


def test_full_and_partial_documents(spark):
    got, rows, g, units = made(spark, [("b", "sink"), ("c", "other"), ("x", "sink"), ("x", "y"), ("b", "b"), ("e", "e")])
    d = got["b>sink"]
    assert (d["status"], d["reachable"], d["path_methods"], d["path_len"], d["path_cost"]) == ("full", True, ["e", "a", "b", "sink"], 3, 8)
    assert [(e["caller"], e["callee"], e["edge_source"], e["callsite"], e["weight"], e["pattern"]) for e in d["edges"]] == [("e", "a", "cg", "at e>a", 1, None), ("a", "b", "cg", "at a>b", 2, None), ("b", "sink", "listener", "at b>sink", 5, None)]
    assert [(b["unit_id"], b["stmt"]) for b in d["branch_conditions"]] == [("u0", "if $i == 0 goto u2"), ("u2", " switch x"), ("u3", "$b = $c < $d")]
    assert [b["idx"] for b in [r for r in P.path_documents(rows, g, units, 2).collect() if r["sink_id"] == "b>sink"][0]["branch_conditions"]] == [0, 2]
    # the sensitive method is no edge of the graph: it ends the path, without an edge or a weight
    d = got["c>other"]
    assert (d["path_methods"], d["path_cost"], len(d["edges"])) == (["e", "a", "b", "c", "other"], 4, 3)
    # nothing leads to the caller
    d = got["x>sink"]
    assert (d["status"], d["reachable"], d["path_len"], d["path_methods"], d["example_path"]) == ("partial", False, None, ["x", "sink"], [])
    assert [(e["callsite"], e["weight"]) for e in d["edges"]] == [("at x>sink", None)]
    assert [(e["caller"], e["callee"], e["callsite"]) for e in got["x>y"]["edges"]] == [("x", "y", None)]
    # a path that ends with the sensitive method is not made longer; a root alone is a path of one method
    assert (got["b>b"]["path_methods"], got["b>b"]["path_cost"]) == (["e", "a", "b"], 3)
    assert (got["e>e"]["path_methods"], got["e>e"]["path_len"], got["e>e"]["edges"], got["e>e"]["branch_conditions"]) == (["e"], 0, [], [])


def test_paths_are_cut(spark):
    line = [(f"m{k:02d}", f"m{k + 1:02d}", 1, "cg") for k in range(30)]
    got, *_ = made(spark, [("m03", "z"), ("m04", "z"), ("m29", "m30")], 5, line, ("m00",))
    assert got["m03>z"]["path_methods"] == ["m00", "m01", "m02", "m03", "z"] and len(got["m03>z"]["edges"]) == 3
    assert got["m04>z"]["path_methods"] == ["m00", "m01", "m02", "m03", "m04"] and len(got["m04>z"]["edges"]) == 4
    # the head of a long path stays, and the cost is that of the whole
    assert got["m29>m30"]["path_methods"] == ["m00", "m01", "m02", "m03", "m04"] and got["m29>m30"]["path_cost"] == 30 and got["m29>m30"]["path_len"] == 4


def test_what_guards(spark):
    texts = {"if a goto b": True, "  switch x": True, "x = a == b": True, "x goto y": True, "a != b": True, "a < b": True, "a > b": True, "goto x": False, "x = y": False, "<a.B: c d>": False, "": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", P.is_branch(F.col("t")).alias("b")).collect()
    assert {r["t"]: r["b"] for r in rows} == texts


def test_empty(spark):
    got, rows, g, units = made(spark, [("b", "sink")])
    assert P.path_documents(rows.limit(0), g, units).collect() == []
