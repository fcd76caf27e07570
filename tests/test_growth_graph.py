"""Graph steps meet the edges as often as they need, and no oftener."""

import glob

from callatlas.operators import pathdocs
from callatlas.plans import durable, graph


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_written_tables_are_parquet(spark):
    df = durable.checkpointed(spark.range(5).selectExpr("id", "id % 2 = 0 as even"))
    assert glob.glob(durable.shared_folder(spark).removeprefix("file:") + "/table-*/*.parquet") and sorted(r.id for r in df.collect()) == list(range(5))
    assert "parquet" in _plan(df).lower()


def test_predecessors_come_with_the_distances(spark):
    # d is met at 10 by b first (5 + 5); a is settled later, nearer the root, and gives 10 too; c's first distance shrinks
    e = spark.createDataFrame([("x", *r) for r in [("r", "b", 5), ("b", "d", 5), ("r", "a", 3), ("a", "d", 7), ("r", "c", 9), ("a", "c", 1), ("c", "e", 1)]], "analysis_id string, caller string, callee string, weight bigint")
    found = graph.weighted_distances(e, spark.createDataFrame([("x", "r")], "analysis_id string, method string"))
    assert sorted((r.method, r.dist, r.pred) for r in found.collect()) == [("a", 3, "r"), ("b", 5, "r"), ("c", 4, "a"), ("d", 10, "a"), ("e", 5, "c"), ("r", 0, None)]
    assert "Join" not in _plan(found)


def test_edges_needed_are_those_that_documents_name(spark):
    e = spark.createDataFrame([("x", *r) for r in [("r", "a", 1), ("a", "s", 2), ("a", "o", 3), ("s", "n", 4), ("z", "n", 5)]], "analysis_id string, caller string, callee string, weight bigint")
    paths = spark.createDataFrame([("x", "s", 3, ["r", "a", "s"]), ("x", "o", 4, ["r", "a", "o"])], "analysis_id string, method string, dist bigint, path array<string>")
    sinks = spark.createDataFrame([("x", "1", "s", "n"), ("x", "2", "z", "n"), ("x", "3", "s", "api")], "analysis_id string, sink_id string, caller string, callee string")
    few = pathdocs.edges_needed(sinks, paths, e)
    assert sorted((r.caller, r.callee) for r in few.collect()) == [("a", "s"), ("r", "a"), ("s", "n"), ("z", "n")]
    of = lambda x: sorted(map(str, pathdocs.reachability(sinks, paths, x).collect()))
    assert of(few) == of(e)
