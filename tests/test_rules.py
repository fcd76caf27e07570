import pytest
from callatlas.operators import rules as R
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def patterns(spark):
    p = R.pattern
    return R.patterns_table(spark, [
        p(0, "ALL", 0.2, ["A", "B"], override="HIGH"), p(1, "ANY", 0.1, ["A"], ["C", "D"]), p(2, "TWO", 0.3, [], ["A"], ["D", "E"]),
        p(3, "COUNT", 0.25, min_count=2, from_set=["A", "C", "E"], override="CRITICAL"), p(4, "EMPTY", 0.05), p(5, "SPARE", 0.5, ["Z"])])


@pytest.mark.parametrize("have,want", [([], "EMPTY"), (["A"], "EMPTY"), (["A", "B"], "ALL EMPTY"), (["A", "C"], "ANY COUNT EMPTY"), (["A", "D"], "ANY TWO EMPTY"), (["C", "E"], "COUNT EMPTY"), (["A", "B", "D", "E"], "ALL ANY TWO COUNT EMPTY")])
def test_clauses(spark, patterns, have, want):
    rows = spark.createDataFrame([(have,)], "c array<string>")
    assert R.with_patterns(rows, "c", patterns).select(F.array_join("patterns.pattern_id", " ").alias("p")).first()["p"] == want


def test_score_caps_and_only_promotes(spark, patterns):
    rows = spark.createDataFrame([(["A", "B", "D", "E"], 0.6, "LOW"), (["A", "B"], 0.6, "CRITICAL"), ([], 0.6, "LOW"), (["A", "B"], None, "ODD")], "c array<string>, w double, p string")
    got = [(round(r["raw_score"], 6), round(r["threat_score"], 6), r["effective_priority"]) for r in R.score(rows, "c", "w", "p", patterns).collect()]
    assert got == [(1.5, 1.0, "CRITICAL"), (0.85, 0.85, "CRITICAL"), (0.0, 0.0, "LOW"), (0.25, 0.25, "HIGH")]
    block = R.score(rows.limit(1), "c", "w", "p", patterns, block=True).first()
    assert round(block["boost"], 6) == round(sum(round(0.4 * b, 3) for b in (0.2, 0.1, 0.3, 0.25, 0.05)), 6)


def test_evidence_takes_the_first_of_each_clause(spark, patterns):
    rows = R.with_patterns(spark.createDataFrame([(["A", "C", "D", "E"],)], "c array<string>"), "c", patterns).select("c", F.explode("patterns").alias("p"))
    got = {r["id"]: r["e"] for r in rows.select(F.col("p.pattern_id").alias("id"), R.evidence(F.col("p"), F.col("c")).alias("e")).collect()}
    assert got == {"ANY": ["A", "C"], "TWO": ["A", "D"], "COUNT": ["A", "C"], "EMPTY": []}


def test_catalog_is_complete():
    assert len(R.CATALOG) == 18 and len({p[1] for p in R.CATALOG}) == 18 and [p[0] for p in R.CATALOG] == list(range(18))
