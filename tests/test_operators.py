import json

from callatlas.operators import evidence, hits, rollup, triage
from callatlas.sources import ingest
from callatlas.streaming import ledger as L
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_hits_filters_and_hierarchy(spark):
    edges = spark.createDataFrame([("x", 1, "<a.A: void m()>", "<p.Q: void s()>"), ("x", 0, "<a.A: void m()>", "<p.Q: void s()>"), ("x", 2, "<a.A: void m()>", "<p.Sub: void s()>"), ("x", 3, "<a.A: void m()>", "<o.O: void s()>"), ("x", 4, "", "b")], "analysis_id string, ord int, caller string, callee string")
    catalog = spark.createDataFrame([("C1", "HIGH", 0.5, "<p.Q: void s()>")], "category_id string, priority string, weight double, signature string")
    sub = spark.createDataFrame([("p.Sub", "p.Q")], "class string, supertype string")
    e = hits.usable_edges(edges)
    assert e.count() == 4
    assert rows(hits.first_hits(hits.exact_matches(e, catalog)), "ord", "category_id") == [(0, "C1")]
    assert rows(hits.hierarchy_matches(e, catalog, sub), "ord", "match_type") == [(2, "hierarchy")]
    nodes = spark.createDataFrame([("x", 0, "<a.A: void m()>", True), ("x", 1, "<a.A: void m()>", None)], "analysis_id string, ord int, method string, is_android_framework boolean")
    flagged = hits.with_framework_flag(spark.createDataFrame([("x", "<a.A: void m()>"), ("x", "<java.x.A: void m()>")], "analysis_id string, caller string"), nodes)
    assert rows(flagged, "caller", "is_framework") == [("<a.A: void m()>", False), ("<java.x.A: void m()>", True)]


def test_bridges_components_and_weights(spark):
    start = spark.createDataFrame([("x", "a", "u1"), ("x", "a", "u2")], "analysis_id string, caller string, callsite string")
    assert rows(hits.missing_bridges(start, start.limit(1)), "callsite") == [("u2",)]
    comp = spark.createDataFrame([("x", "a.A", "activity"), ("x", "a.A", "provider")], "analysis_id string, name string, component_type string")
    h = spark.createDataFrame([("x", "<a.A: void m()>")], "analysis_id string, caller string")
    assert rows(hits.component_contexts(h, comp), "component_type") == [("provider",)]
    w = spark.createDataFrame([("soot_cg", None), ("jimple_invoke", None), ("threading_synthetic", "low"), ("listener_synthetic", "high"), ("callback_synthetic", None), ("odd", None)], "s string, c string")
    assert [r[0] for r in w.select(hits.edge_weight(F.col("s"), F.col("c"), True)).collect()] == [1, 2, 8, 4, 25, 20]
    assert [r[0] for r in w.select(hits.edge_weight(F.col("s"), F.col("c"))).collect()] == [1, 2, 3, 3, 3, 3]


def test_preview_gives_spare_places_away(spark):
    df = spark.createDataFrame([(k, "CRITICAL") for k in range(2)] + [(k, "LOW") for k in range(100, 150)], "id int, p string")
    got = rows(rollup.stratified_preview(df, "p", ["id"], 10), "id", "p")
    assert [rollup.preview_shares(h, 100) for h in ({"HIGH": 500, "MEDIUM": 100, "LOW": 50}, {}, {"LOW": 3})] == [{"CRITICAL": 0, "HIGH": 63, "MEDIUM": 25, "LOW": 12}, {"CRITICAL": 0, "HIGH": 0, "MEDIUM": 0, "LOW": 0}, {"CRITICAL": 0, "HIGH": 0, "MEDIUM": 0, "LOW": 3}]
    assert len(got) == 10 and [g for g in got if g[1] == "CRITICAL"] == [(0, "CRITICAL"), (1, "CRITICAL")]


def test_triage_and_evidence(spark):
    seeds = spark.createDataFrame([(1, "m", "s1", 2, 0, "x", "A"), (1, "m", "s2", 1, 1, "y", "B"), (2, "m", "s3", 1, 2, "z", "A")], "case_id int, caller string, seed_id string, priority int, ord int, signature string, category string")
    assert rows(triage.merge_call_sites(seeds), "case_id", "primary_seed", "category") == [(1, "s2", "MERGED(2)"), (2, "s3", "A")]
    cases = spark.createDataFrame([(1, True, 0.9), (2, True, 0.5), (3, None, None)], "id int, should_prune boolean, pruning_confidence double")
    assert rows(triage.keep_cases(cases), "id") == [(2,), (3,)]
    facts = spark.createDataFrame([("s", 0, ["u1", "u2"]), ("t", 0, ["u1"])], "seed_id string, idx int, support_unit_ids array<string>")
    units = spark.createDataFrame([("s", "u1"), ("t", "u1")], "seed_id string, unit_id string")
    assert rows(evidence.verified(facts, units), "seed_id", "status") == [("s", "FAILED"), ("t", "VERIFIED")]
    h = spark.createDataFrame([("x", "1", "a", "R", True), ("x", "2", "b", "R", False), ("x", "3", "b", "R", False), ("x", "4", "c", "R", False), ("x", "5", "c", "K", False), ("x", "6", "d", "R", False)], "analysis_id string, hit_id string, caller string, category_id string, target_is_sensitive boolean")
    assert rows(evidence.reflection_verdicts(h, "R", "K"), "hit_id", "verdict") == [("1", "sensitive_target"), ("2", "obfuscated_chain"), ("3", "obfuscated_chain"), ("4", "crypto_chain"), ("6", None)]


def test_ingest_reads_artifacts(spark, tmp_path):
    d = tmp_path / "app1"
    d.mkdir()
    doc = {"nodes": [{"method": "m", "class": "c"}], "edges": [{"caller": "m", "callee": "n", "callsite": {"unit": "u"}}, {"caller": "", "callee": "n"}], "callbacks": [{"method": "m", "registrationSite": "r"}]}
    (d / "cg.json").write_text(json.dumps(doc))
    g = ingest.read_callgraphs(spark, str(tmp_path / "*/cg.json"))
    assert rows(ingest.nodes(g), "analysis_id", "ord", "method") == [("app1", 0, "m")]
    assert rows(ingest.edges(g), "caller", "callee", "callsite") == [("m", "n", "u")] and rows(ingest.callbacks(g), "registration_site") == [("r",)]
    (tmp_path / "cat.json").write_text(json.dumps({"version": "1", "categories": {"K": {"priority": "high", "weight": 0.5, "signatures": {"methods": ["a"], "fields": [], "strings": ["s"]}}}}))
    assert rows(ingest.read_catalog(spark, str(tmp_path / "cat.json")), "category_id", "priority", "kind", "signature") == [("K", "HIGH", "methods", "a"), ("K", "HIGH", "strings", "s")]
    (tmp_path / "src/com/a").mkdir(parents=True)
    (tmp_path / "src/com/a/B.java").write_text("class B {}")
    sources = ingest.read_sources(spark, str(tmp_path / "src"))
    assert rows(sources, "class_name", "text") == [("com.a.B", "class B {}")]
    classes = spark.createDataFrame([("com.a.B$C",), ("x.Y",)], "class string")
    assert rows(ingest.source_of(classes, sources), "class", "path") == [("com.a.B$C", "com/a/B.java"), ("x.Y", None)]
    (tmp_path / "rules.txt").write_text("# note\n<a> -> _SOURCE_\n<b> -> _SINK_\n")
    assert rows(ingest.read_rules_text(spark, str(tmp_path / "rules.txt")), "signature", "kind") == [("<a>", "source"), ("<b>", "sink")]


def test_ledger_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "ledger"
    folder.mkdir()
    events = [{"ts": f"2024-01-01T00:00:{k:02d}Z", "event_type": ("stage.start", "stage.end")[k % 2], "analysis_id": "a", "run_id": "r", "stage": f"s{k // 4}"} for k in range(12)]
    (folder / "1.json").write_text("\n".join(map(json.dumps, events[:7])) + "\n\nnot json\n")
    (folder / "2.json").write_text("\n".join(map(json.dumps, events[7:])))
    batch = L.read_ledger(spark, str(folder))
    assert batch.count() == 12
    stream = L.stage_state(L.stream_ledger(spark, str(folder), 1))
    out = L.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "analysis_id string, run_id string, stage string, started timestamp, ended timestamp, n_events bigint", ["analysis_id", "run_id", "stage"])
    key = ("stage", "started", "ended", "n_events")
    assert rows(out, *key) == rows(L.stage_state(batch), *key) and out.count() == 3
    d = L.stage_durations(batch.select("run_id", "stage", F.substring_index("event_type", ".", -1).alias("kind"), L.parsed(F.col("ts")).alias("ts")), ["run_id"])
    assert rows(d, "stage", "seconds") == [("s0", 3.0), ("s1", 3.0), ("s2", 3.0)]
