"""Summaries, cases, threads and what belongs to the application, on fixtures worked out by hand."""

import pytest
from callatlas.functions import hints as H
from callatlas.functions import text as X
from callatlas.operators import appcode, cases, components, evidence, rules, summary, threads, triage
from callatlas.plans import graph
from callatlas.sources import ingest
from pyspark.sql import functions as F

GROUPS = "analysis_id string, ord int, group_id string, caller string, caller_class string, categories array<string>, string_categories array<string>, reachable boolean, example_path array<string>, path_len int"


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def fixture(spark):
    return spark.createDataFrame([
        ("x", 0, "g0", "<a.b.C: void m()>", "a.b.C", ["A", None], None, True, ["e1", "m"], None), ("x", 1, "g1", "<a.b.D$1: void m()>", "a.b.D$1", ["A"], ["B"], True, ["e1", "n"], 4),
        ("x", 2, "g2", "<a.c.E: void m()>", "a.c.E", ["B"], [], False, ["e2"], 1), ("x", 3, "g3", "<F: void m()>", "F", [], None, None, None, None), ("y", 4, "g4", "<a.b.C: void m()>", "a.b.C", ["A"], None, True, ["e1", "o"], 4),
    ], GROUPS)


def both(spark):
    return rules.patterns_table(spark, [rules.pattern(0, "AB", 0.1, ["A", "B"]), rules.pattern(1, "B", 0.1, ["B"])])


def test_patterns_of_applications_packages_and_levels(spark):
    g, p = fixture(spark), both(spark)
    app = summary.app_patterns(g, p)
    assert rows(app.select("analysis_id", "n_groups", "categories", F.col("patterns.pattern_id").alias("p")), "*") == [("x", 4, ["A", "B"], ["AB", "B"]), ("y", 1, ["A"], [])]
    assert rows(summary.pattern_examples(app), "pattern_id", "category", "group_id") == [("AB", "A", "g0"), ("AB", "B", "g1"), ("B", "B", "g1")]
    assert rows(summary.package_patterns(g, p), "package", "n_groups", "classes", "place") == [("a.b", 2, ["a.b.C", "a.b.D$1"], 1), ("a.c", 1, ["a.c.E"], 2)]
    assert rows(summary.level_summary(g, p), "analysis_id", "n", "n_with_patterns", "counts") == [("x", 4, 2, [("AB", 1), ("B", 2)]), ("y", 1, 0, [])]
    assert summary.app_patterns(g.limit(0), p).count() == 0 and summary.level_summary(g.limit(0), p).count() == 0


def test_entrypoints_take_the_search_first_and_the_first_shortest_path(spark):
    g, p = fixture(spark), both(spark)
    alone = summary.entrypoint_union(g, p)
    assert rows(alone, "analysis_id", "entrypoint", "n_groups", "example_path", "shortest_path_len") == [("x", "e1", 2, ["e1", "n"], 4), ("y", "e1", 1, ["e1", "o"], 4)]
    reached = spark.createDataFrame([("x", "<a.c.E: void m()>", "r", ["r", "q"], 1)], "analysis_id string, method string, root string, path array<string>, distance int")
    found = summary.entrypoint_union(g, p, reached)
    assert rows(found, "analysis_id", "entrypoint", "example_path") == [("x", "e1", ["e1", "n"]), ("x", "r", ["r", "q"]), ("y", "e1", ["e1", "o"])]
    assert rows(summary.top_entrypoints(found), "entrypoint", "place") == [("e1", 1), ("r", 2)]


def test_blocks_inventory_and_counts(spark):
    b = spark.createDataFrame([("x", 0, "LOW", 9.0, 0.1, False, []), ("x", 1, "HIGH", 0.1, 0.1, True, ["P"]), ("x", 2, "HIGH", 0.1, 0.2, True, ["P"]), ("x", 3, "HIGH", 9.0, 0.9, True, [])], "analysis_id string, ord int, effective_priority string, raw_score double, investigability double, is_library boolean, patterns array<string>")
    assert rows(summary.block_order(summary.kept_blocks(b)), "place", "ord") == [(1, 2), (2, 1), (3, 0)]
    i = spark.createDataFrame([("x", "b", 2, 1), ("x", "a", 2, 1), ("x", "c", None, 9), ("x", "d", 3, 0)], "analysis_id string, package string, n_hits int, n_methods int")
    assert rows(summary.inventory_preview(i, 1, 2), "place", "package") == [(1, "d"), (2, "a")]
    e = spark.createDataFrame([("x", "s"), ("x", "s"), ("x", "t")], "analysis_id string, edge_source string")
    n = spark.createDataFrame([("x",), ("z",)], "analysis_id string")
    m = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "a"), ("x", "c")], "analysis_id string, method string")
    assert rows(summary.callgraph_summary(n, e, m, 2), "analysis_id", "n_nodes", "n_edges", "sources", "n_entrypoints", "entrypoints") == [("x", 1, 3, [("s", 2), ("t", 1)], 3, ["a", "b"]), ("z", 1, 0, None, 0, None)]


def test_what_is_the_application_s(spark):
    c = spark.createDataFrame([("x", "com.a.Main"), ("x", "com.a.Svc"), ("x", "okhttp3.S"), ("x", "org.z.P"), ("y", "org.z.P")], "analysis_id string, name string")
    p = appcode.app_prefixes(c, spark.createDataFrame([("x", "net.q"), ("y", "")], "analysis_id string, package string"), spark.createDataFrame([("x", " h.* "), ("x", " ")], "analysis_id string, prefix string"))
    assert rows(p, "*") == [("x", "com.a."), ("x", "h."), ("x", "net.q"), ("y", "org.z.")]
    k = spark.createDataFrame([("x", n) for n in ("com.a.Main$1", "com.a.skip.B", "com.a.C", "net.quick.D", "h.E", "org.z.F", "okhttp3.S", "", None)] + [("y", "org.z.F"), ("w", "a")], "analysis_id string, class string")
    kinds = appcode.class_kinds(k, c, p, spark.createDataFrame([("x", "com.a.skip"), ("x", "com.a.Main$1")], "analysis_id string, prefix string"))
    assert rows(kinds, "analysis_id", "class", "kind") == sorted([("x", "com.a.Main$1", "component"), ("x", "com.a.skip.B", "ignored"), ("x", "com.a.C", "app"), ("x", "net.quick.D", "app"), ("x", "h.E", "app"), ("x", "org.z.F", "library"), ("x", "okhttp3.S", "component"), ("x", "", "library"), ("x", None, "library"), ("y", "org.z.F", "app"), ("w", "a", "library")], key=str)
    m = spark.range(1).select(appcode.app_methods(F.array(*map(F.lit, ("<kotlin.a: x>", "<z.java.b: x>", "<me.java.c: x>", "<q.d: x>"))), F.lit("me.")).alias("m"))
    assert m.first()["m"] == ["<me.java.c: x>", "<q.d: x>"]
    t = spark.createDataFrame([("x", ["<java.a: x>", "<q.b: x>", "<q.b: x>"]), ("y", [])], "analysis_id string, path array<string>")
    assert rows(appcode.path_methods(t), "*") == [("x", "<q.b: x>")]
    seeds = spark.createDataFrame([("x", "K", "<a.B$1: void m()>"), ("y", "", "bare")], "analysis_id string, component_name string, caller string")
    r = spark.createDataFrame([(a, i, n) for a in "xyz" for i, n in enumerate(("K", "a.B", "a.B$1", "other"))], "analysis_id string, ord int, component string")
    assert rows(appcode.referenced_components(seeds, r, 1), "analysis_id", "component") == [("x", "K"), ("x", "a.B$1"), ("x", "a.B"), ("y", "K")]


def test_cases(spark):
    c = spark.createDataFrame([("c1", 0, 5, ["h9", "h1", "h1", ""], ["g1", "gone"]), ("c2", 1, None, ["h3"], None), ("c3", 2, 5, None, ["g2"])], "case_id string, ord int, priority int, evidence_hit_ids array<string>, evidence_group_ids array<string>")
    g = spark.createDataFrame([("g1", 0, ["h1", "h2"]), ("g2", 1, ["h2", "h3"])], "group_id string, ord int, hit_ids array<string>")
    assert rows(cases.members(c, g), "case_id", "hit_id") == [("c1", "h1"), ("c1", "h2"), ("c1", "h9"), ("c2", "h3"), ("c3", "h2"), ("c3", "h3")]
    assert rows(cases.case_of_hit(c, g), "*") == [("h1", "c1", 5, 3), ("h2", "c1", 5, 3), ("h3", "c3", 5, 2), ("h9", "c1", 5, 3)]
    known = spark.createDataFrame([("h1", "S1"), ("h2", "S2"), ("h3", "S3")], "hit_id string, signature string")
    sites = cases.call_sites(c, g, known).orderBy("seed_order")
    assert [tuple(r) for r in sites.select("hit_id", "case_id", "group_id").collect()] == [("h1", "c1", "g1"), ("h2", "c1", "g2"), ("h3", "c2", "g2")]
    assert rows(cases.case_groups(c, g), "*") == [("g1",), ("g2",), ("gone",)]
    b = spark.createDataFrame([("h3", 0, None), ("h3", 1, 2), ("zz", 2, None)], "seed_id string, ord int, case_priority int")
    assert rows(cases.bundle_priority(b, c, g), "ord", "priority") == [(0, 5), (1, 2), (2, 9999)]
    assert cases.call_sites(c.limit(0), g, known).count() == 0


def test_threads(spark):
    e = spark.createDataFrame([
        ("x", "<a.A: void m()>", "<a.T: void start()>", "u1", "soot_cg"), ("x", "<a.A: void m()>", "<a.T: void run()>", "u1", "soot_cg"), ("x", "<a.A: void m()>", "<java.lang.Thread: void start()>", "u2", "soot_cg"),
        ("x", "<a.A: void m()>", "<a.Other: void start()>", "u3", "soot_cg"), ("x", "<a.A: void m()>", "<a.T: void start()>", None, "soot_cg"), ("y", "<a.A: void m()>", "<a.T: void start()>", "u1", "threading_synthetic"),
    ], "analysis_id string, caller string, callee string, callsite string, edge_source string")
    h = spark.createDataFrame([("x", "a.T", threads.THREAD), ("x", "a.R", threads.RUNNABLE)], "analysis_id string, class string, supertype string")
    assert rows(threads.validation(e, h), "*") == [("x", 1, 1, 3, 0, 1), ("y", 0, 0, 0, 1, 0)]
    assert rows(threads.missing_runs(e, h), "callsite") == [("u2",)]
    c = spark.createDataFrame([("<a.O: void onCreate()>", "flowdroid_callback"), ("<a.O: void onClick()>", "flowdroid_callback"), ("<a.O: void onCreate()>", "soot_cg"), ("bare", "flowdroid_callback")], "callee string, edge_source string")
    assert rows(threads.augmented(c), "callee", "edge_source") == [("<a.O: void onClick()>", "flowdroid_callback"), ("<a.O: void onCreate()>", "soot_cg"), ("bare", "flowdroid_callback")]
    s = spark.createDataFrame([("<android.os.Handler: boolean postDelayed(java.lang.Runnable,long)>",), ("<android.os.Handler: boolean sendMessage(android.os.Message)>",), ("<x.E: void execute(java.lang.Runnable)>",), ("<x.E: void execute(int)>",), ("<a.T: void start()>",)], "callee string")
    assert [r[0] for r in s.select(threads.start_pattern(F.col("callee"), F.lit(True))).collect()] == ["handler_post", "handler_message", "executor_execute", None, "thread_start"]


def test_threading_edges(spark):
    call = "analysis_id string, caller string, callsite string, pattern string, thread_new string, thread_field string, thread_type string, work_new string, work_type string"
    calls = spark.createDataFrame([
        ("x", "<a.A: void m()>", "1", "thread_start", "a.T", None, threads.THREAD, "a.R", None), ("x", "<a.A: void m()>", "2", "thread_start", threads.THREAD, None, threads.THREAD, "a.R", None), ("x", "<a.A: void m()>", "3", "thread_start", None, None, threads.THREAD, None, None),
        ("x", "<a.A: void m()>", "4", "handler_post", None, None, None, None, None), ("x", "<a.Z: void m()>", "5", "executor_execute", None, None, None, None, "gone"), ("x", "<b.A: void m()>", "6", "handler_post", None, None, None, None, "a.R"), ("x", "<b.A: void m()>", "7", "handler_post", None, None, None, None, None),
        ("x", "<a.A: void m()>", "8", "thread_start", None, "a.T", threads.THREAD, None, None)], call)
    runs = spark.createDataFrame([("x", c, f"{c}.run") for c in ("a.T", "a.R", "a.A$1", "a.A$1$2")], "analysis_id string, class string, run string")
    able = spark.createDataFrame([("x", c) for c in ("a.R", "a.A$1", "a.A$1$2", "a.NoRun")], "analysis_id string, class string")
    found = rows(threads.threading_edges(calls, runs, able, 2), "callsite", "callee", "pattern", "confidence")
    assert found == [("1", "a.T.run", "thread_start", "high"), ("2", "a.R.run", "thread_runnable", "high"), ("4", "a.A$1$2.run", "handler_post", "low"), ("4", "a.A$1.run", "handler_post", "low"),
                     ("5", "a.A$1$2.run", "executor_execute", "low"), ("5", "a.A$1.run", "executor_execute", "low"), ("6", "a.R.run", "handler_post", "medium"), ("8", "a.T.run", "thread_start", "medium")]


def test_texts_of_methods(spark):
    u = spark.createDataFrame([("x", "m", 'a("android.settings.X"); staticget <android.provider.Settings: java.lang.String ACTION_USAGE_ACCESS_SETTINGS>; b("t.me"); c("not.me")'), ("x", "n", 'd("https://api.evil.org.evil.com/hook/x"); e("ptb.Chat.com/api/hooks/1")'), ("x", "o", None)], "analysis_id string, method string, stmt string")
    s = evidence.method_strings(u)
    assert rows(s.where("method = 'm'"), "text") == [("android.settings.USAGE_ACCESS_SETTINGS",), ("android.settings.X",), ("not.me",), ("t.me",)]
    first, second = evidence.STRING_CATEGORIES
    i = spark.createDataFrame([(first, "usage_access"), (second, "t.me"), (second, "api.evil.org"), (second, "chat.com/api/hooks"), ("OTHER", "android")], "category_id string, indicator string")
    assert rows(evidence.string_categories(s, i), "method", "category_id", "indicators") == [("m", second, ["t.me"]), ("m", first, ["usage_access"]), ("n", second, ["chat.com/api/hooks"])]
    assert [r[0] for r in spark.createDataFrame([("a.co",), ("b.c",), (".com",), ("Test.com",)], "d string").select(X.likely_domain(F.col("d"))).collect()] == [True, False, False, False]


def test_methods_values_and_entrypoints(spark):
    parents = spark.createDataFrame([("x", "c", "b"), ("x", "b", "a"), ("x", "l1", "l2"), ("x", "l2", "l1")], "analysis_id string, class string, parent string")
    methods = spark.createDataFrame([("x", "a", "run"), ("x", "b", "go"), ("y", "c", "run")], "analysis_id string, class string, name string")
    calls = spark.createDataFrame([("x", "c", "run"), ("x", "c", "go"), ("x", "l1", "run"), ("y", "c", "run")], "analysis_id string, class string, name string")
    assert rows(graph.resolve_methods(calls, methods, parents), "analysis_id", "class", "name", "owner") == sorted([("x", "c", "run", "a"), ("x", "c", "go", "b"), ("x", "l1", "run", None), ("y", "c", "run", "c")], key=str)
    d = spark.createDataFrame([("m", 1, "a", "new T"), ("m", 2, "b", "(x.T) a"), ("m", 3, "b", "c"), ("m", 9, "a", "late"), ("o", 1, "b", "other"), ("m", 4, "s", "s")], "method string, idx int, local string, value string")
    u = spark.createDataFrame([("m", 2, "b"), ("m", 3, "b"), ("m", 0, "a"), ("m", 8, "a"), ("m", 5, "s"), ("m", 5, None)], "method string, idx int, value string")
    assert rows(triage.resolve_values(u, d), "idx", "value", "resolved") == sorted([(2, "b", "new T"), (3, "b", "c"), (0, "a", "a"), (8, "a", "new T"), (5, "s", "s"), (5, None, None)], key=str)
    sub = spark.createDataFrame([("x", "a.V", "android.content.BroadcastReceiver"), ("x", "a.F", "androidx.fragment.app.Fragment")], "analysis_id string, class string, supertype string")
    m = spark.createDataFrame([("x", f"<{c}: void {n}()>") for c in ("a.V", "a.F", "android.app.Application") for n in ("onReceive", "onDetach", "onCreate")] + [("y", "<a.V: void onReceive()>")], "analysis_id string, method string")
    assert [r[1] for r in rows(components.inherited_entrypoints(m, sub), "*")] == ["<a.F: void onCreate()>", "<a.F: void onDetach()>", "<a.V: void onReceive()>", "<android.app.Application: void onCreate()>"]


def test_hints(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    enum = F.lit("android.net.ConnectivityManager")
    assert [value(H.versioned_constant(enum, F.lit(v), F.lit(s))) for v, s in ((6, 7), (6, 8), (6, 28), (99, 30))] == [("TYPE_WIMAX", 0.7), ("TYPE_WIMAX", 0.95), ("TYPE_WIMAX", 0.5), None]
    assert value(H.resolve_path(F.lit("filesDir/a/b"), F.lit("p"))) == "/data/data/p/files/a/b" and value(H.resolve_path(F.lit("filesDir/a"), F.lit(None).cast("string"))) is None
    assert [value(H.is_stable_path(F.lit(p))) for p in ("a/b.db", "a.b/c", "a/*.db", "a/b.c_", "")] == [True, False, False, False, False] and value(H.is_stable_path(F.lit(None).cast("string"))) is False
    assert [value(H.component_of(F.lit(c), F.lit("p"))) for c in ("q/.A", "q/r.A", ".A", "r.A", "q/", "")] == ["q.A", "r.A", "p.A", "r.A", "q", None]
    none = F.lit(None)
    assert value(H.seed_warnings(none.cast("string"), none.cast("string"), none.cast("double"), F.lit(2), F.lit(0), F.lit(1))) == ["missing_component_name", "unknown_component_type", "low_confidence", "no_facts", "high_uncertainty"]
    assert [value(H.automation(F.array(*map(F.lit, w)).cast("array<string>"))) for w in ([], ["low_confidence"], ["low_confidence", "non_injectable_extra"], ["no_facts"])] == ["full", "partial", "manual", "manual"]
    assert value(H.effect_text(F.lit(""), F.lit(None), F.lit("x"))) == "x"


def test_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# c\n\n a , 1,2 \nb\n")
    assert rows(ingest.read_batch(spark, str(tmp_path / "b.txt")), "*") == [("a", "1,2"), ("b", None)]
    (tmp_path / "s.json").write_text('{"objects": [{"type": "attack-pattern", "name": "N", "external_references": [{"source_name": "o", "external_id": "0"}, {"source_name": "mitre-attack", "external_id": "T1"}], "kill_chain_phases": [{"phase_name": "p"}, {}]}, {"type": "attack-pattern", "name": "M"}, {"type": "tool"}]}')
    assert rows(ingest.read_techniques(spark, str(tmp_path / "s.json")), "*") == [("T1", "N", ["p"])]
    read = {"a": {"x": "old", "y": ""}}
    assert ingest.settings(read, {"X": "new", "Y": "env", "Z": "z"}, {"X": "a.x"}, {"Y": "a.y", "Z": "b.z"}, {"a.w": 3, "a.v": None}) == {"a": {"x": "new", "y": "env", "w": 3}, "b": {"z": "z"}} and read == {"a": {"x": "old", "y": ""}}
    path = str(tmp_path / "t")
    ingest.write_table(spark.createDataFrame([("a b", 1), ("c", 2)], "analysis_id string, v int"), path)
    assert rows(ingest.read_table(spark, path, "a b"), "v") == [(1,)]
    assert ingest.delete_analysis(spark, path, "a b") and not ingest.delete_analysis(spark, path, "a b")
    assert rows(ingest.read_table(spark, path), "v") == [(2,)]
    with pytest.raises(ValueError):
        ingest.delete_analysis(spark, path, "../t")
