from callatlas.functions import source as X
from callatlas.operators import components as C
from callatlas.operators import flows as W
from pyspark.sql import functions as F

SOURCE = '''package a; /* "no.txt" new File("gone.txt") */
class B {
  private static final String KEY = "user_id";
  static final String TAG = "Tag";
  void m() {
    File f = new File(getCacheDir(), "x.db"); // new File("gone2.txt")
    new File("/sdcard/", "y.zip"); openFileOutput(".zip");
    Log.d(TAG, "started"); Log.e(other, "lost");
    intent.getIntExtra(KEY, 0); intent.hasExtra(KEY); intent.putExtra("mode", 5); intent.putExtra(B.KEY, "v"); intent.setAction("a.GO");
    Class.forName("x.Y"); Class.forName(name);
  }
}'''


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_source_evidence(spark):
    s = spark.createDataFrame([("a.B", SOURCE), ("a.E", "")], "class_name string, text string")
    assert rows(X.file_artifacts(s), "path_hint") == [("/sdcard/",), ("cacheDir/x.db",), ("sdcard/*.zip",), ("y.zip",)]
    assert rows(X.log_hints(s), "level", "tag", "message") == [("d", "Tag", "started")]
    assert rows(X.intent_extras(s), "name", "type", "required", "value_hint") == sorted([("user_id", "int", False, None), ("user_id", None, True, None), ("mode", None, False, "5"), ("user_id", None, False, "v")], key=str)
    assert rows(X.actions(s), "action") == [("a.GO",)]
    r = s.where("class_name = 'a.B'").select(X.reflection_targets(F.col("text")).alias("r")).first()["r"]
    assert (list(r["literals"]), r["has_call"], r["non_literal"]) == (["x.Y"], True, True)


def test_components_and_entrypoints(spark):
    m = spark.createDataFrame([("x", "com.a", [".Main"], ["Svc"], None, ["com.b.P"])], "analysis_id string, package_name string, activities array<string>, services array<string>, receivers array<string>, providers array<string>")
    c = C.components(m)
    assert rows(c, "component_type", "name") == [("activity", "com.a.Main"), ("provider", "com.b.P"), ("service", "com.a.Svc")]
    methods = spark.createDataFrame([("x", f"<{k}: void {n}()>") for k, n in (("com.a.Main", "onCreate"), ("com.a.Main", "helper"), ("com.a.Svc", "onAccessibilityEvent"), ("com.b.P", "query"), ("o.O", "onCreate"))], "analysis_id string, method string")
    sub = spark.createDataFrame([("com.a.Svc", C.ACCESSIBILITY_SUPERTYPE)], "class string, supertype string")
    assert [r[0] for r in rows(C.entrypoints(methods, c, sub), "method")] == ["<com.a.Main: void onCreate()>", "<com.a.Svc: void onAccessibilityEvent()>", "<com.b.P: void query()>"]
    names = spark.createDataFrame([("x", "com.a.x.A"), ("x", "com.a.B"), ("x", "okhttp3.C"), ("x", "org.z.D")], "analysis_id string, class string")
    assert rows(C.app_prefixes(names), "prefix") == [("com.a",)] and rows(C.of_app(names, C.app_prefixes(names)), "class") == [("com.a.B",), ("com.a.x.A",)]
    p = spark.createDataFrame([("sms", "SEND_SMS"), ("loc", "FINE")], "api string, permission string")
    assert rows(C.permissions_for(spark.createDataFrame([("x.sms()",), ("y",)], "signature string"), p), "signature", "permissions") == [("x.sms()", ["SEND_SMS"]), ("y", [])]


def test_synthetic_edges_and_hints(spark):
    reg = spark.createDataFrame([("x", "<a.A: void m()>", "u", "L"), ("x", "<b.B: void m()>", "v", "L")], "analysis_id string, caller string, callsite string, listener string")
    imp = spark.createDataFrame([("L", "a.A$1", "in"), ("L", "a.Z", "near"), ("L", "c.C", "far")], "listener string, class string, method string")
    assert rows(C.listener_edges(reg, imp), "callsite", "callee", "confidence") == [("u", "in", "high"), ("v", "far", "low"), ("v", "in", "low"), ("v", "near", "low")]
    cb = spark.createDataFrame([("x", "cb1", "a.A", "site"), ("x", "cb2", "a.A", None), ("x", "cb3", "q.Q", None)], "analysis_id string, method string, component string, registration_site string")
    entry = spark.createDataFrame([("x", "<a.A: void onCreate()>")], "analysis_id string, method string")
    assert rows(C.callback_edges(cb, entry), "caller", "callee") == [("<a.A: void onCreate()>", "cb2"), ("site", "cb1")]
    h = C.hints_for(spark.createDataFrame([("a.A$1",), ("a.B",)], "class string"), spark.createDataFrame([("a.A", "h")], "class string, hint string"))
    assert rows(h, "class", "hints") == [("a.A$1", ["h"]), ("a.B", [])]


def test_flows(spark):
    path = spark.createDataFrame([("f", 0, "<a: x>"), ("f", 1, "<android.b: y>"), ("g", 0, "<a: x>")], "flow_id string, pos int, method string")
    cache = spark.createDataFrame([("<a: x>", "reads", 0.8, "jadx")], "method string, summary string, confidence double, source string")
    assert rows(W.compose(W.with_analysis(path, cache)), "flow_id", "n_methods", "summary", "sink", "confidence") == [("f", 2, "reads → not analysed", "<android.b: y>", 0.8), ("g", 1, "reads", None, 0.8)]
    assert W.method_usage(path).first()["n"] == 2
    steps = spark.createDataFrame([("f", "full"), ("f", "full"), ("g", "full"), ("g", "blocked"), ("h", "partial")], "flow_id string, feasibility string")
    assert rows(W.feasibility(steps), "flow_id", "feasibility") == [("f", "full"), ("g", "blocked"), ("h", "partial")]
    r = spark.range(1).select(W.warnings_of((F.lit(True), "a"), (F.lit(False), "b")).alias("w"), W.drifted(F.lit(10), F.lit(6)).alias("d"), W.coverage_level(F.lit(1), F.lit(2), F.lit(True), F.lit(1)).alias("c"), W.chain_summary(F.array(*map(F.lit, "abcd"))).alias("s")).first()
    assert (r["w"], r["d"], r["c"], r["s"]) == (["a"], True, "PARTIAL", "a; b; c")
    calls = spark.createDataFrame([(0, None), (1, "s2"), (2, "s1"), (3, "s2")], "ord bigint, seed_id string")
    assert [r["tab"] for r in W.grouped_calls(calls).orderBy("first").collect()] == ["All", "Recon", "s2", "s1"]
    perms = spark.createDataFrame([("p", ["e1"], 0.5, 0), ("p", ["e2"], 0.5, 1), ("p", ["e4"], 0.9, 3), ("q", ["e3"], 0.1, 2)], "permission string, evidence array<string>, confidence double, ord int")
    assert rows(W.permissions(perms), "permission", "evidence") == [("p", ["e1", "e4"]), ("q", ["e3"])]
