import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

from callatlas.functions import bodies as B
from callatlas.functions import constants as K
from callatlas.operators import lookups as U
from callatlas.sources import archives
from callatlas.sources.remote import RemoteAnalyses
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_constants_get_names(spark):
    s = spark.createDataFrame([("virtualinvoke $r1.<android.media.MediaRecorder: void setAudioSource(int)>(1)",), ("virtualinvoke $r1.<a.B: void startForeground(int,int)>(7, 8)",), ("virtualinvoke $r1.<a.B: void setFlags(int)>(5)",), ("x = 1",)], "stmt string")
    got = K.annotate(s).select("annotated", "annotation.semantic", "annotation.enum_type").collect()
    assert [tuple(r)[1:] for r in got] == [("MIC", "AudioSource"), ("FOREGROUND_SERVICE_TYPE_LOCATION", "ForegroundServiceType"), (None, None), (None, None)]
    assert got[1]["annotated"].endswith("(7, 8 /* FOREGROUND_SERVICE_TYPE_LOCATION */)") and got[3]["annotated"] == "x = 1"
    t = spark.range(1).select(K.numeric_constants(F.lit("f(2038) x = 8; g(-3)")).alias("n"), K.semantic_tokens(F.lit("getDeviceId f(2038)")).alias("s")).first()
    assert list(t["n"]) == ["2038", "8", "-3"] and list(t["s"]) == ["application_overlay", "device_id", "deviceid", "imei", "type_application_overlay"]


def test_method_bodies(spark):
    source = "class A {\n  public void run(int x) {\n    if (x > 0) { go(); }\n  }\n  static class B {\n    int run() { return 1; }\n  }\n  void other() { run(1); }\n}\n"
    assert B.method_body(source, "run") == "  public void run(int x) {\n    if (x > 0) { go(); }\n  }"
    assert B.method_body(source, "run", "B") == "    int run() { return 1; }" and B.method_body(source, "none") is None and B.method_body(None, "run") is None
    assert B.method_body("void m() {\n" + "x;\n" * 300 + "}", "m").count("\n") == 100
    m = spark.createDataFrame([("m1", "p.A$B", "run"), ("m2", "q.Q", "run")], "method string, class string, short string")
    got = B.method_sources(m, spark.createDataFrame([("p.A", source)], "class_name string, text string"))
    assert rows(got, "method", "source") == [("m1", "    int run() { return 1; }"), ("m2", None)]
    u = spark.createDataFrame([("m", 1, "$a.<p.F: int f> = 1"), ("m", 0, "staticinvoke <p.Q: void s()>()"), ("m", 2, "return")], "method string, idx int, stmt string")
    r = B.ir_summary(u, 2).first()
    assert (list(r["invoked_methods"]), list(r["field_accesses"]), r["unit_count"], r["truncated"]) == (["p.Q: void s()"], ["$a.<p.F: int f> = 1"], 3, True)
    assert spark.range(1).select(B.lookup_strategy(F.lit(True), F.lit(False)).alias("s")).first()["s"] == "jadx"
    two = u.withColumn("analysis_id", F.explode(F.array(F.lit("a"), F.lit("b")))).where("analysis_id = 'a' or idx = 0")
    assert {r["analysis_id"]: r["unit_count"] for r in B.ir_summary(two, 2).collect()} == {"a": 3, "b": 1}


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("classes.dex", b"\x00\x01hello world\x02abc\xff")
        z.writestr("META-INF/CERT.RSA", b"sig")
        z.writestr("res/x", b"nothing here")
    (tmp_path / "a.apk").write_bytes(data.getvalue())
    (tmp_path / "b.apk").write_bytes(b"broken")
    assert rows(archives.strings(spark, str(tmp_path)), "value") == [("hello world",)]
    assert rows(archives.certificates(spark, str(tmp_path)), "file", "size", "base64_prefix") == [("META-INF/CERT.RSA", 3, "c2ln")]


def test_remote_source(spark):
    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"at": self.path}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(RemoteAnalyses)
    df = spark.read.format("remote_analyses").option("url", f"http://127.0.0.1:{server.server_port}").option("apps", "a,b").option("parts", "manifest").load()
    assert rows(df, "analysis_id", "part", "document") == [("a", "manifest", '{"at": "/a/manifest"}'), ("b", "manifest", '{"at": "/b/manifest"}')]
    server.shutdown()


def test_listings_and_contexts(spark):
    g = spark.createDataFrame([(k, "x", f"grp-{k:040d}", ["A"] if k % 2 else ["B"], ["S"] if k == 4 else None) for k in range(30)], "ord int, analysis_id string, group_id string, categories array<string>, string_categories array<string>")
    assert U.listing(g).count() == 20 and U.listing(g, "bad").count() == 20 and U.listing(g, 3).count() == 3
    assert rows(U.listing(g, 2, category="S"), "ord") == [(4,)] and U.first_each(g, "analysis_id", ["ord"], 5).count() == 5
    assert U.fallback_cases(g).where("place = 1").first()["case_id"] == "CASE-GRP-00000000"
    r = spark.createDataFrame([("<sms.S>",), ("<loc.L>",)], "signature string")
    assert rows(U.rule_subset(r, spark.createDataFrame([("SMS",)], "keyword string")), "signature") == [("<sms.S>",)]
    m = spark.createDataFrame([("x", ["p2", "p1", "p1"], [U.BOOT_ACTIONS[0]])], "analysis_id string, permissions array<string>, actions array<string>")
    s = spark.createDataFrame([("x", k, f"v{k}") for k in range(5)], "analysis_id string, ord int, value string")
    c = U.static_context(m, s, 2).first()
    assert (list(c["permissions"]), c["starts_at_boot"], list(c["strings"])) == (["p1", "p2"], True, ["v0", "v1"])
    seeds = spark.createDataFrame([("1", "a.A"), ("2", "a.B$1"), ("3", "z.Z")], "seed_id string, class string")
    h = U.component_hints(seeds, spark.createDataFrame([("1", "a.Main")], "seed_id string, component string"), spark.createDataFrame([("a.B", 0)], "name string, ord int"))
    assert rows(h, "seed_id", "component", "confidence") == [("1", "a.Main", 0.95), ("2", "a.B", 0.8), ("3", "z.Z", 0.3)]
    old, new = spark.createDataFrame([("r1", 1), ("r2", 1)], "run_id string, n int"), spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 1)], "run_id string, n int")
    assert rows(U.changed_runs(old, new), "run_id") == [("r2",), ("r3",)]
    v = U.violations(new, ("n is 1", F.col("n") == 1), ("named", F.col("run_id").isNotNull()))
    assert rows(v, "run_id", "errors") == [("r2", "n is 1")]
    k = spark.range(1).select(U.bundle_key(F.lit("C"), F.lit("m"), F.lit("s")).alias("a"), U.bundle_key(F.lit(None).cast("string"), F.lit("m"), F.lit("s")).alias("b")).first()
    assert tuple(k) == ("CASE:C:m", "SINGLE:s")
