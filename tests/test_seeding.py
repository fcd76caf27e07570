import hashlib

from callatlas.operators import seeding

SIG = {"send": "<t.Sms: void send(int)>", "go": "<t.A: void go()>", "read": "<t.Id: int read()>"}


def made(spark, calls, remote, local):
    catalog = spark.createDataFrame([(SIG["send"], "OLD", 0), (SIG["send"], "SMS", 1), (SIG["go"], "GO", 2), (SIG["read"], "ID", 3)], "signature string, category string, ord int")
    c = spark.createDataFrame(calls, "analysis_id string, caller string, callee string, offset int")
    h = lambda rows: spark.createDataFrame([(a, m, f, k) for k, (a, m, f) in enumerate(rows)], "analysis_id string, method_name string, file_path string, ord int")
    found = seeding.seeds(c, h(remote), h(local), catalog).collect()
    for r in found:
        origin = r["caller_method"] if r["source"] == "calls" else r["signature"].split("(")[0].split(" ")[-1]
        assert r["seed_id"] == hashlib.sha1(f"{origin}|{r['signature']}|{r['place']}".encode()).hexdigest()
    return [tuple(r)[:1] + tuple(r)[2:] for r in found]


def test_each_analysis_has_its_surest_source(spark):
    calls = [("a", "<p.Q: void m()>", SIG["send"], 7), ("a", "<p.Q: void m()>", "<x.Y: void none()>", 8), ("b", "<p.Q: void m()>", "<x.Y: void none()>", 1)]
    remote = [("a", "send", "A.java"), ("b", "send", "B.java"), ("b", "go", "short.java"), ("c", "none", "C.java")]
    local = [("a", "read", "a.java"), ("b", "read", "b.java"), ("c", "read", None), ("d", "go", "d.java")]
    assert sorted(made(spark, calls, remote, local), key=str) == [
        ("a", "calls", "SMS", SIG["send"], "<p.Q: void m()>", "p.Q", "7", 1.0), ("b", "remote", "SMS", SIG["send"], "B.java", "UNKNOWN", "B.java", 0.4), ("c", "local", "ID", SIG["read"], "UNKNOWN", "UNKNOWN", None, 0.3)]


def test_searches_are_cut_by_name(spark):
    remote = [("b", m, f"{m}{k}.java") for k in range(30) for m in ("send", "read")]
    got = made(spark, [], remote, [])
    assert sorted(r[4] for r in got) == sorted(f"{m}{k}.java" for m in ("send", "read") for k in range(10))
    assert made(spark, [], [], []) == []
