"""Plans whose rows, or shuffles, grew faster than the input."""

from callatlas.operators import cases, components, defuse, grounding, handoffs, hits, threads, triage


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hierarchy_joins_by_class(spark):
    e = spark.createDataFrame([("x", 1, "<m.M: void m()>", "<a.B: void call(int)>"), ("x", 2, "<m.M: void m()>", "<a.C: void call(int)>")], "analysis_id string, ord bigint, caller string, callee string")
    c = spark.createDataFrame([("K", f"<p.P{n}: void call(int)>", "HIGH", 1.0) for n in range(50)], "category_id string, signature string, priority string, weight double")
    found = hits.hierarchy_matches(e, c, spark.createDataFrame([("a.B", "p.P7")], "class string, supertype string"))
    assert [(r.callee, r.signature, r.match_type) for r in found.collect()] == [("<a.B: void call(int)>", "<p.P7: void call(int)>", "hierarchy")]
    joins = [line for line in _plan(found).splitlines() if "Join Inner" in line and "m#" in line]
    assert joins and all("callee_class#" in line for line in joins)


def test_values_shuffle_once(spark):
    d = spark.createDataFrame([("m", 1, "v1", "new T"), ("m", 2, "v2", "(a.B) v1"), ("m", 4, "v1", None), ("m", 6, "v3", "v2"), ("m", None, "v9", "new N"), (None, 1, "v1", "new M")], "method string, idx bigint, local string, value string")
    u = spark.createDataFrame([("m", 7, "v3"), ("m", 3, "v1"), ("m", 5, "v1"), ("m", 7, "v9"), ("m", 0, "v1"), (None, 2, "v1"), ("m", 3, "v1")], "method string, idx bigint, value string")
    found = triage.resolve_values(u, d)
    # v3 at 7 leads to v1, whose last definition before 7 is null: what is there stays
    assert sorted(((r.method, r.idx, r.resolved) for r in found.collect()), key=str) == sorted([("m", 7, "v1"), ("m", 3, "new T"), ("m", 3, "new T"), ("m", 5, "v1"), ("m", 7, "v9"), ("m", 0, "v1"), (None, 2, "v1")], key=str)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") + plan.count("Repartition") <= 1


def test_entrypoints_repeat_behind_the_shuffle(spark):
    m = spark.createDataFrame([("x", "<a.A: void onCreate()>"), ("x", "<a.A: void onCreate()>"), ("x", "<a.A: void helper()>"), ("x", "<a.B: void onCreate()>")], "analysis_id string, method string")
    base = next(b for b, names in components.BASE_METHODS.items() if "onCreate" in names)
    found = components.inherited_entrypoints(m, spark.createDataFrame([("a.A", base), ("a.A", base)], "class string, supertype string"))
    assert [r.method for r in found.collect()] == ["<a.A: void onCreate()>"]
    plan = _plan(found)
    assert plan.splitlines()[0].startswith("Aggregate") and "Repartition" in plan.splitlines()[1] and plan.count("Aggregate") == 1


def test_words_of_a_claim_are_compared_with_what_is_computed_once(spark):
    f = spark.createDataFrame([("s", 1, "records the microphone", ["u"])], "seed_id string, idx bigint, fact string, support_unit_ids array<string>")
    u = spark.createDataFrame([("s", "u", "virtualinvoke $m.<q.P: void setAudioSource(int)>(1)")], "seed_id string, unit_id string, stmt string")
    found = grounding.grounding_faults(f, u, spark.createDataFrame([], "seed_id string, ord int, text string"))
    assert [(r.place, r.severity) for r in found.collect()] == [(0, "info")]
    assert _plan(found).count("regexp_extract_all(") < 20


def test_coverage_is_one_sum(spark):
    unit = "seed_id string, unit_id string"
    calls = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("a", None), ("b", "1")], unit)
    claims = spark.createDataFrame([("a", "1", "effect"), ("a", "2", "input"), ("a", None, "effect"), ("c", "1", "effect")], unit + ", claim_type string")
    ambiguous, lookups = spark.createDataFrame([("b", "1"), ("b", "1"), ("d", "4")], unit), spark.createDataFrame([("b", "1"), ("e", "1")], unit)
    found = handoffs.claim_coverage(calls, claims, ambiguous, lookups, spark.createDataFrame([("b", "1")], unit))
    assert sorted((r.seed_id, r.n_calls, r.n_claimed, r.n_ambiguous, r.n_looked_up, r.unresolved_ratio, r.status) for r in found.collect()) == [("a", 4, 1, 0, 0, 0.0, "partial"), ("b", 1, 0, 1, 1, 0.5, "failed"), ("d", 0, 0, 1, 0, 0.0, "ok")]
    assert "Join" not in _plan(found)


def test_members_of_cases_are_found_once(spark):
    c = spark.createDataFrame([("c1", 1, 2, ["h1"], ["g1"]), ("c2", 2, 1, ["h1"], ["g2"])], "case_id string, ord int, priority int, evidence_hit_ids array<string>, evidence_group_ids array<string>")
    g = spark.createDataFrame([("g1", 1, ["h2"]), ("g2", 2, ["h2", "h3"])], "group_id string, ord int, hit_ids array<string>")
    found = cases.call_sites(c, g, spark.createDataFrame([("h1",), ("h2",), ("h3",)], "hit_id string"))
    assert sorted((r.hit_id, r.case_id, r.total_case_hits, r.group_id) for r in found.collect()) == [("h1", "c1", 2, None), ("h2", "c1", 2, "g2"), ("h3", "c2", 3, "g2")]
    assert "posexplode" not in _plan(found)


def test_calls_that_hand_on_work_go_through_once(spark):
    call = "analysis_id string, caller string, callsite string, pattern string, thread_new string, thread_field string, thread_type string, work_new string, work_type string"
    rows = [("x", "<a.A: void m()>", str(k), "handler_post", None, None, None, w, None) for k, w in enumerate(("a.R", None, "gone"))] + [("x", "<a.A: void m()>", "9", "thread_start", None, None, "a.T", None, None), ("x", "<Bare: void m()>", "8", "handler_post", None, None, None, None, None)]
    calls = spark.createDataFrame(rows, call).where("callsite <> 'marked'")
    runs = spark.createDataFrame([("x", c, f"{c}.run") for c in ("a.R", "a.T", "a.B")], "analysis_id string, class string, run string")
    found = threads.threading_edges(calls, runs, spark.createDataFrame([("x", "a.B"), ("x", "a.R")], "analysis_id string, class string"), 2)
    low = [(k, c, "handler_post", "low") for k in ("1", "2") for c in ("a.B.run", "a.R.run")]
    assert sorted((r.callsite, r.callee, r.pattern, r.confidence) for r in found.collect()) == [("0", "a.R.run", "handler_post", "high"), *low, ("9", "a.T.run", "thread_start", "low")]
    assert sum("Filter" in line and "= marked" in line for line in _plan(found).splitlines()) == 1


def test_bodies_are_read_shuffled_and_sorted_once(spark):
    unit = "analysis_id string, method string, idx int, stmt string"
    start = "virtualinvoke {}.<java.lang.Thread: void start()>()"
    body = ["$r = new a.R", "$t = new java.lang.Thread", "specialinvoke $t.<java.lang.Thread: void <init>(java.lang.Runnable)>($r)", "$u = $t", start.format("$u"), "$r = new a.Q", start.format("$w")]
    units = spark.createDataFrame([("x", f"<a.A: void {m}()>", k, s) for m in "mn" for k, s in enumerate(body)] + [(None, None, None, "$r = new a.N"), ("x", "<a.A: void m()>", None, start.format("$t"))], unit).where("stmt <> 'marked'")
    able = spark.createDataFrame([("x", "a.R", False)], "analysis_id string, class string, thread boolean")
    read = defuse.walked(defuse._read(units, able))
    # what runs was given at the constructor and is read at the start; a start without a place is none
    want = [(start.format("$u"), "new java.lang.Thread", "$t", "new a.R"), (start.format("$w"), "$w", None, None)]
    assert sorted(tuple(map(str, (r.use.stmt, r.value, r["first"], r.work))) for r in read.collect()) == sorted(tuple(map(str, w)) for w in want * 2)
    plan = read._jdf.queryExecution().sparkPlan().toString()
    assert sum("Filter" in line and "= marked" in line for line in _plan(read).splitlines()) == 1 and plan.count("Exchange") + plan.count("Repartition") == 1
    uses = spark.createDataFrame([("x", "m", 2, "$b"), ("x", "m", None, "$b"), ("x", "m", 1, None), (None, "m", 3, "(c.C) $b")], "analysis_id string, method string, idx int, value string")
    defs = spark.createDataFrame([("x", "m", 2, "$b", "(c.B) $a"), ("x", "m", 1, "$a", "new c.One"), ("x", "m", 3, "$a", "new c.Two"), (None, "m", 0, "$b", "5")], "analysis_id string, method string, idx int, local string, value string")
    found = defuse.resolved(uses, defs, "value")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("x", "m", 2, "new c.One"), ("x", "m", None, "$b"), ("x", "m", 1, None), (None, "m", 3, "5")], key=str)
    assert "FileScan" not in found._jdf.queryExecution().sparkPlan().toString() and found.columns == uses.columns
