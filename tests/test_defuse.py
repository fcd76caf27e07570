import pytest
from callatlas.operators import defuse as D
from callatlas.operators import threads
from pyspark.sql import functions as F

THREAD, RUNNABLE = "java.lang.Thread", "java.lang.Runnable"
INIT = "specialinvoke $t.<java.lang.Thread: void <init>(java.lang.Runnable)>({})"
START = "virtualinvoke $t.<java.lang.Thread: void start()>()"
POST = "virtualinvoke $h.<android.os.Handler: boolean post(java.lang.Runnable)>({})"
CLICK = "virtualinvoke $v.<android.view.View: void setOnClickListener(android.view.View$OnClickListener)>({})"
SEND = "virtualinvoke $h.<android.os.Handler: boolean sendMessageDelayed(android.os.Message,long)>($m, 5L)"
OBTAIN = "$m = staticinvoke <android.os.Message: android.os.Message obtain(android.os.Handler,java.lang.Runnable)>($h, $r)"
SUBMIT = "interfaceinvoke $e.<java.util.concurrent.ExecutorService: java.util.concurrent.Future submit(java.lang.Runnable)>({})"
RECEIVE = "virtualinvoke r0.<android.content.Context: android.content.Intent registerReceiver(android.content.BroadcastReceiver,android.content.IntentFilter)>($l, $f)"
MAIN, PLAIN, AWAY = "<com.app.Main: void go(com.app.Job)>", "<com.app.Plain: void go()>", "<org.lone.Away: void go()>"
FIELD = "<com.app.Main: java.lang.Thread w>"
TAP = "void onClick(android.view.View)"
#: class: parent, all supertypes, methods.
CLASSES = {
    "com.app.Worker": (THREAD, (THREAD, RUNNABLE), ("void run()",)),
    "com.app.Sub": ("com.app.Worker", ("com.app.Worker", THREAD, RUNNABLE), ()),
    "com.app.Bare": (THREAD, (THREAD, RUNNABLE), ()),
    "com.app.Job": ("java.lang.Object", (RUNNABLE,), ("void run()",)),
    "com.app.Base": ("java.lang.Object", (RUNNABLE,), ("abstract void run()",)),
    "com.app.Main$1": ("java.lang.Object", (RUNNABLE,), ("void run()",)),
    "com.app.Main$1$2": ("java.lang.Object", (RUNNABLE,), ("void run()",)),
    "com.other.Far": ("java.lang.Object", (RUNNABLE,), ("void run()",)),
    "com.app.Tap": ("java.lang.Object", ("android.view.View$OnClickListener",), (TAP,)),
    "com.app.SubTap": ("com.app.Tap", ("com.app.Tap", "android.view.View$OnClickListener"), ()),
    "com.app.Main$Tap": ("java.lang.Object", ("android.view.View$OnClickListener",), (TAP,)),
    "com.app.Rec": ("android.content.BroadcastReceiver", ("android.content.BroadcastReceiver",), ("void onReceive(android.content.Context,android.content.Intent)",)),
}


def units_of(spark, cases):
    """Each case is an analysis of its own: name -> method -> statements."""
    rows = [(a, m, k, s) for a, bodies in cases.items() for m, stmts in bodies.items() for k, s in enumerate(stmts)]
    return spark.createDataFrame(rows, "analysis_id string, method string, idx int, stmt string").repartition(3)


def app(spark, names, classes=CLASSES):
    hierarchy = [(a, c, s) for a in names for c, (_, ups, _) in classes.items() for s in ups]
    methods = [(a, c, m.removeprefix("abstract "), not m.startswith("abstract ")) for a in names for c, (_, _, ms) in classes.items() for m in ms]
    parents = [(a, c, p) for a in names for c, (p, _, _) in classes.items()]
    return (spark.createDataFrame(hierarchy, "analysis_id string, class string, supertype string"), spark.createDataFrame(methods, "analysis_id string, class string, name string, concrete boolean"),
            spark.createDataFrame(parents, "analysis_id string, class string, parent string"))


def edges_by_case(found, cases):
    out = {name: [] for name in cases}
    for r in found.collect():
        out[r["analysis_id"]].append((r["callee"].split(":")[0][1:], r["pattern"], r["confidence"]))
    return {k: sorted(v) for k, v in out.items()}


def test_statements_are_read(spark):
    units = units_of(spark, {"a": {"m": ["r0 := @this: com.app.Main", "$i = 5", "$t = new com.app.Worker", "specialinvoke $t.<com.app.Worker: void <init>(java.lang.String,java.lang.Runnable)>(\"a, \\\"b\", r1)", "$r = (java.lang.Runnable) $t", "r0.<com.app.Main: java.lang.Thread w> = $t", "$x = staticinvoke <com.app.X: int f()>()", "if $i == 0 goto return", "return"]}})
    assert [(r["idx"], r["local"], r["value"]) for r in D.definitions(units).orderBy("idx").collect()] == [(0, "r0", "@this: com.app.Main"), (1, "$i", "5"), (2, "$t", "new com.app.Worker"), (4, "$r", "(java.lang.Runnable) $t"), (6, "$x", "staticinvoke <com.app.X: int f()>()")]
    assert [(r["idx"], r["kind"], r["base"], r["args"]) for r in D.invocations(units).orderBy("idx").collect()] == [(3, "special", "$t", ['"a, \\"b"', "r1"]), (6, "static", None, [])]
    values = ["new a.B", "(a.B) $r", "$r.<a.B: c.D f>", "<a.B: c.D f>", "virtualinvoke $r.<a.B: c.D f(int)>($i)", "@this: a.B", "@parameter0: a.B", "$r", "null", "5"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", D.type_of(F.col("v")).alias("t"), D.is_local(F.col("v")).alias("l"), D.field_of(F.col("v")).alias("f")).collect()
    assert [(r["t"], r["l"], r["f"]) for r in rows] == [("a.B", False, None), ("a.B", False, None), ("c.D", False, "<a.B: c.D f>"), ("c.D", False, "<a.B: c.D f>"), ("c.D", False, None), ("a.B", False, None), ("a.B", False, None), (None, True, None), (None, False, None), (None, False, None)]


def test_the_last_definition_before_the_use_counts_within_the_steps(spark):
    chain = lambda n: ["$x0 = new c.One", *[f"$x{k} = $x{k - 1}" for k in range(1, n)], "use"]
    bodies = {
        "two": ["$a = new c.One", "$a = new c.Two", "$b = $a", "use", "$a = new c.Three", "$b = (c.X) $a"], "circle": ["$a = $b", "$b = $a", "use", "$z = 1"],
        "five": chain(6), "six": chain(7), "casts": ["$a = new c.One", "$b = (c.P) $a", "$c = (c.P) $b", "$d = (c.P) $c", "use"]}
    asked = {"two": "$a $b $none", "circle": "$a", "five": "$x5", "six": "$x6", "casts": "$d"}
    units = units_of(spark, {"a": bodies})
    ask = F.create_map(*(F.lit(x) for kv in asked.items() for x in kv))[F.col("method")]
    uses = units.where("stmt = 'use'").select("analysis_id", "method", "idx", F.explode(F.split(ask, " ")).alias("asked")).withColumn("value", F.col("asked"))
    got = {(r["method"], r["asked"]): r["value"] for r in D.resolved(uses, D.definitions(units), "value").collect()}
    assert got.pop(("circle", "$a")) in ("$a", "$b")
    assert got == {("two", "$a"): "new c.Two", ("two", "$b"): "new c.Two", ("two", "$none"): "$none", ("five", "$x5"): "new c.One", ("six", "$x6"): "$x0", ("casts", "$d"): "$a"}


use = ["r0 := @this: com.app.Main", f"$t = r0.{FIELD}", START]
store = lambda c: ["r0 := @this: com.app.Main", f"$n = new {c}", "$m = $n", f"r0.{FIELD} = $m"]
job = ["$r = new com.app.Job", "$t = new java.lang.Thread", INIT.format("$r")]
inner = [("com.app.Main$1", "handler_post", "low"), ("com.app.Main$1$2", "handler_post", "low")]
#: case: bodies, edges.
CASES = {
    "new": ({MAIN: ["$t = new com.app.Worker", "specialinvoke $t.<com.app.Worker: void <init>()>()", START]}, [("com.app.Worker", "thread_start", "high")]),
    "inherited run": ({MAIN: ["$w = new com.app.Sub", "$u = (java.lang.Thread) $w", "$t = $u", START]}, [("com.app.Worker", "thread_start", "high")]),
    "declared": ({MAIN: ["$t = virtualinvoke r0.<com.app.Main: com.app.Sub make()>()", "virtualinvoke $t.<com.app.Sub: void start()>()"]}, [("com.app.Worker", "thread_start", "low")]),
    "no run": ({MAIN: ["$t = new com.app.Bare", START]}, []),
    "no thread": ({MAIN: ["$t = new com.app.Job", "virtualinvoke $t.<com.app.Job: void start()>()"]}, []),
    "field": ({MAIN: use, "<com.app.Main: void onCreate(android.os.Bundle)>": store("com.app.Worker")}, [("com.app.Worker", "thread_start", "medium")]),
    "field set elsewhere": ({MAIN: use, "<com.app.Main: void later()>": store("com.app.Worker")}, []),
    "field of no thread": ({MAIN: use, "<com.app.Main: void <init>()>": store("com.app.Job")}, []),
    "runnable": ({MAIN: [*job, START]}, [("com.app.Job", "thread_runnable", "high")]),
    "runnable of the copied": ({MAIN: ["$r = new com.app.Job", "$s = new java.lang.Thread", INIT.format("$r").replace("$t", "$s"), "$t = $s", START]}, [("com.app.Job", "thread_runnable", "high")]),
    "runnable by type": ({MAIN: ["r1 := @parameter0: com.app.Job", "$t = new java.lang.Thread", INIT.format("r1"), START]}, [("com.app.Job", "thread_runnable", "medium")]),
    "own run first": ({MAIN: ["$r = new com.app.Job", "$t = new com.app.Worker", "specialinvoke $t.<com.app.Worker: void <init>(java.lang.Runnable)>($r)", START]}, [("com.app.Worker", "thread_start", "high")]),
    "constructed too late": ({MAIN: ["$t = new java.lang.Thread", START, "$r = new com.app.Job", INIT.format("$r")]}, []),
    "runnable by its value": ({MAIN: ["$r = new com.app.Job", "$t = new com.app.Bare", 'specialinvoke $t.<com.app.Bare: void <init>(java.lang.String,java.lang.Object)>("a, b", $r)', START]}, [("com.app.Job", "thread_runnable", "high")]),
    "post": ({MAIN: ["$r = new com.app.Job", POST.format("$r")]}, [("com.app.Job", "handler_post", "high")]),
    "abstract": ({MAIN: ["$r = new com.app.Base", POST.format("$r")]}, inner),
    "submit": ({MAIN: ["r1 := @parameter0: com.app.Job", SUBMIT.format("r1")]}, [("com.app.Job", "executor_execute", "medium")]),
    "message": ({MAIN: ["$r = new com.app.Job", OBTAIN, SEND]}, [("com.app.Job", "handler_message", "high")]),
    "message without work": ({MAIN: ["$m = staticinvoke <android.os.Message: android.os.Message obtain()>()", SEND]}, []),
    "unknown within": ({MAIN: [POST.format("$r")]}, inner),
    "unknown beside": ({PLAIN: [POST.format("$r")]}, [(c, "handler_post", "low") for c in ("com.app.Job", "com.app.Main$1", "com.app.Main$1$2", "com.app.Sub", "com.app.Worker")]),
    "unknown alone": ({AWAY: [POST.format("$r")]}, []),
}


def test_what_runs_is_found(spark):
    units = units_of(spark, {k: bodies for k, (bodies, _) in CASES.items()})
    got = edges_by_case(D.found_threading_edges(units, *app(spark, CASES)).where(~F.col("caller").contains("onCreate")), CASES)
    want = {k: sorted(e) for k, (_, e) in CASES.items()}
    want["unknown beside"] = sorted((("com.app.Worker" if c == "com.app.Sub" else c), p, x) for c, p, x in want["unknown beside"])
    want["unknown beside"] = sorted(set(want["unknown beside"]))  # a class that inherits run() gives the same edge
    assert got == want


@pytest.mark.parametrize("most, expected", [(1, 1), (20, 20)])
def test_fallback_is_cut(spark, most, expected):
    many = CLASSES | {f"com.app.N{k:02d}": ("java.lang.Object", (RUNNABLE,), ("void run()",)) for k in range(40)}
    got = D.found_threading_edges(units_of(spark, {"a": {PLAIN: [POST.format("$r")]}}), *app(spark, ["a"], many), most)
    assert threads.FALLBACK == 20 and got.count() == expected


def test_all_that_stand_in_are_found(spark):
    """More than any bound, each once: of a package, whose classes also inherit run(), and of a class; repeated calls count once."""
    named = {f"com.app.N{k:02d}": ("java.lang.Object", (RUNNABLE,), ("void run()",)) for k in range(40)}
    heirs = {f"com.app.H{k:02d}": (f"com.app.N{k:02d}", (f"com.app.N{k:02d}", RUNNABLE), ()) for k in range(40)}
    within = {f"com.app.Main${k}": ("java.lang.Object", (RUNNABLE,), ("void run()",)) for k in range(1, 31)}
    units = units_of(spark, {"a": {PLAIN: [POST.format("$r"), POST.format("$r")], MAIN: [POST.format("$r")]}})
    got = D.found_threading_edges(units, *app(spark, ["a"], named | heirs | within))
    want = [(PLAIN, c) for c in (*named, *within)] + [(MAIN, c) for c in within]
    assert sorted((r["caller"], r["callee"]) for r in got.collect()) == sorted((m, f"<{c}: void run()>") for m, c in want)
    assert {(r["pattern"], r["confidence"], r["edge_source"]) for r in got.collect()} == {("handler_post", "low", "threading_synthetic")}


def test_listeners(spark):
    cases = {
        "new": ({MAIN: ["$l = new com.app.SubTap", CLICK.format("$l")]}, [("com.app.Tap", "setOnClickListener", "high")]),
        "typed": ({MAIN: ["$l = r0.<com.app.Main: com.app.Tap tap>", CLICK.format("$l")]}, [("com.app.Tap", "setOnClickListener", "medium")]),
        "no listener": ({MAIN: ["$l = new com.app.Job", CLICK.format("$l")]}, [("com.app.Main$Tap", "setOnClickListener", "low")]),
        "unknown": ({PLAIN: [CLICK.format("$l")]}, [("com.app.Main$Tap", "setOnClickListener", "low"), ("com.app.Tap", "setOnClickListener", "low")]),
        "receiver": ({MAIN: ["$l = new com.app.Rec", RECEIVE]}, [("com.app.Rec", "registerReceiver", "high")]),
        "other parameters": ({MAIN: ["$l = new com.app.Rec", RECEIVE.replace("android.content.BroadcastReceiver,", "java.lang.Object,")]}, []),
    }
    found = D.found_listener_edges(units_of(spark, {k: b for k, (b, _) in cases.items()}), *app(spark, cases))
    assert edges_by_case(found, cases) == {k: e for k, (_, e) in cases.items()}
    assert {(r["edge_source"], r["edge_layer"]) for r in found.collect()} == {("listener_registration_synthetic", "synthetic")}


def test_found_edges_bridge_their_starts(spark):
    """A start without an edge to a run() on its call site is missing one; the edge that is found closes the gap."""
    hierarchy, methods, parents = app(spark, ["a"])
    call = spark.createDataFrame([("a", MAIN, "<java.lang.Thread: void start()>", START, "soot_cg", "strict")], "analysis_id string, caller string, callee string, callsite string, edge_source string, edge_layer string")
    found = D.found_threading_edges(units_of(spark, {"a": {MAIN: ["$t = new com.app.Worker", START]}}), hierarchy, methods, parents)
    both = call.unionByName(found.withColumn("edge_layer", F.lit("synthetic")).select(*call.columns))
    assert threads.missing_runs(call, hierarchy).count() == 1 and threads.missing_runs(both, hierarchy).count() == 0
    counts = threads.validation(both, hierarchy).first()
    assert (counts["n_starts"], counts["n_synthetic"], counts["n_missing"]) == (1, 1, 0)


def test_empty(spark):
    units = units_of(spark, {"a": {MAIN: ["return"]}}).limit(0)
    assert D.found_threading_edges(units, *app(spark, ["a"])).collect() == [] and D.found_listener_edges(units, *app(spark, ["a"])).collect() == []
