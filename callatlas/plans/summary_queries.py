"""Registered queries of summaries, cases, threads and what belongs to the application, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hints as H
from ..functions import text as X
from ..operators import appcode, cases, components as C, evidence, summary, threads, triage
from ..sources import ingest
from . import adapters as A
from . import graph
from .durable import checkpointed
from .queries import day_patterns, joined, query


def _groups(t) -> DataFrame:
    """A user's days as groups of an application: the month is the package, event types are categories; clicks are found in
    texts, the rest in calls. Two days of three have a path, from an entrypoint of their month."""
    day = F.to_date("ts").cast("string")
    rows = t.events.groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("analysis_id"), day.alias("group_id")).agg(F.min("event_id").alias("ord"), F.collect_set("event_type").alias("c"))
    month, number = F.substring("group_id", 1, 7), F.substring("group_id", 9, 2).cast("int")
    return rows.select("analysis_id", "ord", "group_id", F.concat(F.lit("m"), month, F.lit(".D"), F.col("group_id")).alias("caller_class"), F.concat(F.lit("<m"), month, F.lit(".D"), F.col("group_id"), F.lit(": void run()>")).alias("caller"),
                       F.filter("c", lambda x: x != "click").alias("categories"), F.filter("c", lambda x: x == "click").alias("string_categories"), (number % 3 > 0).alias("reachable"),
                       F.array(F.concat(F.lit("e"), month), F.col("group_id")).alias("example_path"), F.when(number % 4 > 0, number % 5).alias("path_len"))


@query
def app_patterns(t) -> DataFrame:
    rows = summary.app_patterns(_groups(t), day_patterns(t.spark))
    return rows.select("analysis_id", "n_groups", joined("categories").alias("categories"), joined("patterns.pattern_id").alias("patterns"))


@query
def app_pattern_examples(t) -> DataFrame:
    return summary.pattern_examples(summary.app_patterns(_groups(t), day_patterns(t.spark))).select("analysis_id", "pattern_id", "category", "group_id")


@query
def package_patterns(t) -> DataFrame:
    rows = summary.package_patterns(_groups(t), day_patterns(t.spark), 2)
    return rows.select("analysis_id", "package", "n_groups", joined("categories").alias("categories"), F.get("classes", F.lit(0)).alias("first_class"), F.col("place").cast("bigint").alias("place"))


@query
def entrypoint_patterns(t) -> DataFrame:
    g = _groups(t)
    reached = g.where("cast(substring(group_id, 9, 2) as int) % 7 = 0").select("analysis_id", F.col("caller").alias("method"), F.lit("root").alias("root"), F.array(F.lit("root"), "group_id").alias("path"), F.lit(1).alias("distance"))
    rows = summary.entrypoint_union(g, day_patterns(t.spark), reached)
    return rows.select("analysis_id", "entrypoint", "n_groups", joined("categories").alias("categories"), F.size("patterns").cast("bigint").alias("n_patterns"), F.get("example_path", F.lit(1)).alias("example"), F.col("shortest_path_len").cast("bigint").alias("shortest"))


@query
def pattern_level_summary(t) -> DataFrame:
    rows = summary.level_summary(_groups(t), day_patterns(t.spark))
    return rows.select("analysis_id", "n", "n_with_patterns", F.array_join(F.transform("counts", lambda c: F.concat_ws(":", c["pattern_id"], c["n"].cast("string"))), "|").alias("counts"))


def _blocks(t) -> DataFrame:
    """A customer's orders as blocks of an application."""
    prio = F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "HIGH").when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").otherwise("LOW")
    return t.orders.select(F.col("o_custkey").alias("analysis_id"), F.col("o_orderkey").alias("ord"), prio.alias("effective_priority"), (F.floor(F.col("o_totalprice") / 50000) / 10).alias("raw_score"), ((F.col("o_orderkey") % 4) / 10).alias("investigability"),
                           (F.col("o_orderstatus") != "F").alias("is_library"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("P"))).otherwise(F.array().cast("array<string>")).alias("patterns"))


@query
def block_places(t) -> DataFrame:
    return summary.block_order(summary.kept_blocks(_blocks(t))).select("analysis_id", F.col("ord").alias("o_orderkey"), F.col("place").cast("bigint").alias("place"))


@query
def inventory_preview(t) -> DataFrame:
    rows = t.lineitem.groupBy((F.col("l_suppkey") % 20).alias("analysis_id"), F.concat(F.lit("p"), F.col("l_partkey") % 200).alias("package")).agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("l_orderkey").alias("n_methods"))
    return summary.inventory_preview(rows, 3, 10).select("analysis_id", "package", F.col("place").cast("bigint").alias("place"))


@query
def callgraph_counts(t) -> DataFrame:
    e = A.edges(t).withColumn("analysis_id", F.concat(F.lit("n"), F.col("s_nationkey")))
    nodes = t.customer.select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("analysis_id"), F.col("c_custkey"))
    entries = e.where("l_suppkey % 2 = 0").select("analysis_id", F.col("caller").alias("method"))
    s = summary.callgraph_summary(nodes, e, entries, 2)
    return s.select("analysis_id", "n_nodes", "n_edges", F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["edge_source"], x["n"].cast("string"))), "|").alias("sources"), "n_entrypoints", joined("entrypoints").alias("entrypoints"))


@query
def class_kinds(t) -> DataFrame:
    """Suppliers of a nation are its classes; those divisible by 5 are components, brands of keys below 3 are ignored."""
    name = F.concat(F.lit("com.n"), F.col("s_nationkey") % 4, F.lit(".k"), F.col("s_suppkey") % 6, F.lit(".S"), F.col("s_suppkey"))
    rows = t.supplier.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("analysis_id"), F.col("s_suppkey"), name.alias("name"))
    parts = rows.where("s_suppkey % 5 = 0").select("analysis_id", "name")
    packages = t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("analysis_id"), F.lit("com.n2.k1").alias("package"))
    skip = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("analysis_id"), F.lit("com.n2.k1.*").alias("prefix"))
    classes = rows.select("analysis_id", "s_suppkey", F.concat("name", F.when(F.col("s_suppkey") % 2 == 0, "$1").otherwise("")).alias("class"))
    return appcode.class_kinds(classes, parts, appcode.app_prefixes(parts, packages), skip).select("s_suppkey", "kind")


@query
def app_neighbours(t) -> DataFrame:
    m = t.lineitem.groupBy("l_suppkey").agg(F.array_sort(F.collect_set(F.concat(F.when(F.col("l_partkey") % 3 == 0, "<java.P").when(F.col("l_partkey") % 3 == 1, "<my.app.kotlin.P").otherwise("<other.P"), F.col("l_partkey"), F.lit(": void m()>")))).alias("m"))
    return m.select("l_suppkey", joined(appcode.app_methods(F.col("m"), F.lit("my.app"), 5)).alias("methods"))


@query
def app_path_methods(t) -> DataFrame:
    cls = F.when(F.col("l_partkey") % 4 == 0, "java.P").when(F.col("l_partkey") % 4 == 1, "javaz.P").when(F.col("l_partkey") % 4 == 2, "dalvik.P").otherwise("a.java.P")
    paths = t.lineitem.groupBy((F.col("l_suppkey") % 5).alias("analysis_id"), "l_orderkey").agg(F.collect_list(F.concat(F.lit("<"), cls, F.col("l_partkey"), F.lit(": void m()>"))).alias("path"))
    return appcode.path_methods(paths).select("analysis_id", "method")


@query
def referenced_components(t) -> DataFrame:
    """Customers are seeds of their nation; odd nations name no component."""
    seeds = t.customer.select(F.col("c_nationkey").alias("analysis_id"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("S"), F.col("c_custkey"))).alias("component_name"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("<T"), F.col("c_custkey"), F.lit("$1: void m()>"))).otherwise("x").alias("caller"))
    rows = t.supplier.select(F.col("s_nationkey").alias("analysis_id"), F.col("s_suppkey").alias("ord"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "S").otherwise("T"), F.col("s_suppkey")).alias("component"))
    return appcode.referenced_components(seeds, rows, 3).select("analysis_id", "component")


def _cases(t) -> tuple[DataFrame, DataFrame]:
    """Customers as cases: their orders are groups, the parts of an order its hits; urgent orders' first parts are named too."""
    key = F.col("l_partkey").cast("string")
    groups = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", key.alias("p"))))["p"].alias("hit_ids")).select(F.col("l_orderkey").cast("string").alias("group_id"), F.col("l_orderkey").alias("ord"), "hit_ids")
    own = F.filter(F.array_sort(F.collect_list(F.when(F.col("o_orderpriority") == "1-URGENT", (F.col("o_orderkey") % 1000).cast("string")))), lambda x: x.isNotNull())
    rows = t.orders.groupBy("o_custkey").agg(own.alias("evidence_hit_ids"), F.array_sort(F.collect_list("o_orderkey")).cast("array<string>").alias("evidence_group_ids"))
    return rows.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("case_id"), F.col("o_custkey").alias("ord"), F.when(F.col("o_custkey") % 6 > 0, F.col("o_custkey") % 6).alias("priority"), "evidence_hit_ids", "evidence_group_ids"), checkpointed(groups)


@query
def case_sizes(t) -> DataFrame:
    return cases.members(*_cases(t)).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_hits"))


@query
def case_of_hit(t) -> DataFrame:
    return cases.case_of_hit(*_cases(t)).select("hit_id", "case_id", F.col("priority").cast("bigint").alias("priority"), "total_case_hits")


@query
def case_call_sites(t) -> DataFrame:
    hits = t.part.where("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("hit_id"), "p_type")
    return cases.call_sites(*_cases(t), hits).select("hit_id", "case_id", "group_id", "p_type")


@query
def case_group_ids(t) -> DataFrame:
    c, g = _cases(t)
    return cases.case_groups(c.where("ord % 2 = 0").withColumn("evidence_group_ids", F.slice("evidence_group_ids", 1, 1)), g)


@query
def bundle_priorities(t) -> DataFrame:
    bundles = t.part.select(F.col("p_partkey").cast("string").alias("seed_id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 3 == 0, F.col("p_size") % 7).alias("case_priority"))
    return cases.bundle_priority(bundles, *_cases(t)).select("seed_id", F.col("priority").cast("bigint").alias("priority"))


def _threads(t) -> tuple[DataFrame, DataFrame]:
    """Suppliers start, post to or run the work of parts; every third part is a thread, every fourth a runnable."""
    kind, p = F.col("l_partkey") % 5, F.col("l_partkey") % 50
    name = F.when(kind < 2, " void start()>").when(kind == 2, " void run()>").otherwise(" void begin()>")
    cls = F.when(F.col("l_partkey") % 7 == 0, "java.lang.Thread").otherwise(F.concat(F.lit("w.P"), p))
    e = t.lineitem.select(F.concat(F.lit("a"), F.col("l_suppkey") % 3).alias("analysis_id"), F.concat(F.lit("<s.S"), F.col("l_suppkey"), F.lit(": void m()>")).alias("caller"), F.concat(F.lit("<"), cls, F.lit(":"), name).alias("callee"),
                          F.when(F.col("l_linenumber") < 6, F.concat(F.lit("at "), F.col("l_orderkey") % 997, F.lit("/"), F.col("l_linenumber"))).alias("callsite"), F.when(F.col("l_returnflag") == "R", "threading_synthetic").otherwise("soot_cg").alias("edge_source"))
    n = F.col("id")
    h = t.spark.range(50).select(F.explode(F.array(*map(F.lit, ("a0", "a1", "a2")))).alias("analysis_id"), F.concat(F.lit("w.P"), n).alias("class"), F.when(n % 3 == 0, threads.THREAD).when(n % 4 == 0, threads.RUNNABLE).otherwise("java.lang.Object").alias("supertype"))
    return e, h


@query
def thread_validation(t) -> DataFrame:
    return threads.validation(*_threads(t))


@query
def thread_missing_runs(t) -> DataFrame:
    return threads.missing_runs(*_threads(t)).groupBy("analysis_id", "caller", "callsite").agg(F.count(F.lit(1)).alias("n"))


@query
def threading_bridges(t) -> DataFrame:
    """Suppliers hand work to parts: known threads and runnables, or nothing known, where runnables near the caller stand in."""
    s, p = F.col("l_suppkey"), F.col("l_partkey") % 100
    calls = t.lineitem.select(F.lit("a").alias("analysis_id"), F.concat(F.lit("<q"), s % 4, F.lit(".S"), s, F.lit(": void m()>")).alias("caller"), F.concat(F.lit("at "), F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber")).alias("callsite"),
                              F.when(p % 3 == 0, "thread_start").when(p % 3 == 1, "handler_post").otherwise("executor_execute").alias("pattern"), F.when((p % 3 == 0) & (p % 8 == 0), F.concat(F.lit("T"), p)).alias("thread_new"), F.when(p % 5 == 0, F.concat(F.lit("T"), p)).alias("thread_field"),
                              F.lit("java.lang.Thread").alias("thread_type"), F.when(p % 7 == 0, F.concat(F.lit("R"), p)).alias("work_new"), F.when(p % 11 == 0, F.concat(F.lit("R"), p)).alias("work_type"))
    n = F.col("id")
    run = lambda c: F.concat(F.lit("<"), c, F.lit(": void run()>"))
    own = t.spark.range(100).select(F.concat(F.when(n % 4 == 0, "T").otherwise("R"), n).alias("class"))
    near = t.supplier.where("s_suppkey % 3 = 0").select(F.concat(F.lit("q"), F.col("s_suppkey") % 4, F.lit(".S"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, "$1").otherwise("")).alias("class"))
    every = own.union(near).select(F.lit("a").alias("analysis_id"), "class", run(F.col("class")).alias("run"))
    e = threads.threading_edges(calls, every, near.select(F.lit("a").alias("analysis_id"), "class"), 2)
    return e.groupBy("caller", "callee", "pattern", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query
def augmented_edge_counts(t) -> DataFrame:
    e = A.edges(t).withColumn("edge_source", F.when(F.col("l_suppkey") % 2 == 0, "flowdroid_callback").otherwise(F.col("edge_source"))).withColumn("callee", F.when(F.col("ord") % 3 == 0, F.regexp_replace("callee", "call", "onCreate")).otherwise(F.regexp_replace("callee", "call", "work")))
    return threads.augmented(e).groupBy("edge_source").agg(F.count(F.lit(1)).alias("n"))


_INDICATORS = (("SOCIAL_ENGINEERING_PERMISSION_LURE_SETTINGS", "page"), ("C2_MESSAGING_PLATFORM_ENDPOINTS", "utf-8"), ("C2_MESSAGING_PLATFORM_ENDPOINTS", "example.net/"), ("OTHER", "a"))


@query
def page_string_categories(t) -> DataFrame:
    units = t.pages.select(F.lit("p").alias("analysis_id"), F.col("page_id").alias("method"), F.concat_ws(" ", "html", F.lit('"'), "url", F.lit('"')).alias("stmt"))
    rows = evidence.string_categories(evidence.method_strings(units), t.spark.createDataFrame(list(_INDICATORS), "category_id string, indicator string"))
    return rows.select(F.col("method").alias("page_id"), "category_id", joined("indicators").alias("indicators"))


@query
def field_constants(t) -> DataFrame:
    names = list(X.FIELD_VALUES)
    field = F.get(F.array(*(F.lit(n) for n in [*names, "a.B.KEY"])), (F.col("o_orderkey") % 8).cast("int"))
    stmt = F.concat(F.lit('r = staticget <'), F.regexp_replace(field, r"\.([A-Z_]+)$", ": java.lang.String $1"), F.lit('>; f("x'), F.col("o_orderkey") % 5, F.lit('")'))
    return t.orders.select("o_orderkey", joined(X.statement_strings(stmt)).alias("texts"))


@query
def versioned_constants(t) -> DataFrame:
    names = list(H.VERSIONED)
    rows = t.part.select("p_partkey", F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 5).cast("int")).alias("e"), (F.col("p_size") % 12 + F.when(F.col("p_partkey") % 5 == 2, 98).otherwise(0)).cast("int").alias("v"), (F.col("p_partkey") % 37).alias("target"))
    c = H.versioned_constant(F.col("e"), F.col("v"), F.col("target"))
    return rows.select("p_partkey", c["semantic"].alias("semantic"), c["confidence"].alias("confidence"))


@query
def resolved_methods(t) -> DataFrame:
    """Parts inherit along their keys, ten to a chain; every fourth has the method."""
    k = F.col("p_partkey")
    calls = t.part.select(F.lit("a").alias("analysis_id"), k.cast("string").alias("class"), F.lit("void run()").alias("name"))
    have = calls.where("class % 4 = 0")
    up = t.part.where("p_partkey % 10 > 0").select(F.lit("a").alias("analysis_id"), k.cast("string").alias("class"), (k - 1).cast("string").alias("parent"))
    return graph.resolve_methods(calls, have, up).select("class", "owner")


@query
def inherited_entrypoints(t) -> DataFrame:
    bases = sorted(C.BASE_METHODS)
    cls = F.concat(F.lit("a.P"), F.col("p_partkey"))
    sub = t.part.select(F.lit("a").alias("analysis_id"), cls.alias("class"), F.get(F.array(*map(F.lit, bases)), (F.col("p_partkey") % len(bases)).cast("int")).alias("supertype"))
    names = F.array(*(F.lit(n) for n in ("onCreate", "onReceive", "query", "onBind", "helper", "onAttach", "onHandleIntent", "onInterrupt")))
    named = t.part.select("p_partkey", F.explode(names).alias("n"))
    methods = named.select(F.lit("a").alias("analysis_id"), F.concat(F.lit("<"), cls, F.lit(": void "), F.col("n"), F.lit("()>")).alias("method"))
    return C.inherited_entrypoints(methods, sub).select("method")


@query
def resolved_values(t) -> DataFrame:
    """Lines of an order are definitions: of a new object in every third line, else of the line before, at times by a cast."""
    n = F.col("n")
    before = F.concat(F.when(n % 2 == 0, "(java.lang.Object) ").otherwise(""), F.lit("v"), n - 1)
    lines = t.lineitem.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    d = lines.select(F.col("l_orderkey").alias("method"), n.alias("idx"), F.concat(F.lit("v"), n).alias("local"), F.when(n % 3 == 0, F.concat(F.lit("new S"), F.col("l_suppkey"))).otherwise(before).alias("value"))
    uses = d.select("method", "idx", F.col("local").alias("value"))
    return triage.resolve_values(uses, d).select(F.col("method").alias("l_orderkey"), F.col("idx").cast("bigint").alias("place"), "resolved")


@query
def path_hints(t) -> DataFrame:
    k = F.col("o_orderkey")
    hint = F.concat(F.when(k % 6 == 0, "/").when(k % 6 == 1, "cacheDir/").when(k % 6 == 2, "filesDir/").when(k % 6 == 3, "externalCacheDir/").when(k % 6 == 4, "externalFilesDir/").otherwise("other/"), F.lit("f"), k, F.when(k % 4 == 0, ".db").when(k % 4 == 1, "*.db").when(k % 4 == 2, ".x_").otherwise(""))
    package = F.when(k % 5 > 0, F.concat(F.lit("c"), F.col("o_custkey")))
    return t.orders.select("o_orderkey", H.resolve_path(hint, package).alias("path"), H.is_stable_path(hint).alias("stable"))


@query
def extra_flags(t) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("string", "int", "long", "boolean", "parcelable", "mixed", "other"))), (F.col("event_id") % 8).cast("int"))
    return t.events.select("event_id", H.extra_flag(kind).alias("flag"), H.is_injectable(kind).alias("injectable"))


@query
def component_names(t) -> DataFrame:
    k = F.col("s_suppkey")
    value = F.when(k % 5 == 0, F.concat(F.lit("p.q/.S"), k)).when(k % 5 == 1, F.concat(F.lit("p.q/r.S"), k)).when(k % 5 == 2, F.concat(F.lit(".S"), k)).when(k % 5 == 3, F.concat(F.lit("S"), k, F.lit("/"))).otherwise("")
    return t.supplier.select("s_suppkey", H.component_of(value, F.lit("m.n")).alias("component"))


@query
def seed_warnings(t) -> DataFrame:
    k = F.col("o_orderkey")
    w = H.seed_warnings(F.when(k % 4 > 0, "c"), F.when(k % 3 > 0, F.lit("activity")), (k % 10) / 10, k % 3, k % 5, k % 7)
    return t.orders.select("o_orderkey", joined(w).alias("warnings"), H.automation(w).alias("automation"))


@query
def latest_runs(t) -> DataFrame:
    files = t.events.select(F.col("user_id").alias("analysis_id"), F.col("event_type").alias("run_id"), F.col("ts").alias("modified"))
    return ingest.latest_runs(files)


@query
def signature_index(t) -> DataFrame:
    return ingest.signature_index(t.part.select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("category_id"), F.concat(F.lit(" "), F.col("p_brand")).alias("signature")))


@query
def case_facts(t) -> DataFrame:
    seeds = t.conversations.where("turn = 0").select(F.col("conv_id").alias("case_id"), F.col("conv_id").alias("seed_id"), F.array(F.lit("a"), F.lit("b")).alias("facts"))
    path = t.conversations.select(F.col("conv_id").alias("case_id"), F.col("conv_id").alias("seed_id"), F.col("role").alias("method"), F.array_repeat(F.lit("f"), F.col("turn").cast("int") % 3).alias("facts"))
    return cases.case_facts(seeds, path).groupBy("case_id", "method", "fact_index", "fact").agg(F.count(F.lit(1)).alias("n")).withColumn("fact_index", F.col("fact_index").cast("bigint"))


@query
def merged_guidance(t) -> DataFrame:
    out = t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.when(F.col("l_linenumber") % 2 == 0, F.array(F.col("l_partkey").cast("string"), F.lit("x"))).alias("steps"), F.array(F.col("l_suppkey").cast("string")).alias("manual_steps"))
    return cases.merged_guidance(out).select(F.col("case_id").alias("l_orderkey"), joined("steps").alias("steps"), joined("manual_steps").alias("manual_steps"))


@query
def requirement_outputs(t) -> DataFrame:
    req = t.customer.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("requirement_id"), F.col("c_mktsegment").alias("seed_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("category"), F.concat(F.lit("C"), F.col("c_nationkey")).alias("component_name"))
    out = t.orders.select("o_orderkey", F.col("o_custkey").alias("requirement_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("seed_id"))
    return cases.requirement_outputs(req, out).select("o_orderkey", "seed_id", "category", "component_name")
