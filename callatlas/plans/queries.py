"""Registered queries of the program-graph operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import signatures as S
from ..functions import source as X2
from ..functions import text as X
from ..operators import components as C
from ..operators import evidence, flows, hits, lookups, rollup, rules, triage
from ..streaming import ledger as L
from . import adapters as A
from . import graph

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(A.Tables(spark, sf_dir))
    return f


def joined(c: str):
    return F.array_join(c, "|")


def day_patterns(spark: SparkSession) -> DataFrame:
    """Patterns over event types that exercise every clause."""
    p = rules.pattern
    return rules.patterns_table(spark, [
        p(0, "P_ALL", 0.20, ["click", "purchase"], override="HIGH"), p(1, "P_ANY", 0.15, ["error"], ["signup", "view"]), p(2, "P_TWICE", 0.25, ["view"], ["click", "signup"], ["purchase", "error"], override="CRITICAL"),
        p(3, "P_COUNT", 0.10, min_count=3, from_set=["click", "view", "signup", "error"]), p(4, "P_EMPTY", 0.01)])


@query
def hits_by_category(t) -> DataFrame:
    found = hits.by_category(A.hits(t))
    return found.select("category_id", "n_hits", "priority", "weight")


@query
def hits_ranked_topk(t) -> DataFrame:
    return hits.ranked(A.hits(t), 50).select("caller", "callee", "priority", F.col("rank").cast("bigint").alias("rank"))


@query
def hits_hierarchy_match(t) -> DataFrame:
    """Callees of uncatalogued types match a catalog class that their brand's class extends."""
    e = A.edges(t).select("analysis_id", "ord", "caller", "callee")
    subtypes = t.part.where("p_type = 'SMALL'").select(F.concat(F.lit("tpch.small.P"), F.col("p_partkey") % 100).alias("class"), F.concat(F.lit("tpch.promo.P"), F.col("p_partkey") % 100).alias("supertype")).distinct()
    found = hits.hierarchy_matches(e, A.catalog(t), subtypes)
    return found.groupBy("category_id", "callee").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("caller").alias("n_callers"))


@query
def filter_reason_counts(t) -> DataFrame:
    return A.reasoned(A.edges(t)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def best_edge_per_pair(t) -> DataFrame:
    best = hits.best_edges(A.edges(t).select("analysis_id", "caller", "callee", "ord", "edge_source", "confidence"), hits.edge_weight(F.col("edge_source"), F.col("confidence"), synthetic=True))
    return best.select("caller", "callee", F.col("weight").cast("bigint").alias("weight"), "edge_source")


@query
def group_rollup(t) -> DataFrame:
    g = rollup.groups(A.hits(t))
    return g.select("caller", "n_hits", joined("categories").alias("categories"), "priority", "n_critical", "n_high", "n_medium", "n_low", F.round("investigability", 6).alias("investigability"), "weight", "group_id")


@query
def block_rollup(t) -> DataFrame:
    b = rollup.blocks(rollup.groups(A.hits(t)).withColumn("caller_class", F.regexp_replace("caller_class", r"\.S", r"\$S")))
    return b.select("outer", "n_groups", "n_hits", joined("categories").alias("categories"), "priority", "weight", "block_id")


@query
def pattern_match_user_day(t) -> DataFrame:
    m = rules.with_patterns(A.category_sets(t), "categories", day_patterns(t.spark))
    return m.select("user_id", "day", joined("categories").alias("categories"), joined("patterns.pattern_id").alias("patterns"))


@query
def pattern_evidence_user_day(t) -> DataFrame:
    m = rules.with_patterns(A.category_sets(t), "categories", day_patterns(t.spark)).select("user_id", "day", "categories", F.explode("patterns").alias("p")).where("p.pattern_id <> 'P_EMPTY'")
    return m.select("user_id", "day", F.col("p.pattern_id").alias("pattern_id"), joined(rules.evidence(F.col("p"), F.col("categories"))).alias("evidence"))


def _scored(t, block: bool) -> DataFrame:
    rows = A.category_sets(t).withColumn("base", F.lit(0.4)).withColumn("priority", F.when(F.size("categories") > 3, "MEDIUM").otherwise("LOW"))
    s = rules.score(rows, "categories", "base", "priority", day_patterns(t.spark), block)
    return s.select("user_id", "day", F.round("raw_score", 6).alias("raw_score"), F.round("threat_score", 6).alias("threat_score"), "effective_priority")


@query
def threat_score_group(t) -> DataFrame:
    return _scored(t, False)


@query
def threat_score_block(t) -> DataFrame:
    return _scored(t, True)


@query
def pattern_counts_by_level(t) -> DataFrame:
    p = day_patterns(t.spark)
    days = rules.with_patterns(A.category_sets(t), "categories", p)
    users = rules.with_patterns(t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("categories")), "categories", p)
    return rules.pattern_counts(days, "day").unionByName(rules.pattern_counts(users, "user"))


@query
def package_union(t) -> DataFrame:
    return rollup.package_union(rollup.groups(A.hits(t))).select("package", "n_groups", joined("categories").alias("categories"))


@query
def package_inventory(t) -> DataFrame:
    name = lambda c: F.concat(F.lit("n"), c).alias("package")
    s = t.supplier
    lines = t.lineitem.select("l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rollup.inventory(("suppliers", s.select(name(F.col("s_nationkey")))), ("customers", t.customer.select(name(F.col("c_nationkey")))), ("calls", lines.select(name(F.col("s_nationkey")))), ("nations", t.nation.select(name(F.col("n_nationkey")))))


@query
def dominant_prefix(t) -> DataFrame:
    return rollup.dominant(t.part.select(F.substring("p_brand", 1, 7).alias("prefix")), "prefix")


@query
def stratified_preview(t) -> DataFrame:
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "HIGH").when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").otherwise("LOW").alias("priority"))
    p = rollup.stratified_preview(o, "priority", ["o_orderkey"], 100)
    return p.select("o_orderkey", "priority", F.col("stratum_rank").cast("bigint").alias("stratum_rank"))


def _roots(t) -> DataFrame:
    """All customers: nothing calls them."""
    return t.customer.select(F.lit("tpch").alias("analysis_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("method"))


@query
def bfs_levels(t) -> DataFrame:
    return graph.bfs_roots(A.purchase_graph(t), _roots(t)).select("method", F.col("level").cast("bigint").alias("level"))


@query
def weighted_distance(t) -> DataFrame:
    return graph.weighted_distances(A.purchase_graph(t), _roots(t)).select("method", "dist", "pred")


@query
def weighted_paths(t) -> DataFrame:
    reached = graph.weighted_distances(A.purchase_graph(t), _roots(t))
    p = graph.paths(reached)
    return p.select("method", "dist", F.col("hops").cast("bigint").alias("hops"), F.array_join("path", ">").alias("path"))


@query
def k_hop_callers_callees(t) -> DataFrame:
    """A search: its query set are the parts whose key is divisible by 100, against the graph of all orders."""
    starts = t.part.where("p_partkey % 100 = 0").select(F.lit("tpch").alias("analysis_id"), F.concat(F.lit("p"), F.col("p_partkey")).alias("method"))
    k = graph.k_hop(A.purchase_graph(t), starts, 2)
    return k.groupBy("start", "direction", F.col("hop").cast("bigint").alias("hop")).agg(F.count(F.lit(1)).alias("n"))


def _tree(t) -> DataFrame:
    return t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent")).union(
        t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey")), F.concat(F.lit("n"), F.col("s_nationkey")))).union(
        t.customer.select(F.concat(F.lit("c"), F.col("c_custkey")), F.concat(F.lit("n"), F.col("c_nationkey"))))


@query
def transitive_supertypes(t) -> DataFrame:
    return graph.closure(_tree(t)).select("child", "ancestor", F.col("depth").cast("bigint").alias("depth"))


@query
def ancestor_component(t) -> DataFrame:
    chain = _tree(t).select(F.col("child").alias("method"), F.col("parent").alias("pred"))
    marked = t.nation.where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("method"), F.col("n_name").alias("component")).union(t.region.select(F.concat(F.lit("r"), F.col("r_regionkey")), F.col("r_name")))
    return graph.nearest_ancestor(chain, marked).select("method", "component", F.col("depth").cast("bigint").alias("depth"))


@query
def backward_slice_orders(t) -> DataFrame:
    """Lines of an order lead to the next line; the slice of an order's fourth line."""
    u = t.lineitem.select(F.col("l_orderkey").cast("string").alias("method"), "l_linenumber").distinct()
    units = u.select("method", F.col("l_linenumber").cast("string").alias("unit_id"), F.array((F.col("l_linenumber") + 1).cast("string")).alias("succs"))
    s = graph.backward_slice(units, u.where("l_linenumber = 4").select(F.concat(F.lit("seed"), F.col("method")).alias("seed_id"), "method", F.lit("4").alias("unit_id")))
    return s.select("seed_id", "unit_id")


@query
def asof_version(t) -> DataFrame:
    have = t.part.where("p_size % 7 = 0").select(F.col("p_size").alias("version"))
    wanted = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("target"))
    return triage.platform_version(wanted, have)


@query
def last_def_before_use(t) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("value")).alias("defined"))
    return triage.last_definition(rows, ["user_id"], "event_id", "defined").select("user_id", "event_id", "last_value")


@query
def missing_bridges(t) -> DataFrame:
    site = F.to_date("ts").cast("string").alias("callsite")
    e = t.events
    side = lambda kind: e.where(F.col("event_type") == kind).select(F.lit("x").alias("analysis_id"), F.col("user_id").alias("caller"), site).distinct()
    return hits.missing_bridges(side("signup"), side("purchase")).select("caller", "callsite")


@query
def coverage_gap(t) -> DataFrame:
    covered = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("group_id"))
    pruned = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("group_id"))
    return triage.uncovered(t.customer.select(F.col("c_custkey").alias("group_id"), "c_mktsegment"), covered, pruned)


@query
def best_case_per_hit(t) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return triage.best_case(o, "o_custkey", F.col("o_orderpriority"), F.col("o_orderkey"))


@query
def merged_call_sites(t) -> DataFrame:
    o = t.orders.select((F.col("o_custkey") % 50).alias("case_id"), F.col("o_custkey").cast("string").alias("caller"), F.col("o_orderkey").alias("seed_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("signature"), F.col("o_orderstatus").alias("category"))
    m = triage.merge_call_sites(o)
    return m.select("case_id", "caller", "primary_seed", F.size("seed_ids").cast("bigint").alias("n_seeds"), joined("categories").alias("categories"), "category")


@query
def ioc_ipv4(t) -> DataFrame:
    return t.documents.select("doc_id", F.explode(X.ipv4s(F.col("text"))).alias("ip")).select("doc_id", "ip", X.is_version_like(F.col("ip")).alias("version_like"))


@query
def ioc_base64(t) -> DataFrame:
    return t.documents.select("doc_id", F.explode(X.words_like(F.col("text"), X.BASE64)).alias("value"))


@query
def url_domains(t) -> DataFrame:
    return t.pages.groupBy(X.url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query
def indicator_boundary(t) -> DataFrame:
    ind = t.spark.createDataFrame([(x,) for x in ("tionsh.example.net", "utm_source", "page", "fr")], "indicator string")
    return evidence.indicators_in(t.pages.select("page_id", "url"), "url", ind).select("page_id", "indicator")


@query
def keyword_evidence_map(t) -> DataFrame:
    cats = t.spark.createDataFrame([("en", "T1001"), ("fr", "T1002"), ("fr", "T1003")], "key string, technique_id string")
    words = t.spark.createDataFrame([("token", "T2001"), ("idiot", "T2002"), ("@mail", "T2003")], "key string, technique_id string")
    return evidence.techniques(t.documents.select(F.col("doc_id").alias("evidence_id"), F.col("lang").alias("category"), F.col("text").alias("claim")), cats, words)


@query
def token_overlap(t) -> DataFrame:
    """Each document's tokens against those of the previous document."""
    d = t.documents
    claims = d.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("claim_id"), F.col("text").alias("claim"))
    out = evidence.token_overlap(claims, d.select((F.col("doc_id") + 1).alias("key"), "text"))
    return out.select("claim_id", "n_tokens", "n_found", F.round("ratio", 6).alias("ratio"))


@query
def source_search_first_line(t) -> DataFrame:
    return evidence.search(t.documents.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), "text"), "token = ", 20)


@query
def statement_kinds(t) -> DataFrame:
    s = t.conversations.select(F.concat(F.when(F.col("turn") % 4 == 0, "if ").when(F.col("turn") % 4 == 1, "return ").when(F.col("turn") % 4 == 2, "goto ").otherwise("x = "), F.col("role")).alias("stmt"))
    return s.groupBy(X.statement_kind(F.col("stmt")).alias("kind"), X.is_branch(F.col("stmt")).alias("branch")).agg(F.count(F.lit(1)).alias("n"))


@query
def signature_parts(t) -> DataFrame:
    name = S.normalise_signature(F.concat(F.lit("Ltpch/n"), F.col("s_nationkey"), F.lit("/S$"), F.col("s_suppkey"), F.lit(";")), F.lit("run"), F.lit("(I[JLjava/lang/String;)V"))
    rows = t.supplier.select("s_suppkey", name.alias("signature"))
    c = S.class_of(F.col("signature"))
    return rows.select("s_suppkey", "signature", c.alias("class"), S.outer_class(c).alias("outer"), S.package_of(c).alias("package"), S.method_of(F.col("signature")).alias("method"), S.return_of(F.col("signature")).alias("ret"), F.array_join(S.params_of(F.col("signature")), ",").alias("params"), S.sha1_id("seed-", F.col("signature"), length=12).alias("seed_id"))


@query
def component_extras_rollup(t) -> DataFrame:
    e = t.events.select(F.col("event_type").alias("component"), F.concat(F.lit("x"), F.col("user_id") % 7).alias("extra"), F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "int").otherwise("string").alias("type"), (F.col("value") > 60).alias("required"), F.concat(F.lit("h"), F.get_json_object("props", "$.k").cast("int") % 3).alias("hint"))
    r = evidence.required_extras(e)
    return r.select("component", "extra", "type", "required", joined("hints").alias("hints"))


@query
def capped_buckets(t) -> DataFrame:
    c = rollup.capped(t.conversations, ["conv_id"], ["role"], "turn", 2)
    return c.select("conv_id", "role", F.col("turn").alias("first_turn"), F.col("n").cast("bigint").alias("n"))


@query
def confidence_formula(t) -> DataFrame:
    g = t.labels.groupBy((F.col("doc_id") % 20).alias("seed")).agg(F.avg("quality").alias("q"), F.avg("toxic").alias("x"), F.count(F.lit(1)).alias("n"))
    return g.select("seed", evidence.confidence(F.col("q"), F.col("x"), F.col("n") / 1000).alias("raw"), evidence.phase_status(F.col("x"), 1 - F.col("q")).alias("status"))


@query
def reflection_verdicts(t) -> DataFrame:
    h = t.orders.select(F.lit("a").alias("analysis_id"), F.col("o_orderkey").alias("hit_id"), (F.col("o_custkey") % 1000).alias("caller"), F.when(F.col("o_orderpriority") == "1-URGENT", "REFLECTION").when(F.col("o_orderpriority") == "2-HIGH", "CRYPTO").otherwise("OTHER").alias("category_id"), (F.col("o_totalprice") > 400000).alias("target_is_sensitive"))
    return evidence.reflection_verdicts(h, "REFLECTION", "CRYPTO").select("hit_id", "verdict")


@query
def missing_support(t) -> DataFrame:
    facts = t.orders.select(F.col("o_orderkey").alias("seed_id"), F.lit(0).alias("idx"), F.array(*(F.lit(str(k)) for k in (1, 3, 5, 7))).alias("support_unit_ids"))
    units = t.lineitem.select(F.col("l_orderkey").alias("seed_id"), F.col("l_linenumber").cast("string").alias("unit_id")).distinct()
    return evidence.missing_support(facts, units).select("seed_id", joined("missing").alias("missing"))


@query
def stage_durations(t) -> DataFrame:
    d = L.stage_durations(A.ledger(t), ["user_id"])
    return d.select("user_id", "stage", F.round("seconds", 3).alias("seconds"))


@query
def run_summary(t) -> DataFrame:
    return L.run_summary(A.ledger(t), ["user_id"])


@query
def event_levels(t) -> DataFrame:
    e = t.events.select(L.event_level(F.col("event_type"), F.when(F.col("value") > 50, "warning").otherwise("ok"), F.when(F.col("event_type") == "error", F.lit("e"))).alias("level"))
    return e.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query
def edge_union_dedup(t) -> DataFrame:
    """Edges of three sources, one for each pair of methods and call site (the remainder of the line's number, empty for one)."""
    site = F.when(F.col("ord") % 3 > 0, F.concat(F.lit("at "), F.col("ord") % 3)).otherwise("")
    e = A.edges(t).select("caller", "callee", site.alias("callsite"), "ord", "edge_source")
    parts = [e.where(F.col("edge_source") == s) for s in ("soot_cg", "jimple_invoke", "threading_synthetic")]
    return graph.union_edges(*parts).groupBy("edge_source").agg(F.count(F.lit(1)).alias("n"))


# Operators over components, source text and flows.


@query
def library_filter(t) -> DataFrame:
    name = F.concat(F.element_at(F.array(*map(F.lit, ("androidx.", "okhttp3.", "com.example.", "org.jsonx.", "com.google.gson."))), (F.col("p_size") % 5 + 1).cast("int")), F.col("p_brand"))
    rows = t.part.select(C.is_library(name).alias("library"), S.is_framework_name(name).alias("framework"))
    return rows.groupBy("library", "framework").agg(F.count(F.lit(1)).alias("n"))


def _declared(t) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, C.ENTRY_METHODS)), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return t.nation.where("n_nationkey < 20").select(F.lit("tpch").alias("analysis_id"), kind.alias("component_type"), F.concat(F.lit("app.N"), F.col("n_nationkey")).alias("name"))


@query
def declared_entrypoints(t) -> DataFrame:
    short = F.element_at(F.array(*map(F.lit, ("onCreate", "onReceive", "query", "onBind", "helper"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    m = t.supplier.select(F.lit("tpch").alias("analysis_id"), F.concat(F.lit("<app.N"), F.col("s_nationkey"), F.lit(": void "), short, F.lit("()>")).alias("method"))
    return C.entrypoints(m, _declared(t)).select("method")


@query
def component_contexts(t) -> DataFrame:
    h = t.supplier.select(F.lit("tpch").alias("analysis_id"), F.col("s_suppkey"), F.concat(F.lit("<app.N"), F.col("s_nationkey"), F.lit(": void m()>")).alias("caller"))
    return hits.component_contexts(h, _declared(t)).select("s_suppkey", "component_type")


@query
def app_prefix_members(t) -> DataFrame:
    names = t.part.select(F.lit("tpch").alias("analysis_id"), F.concat(F.lit("com."), F.lower("p_type"), F.lit(".x.P"), F.col("p_partkey")).alias("class"))
    return C.of_app(names, C.app_prefixes(names)).groupBy(S.package_of(F.col("class")).alias("package")).agg(F.count(F.lit(1)).alias("n"))


@query
def listener_bridges(t) -> DataFrame:
    reg = t.supplier.select(F.lit("tpch").alias("analysis_id"), F.concat(F.lit("<n"), F.col("s_nationkey"), F.lit(".S: void m()>")).alias("caller"), F.col("s_suppkey").cast("string").alias("callsite"), F.concat(F.lit("L"), F.col("s_suppkey") % 7).alias("listener"))
    imp = t.nation.select(F.concat(F.lit("L"), F.col("n_nationkey") % 7).alias("listener"), F.concat(F.lit("n"), F.col("n_nationkey"), F.lit(".I")).alias("class"), F.concat(F.lit("m"), F.col("n_nationkey")).alias("method"))
    e = C.listener_edges(reg, imp)
    return e.select("callsite", "callee", "confidence")


@query
def source_file_artifacts(t) -> DataFrame:
    text = F.concat(F.lit('x = new File(getCacheDir(), "r'), F.col("role"), F.lit('.db"); // new File("gone.db")\nLog.d("T'), F.col("turn"), F.lit('", "said"); /* Log.e("no", "no") */'))
    s = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("turn").cast("string"), F.lit(";\n"), text).alias("x")))).alias("x")).withColumn("text", F.array_join("x.x", "\n")).select(F.concat(F.lit("c"), F.col("conv_id")).alias("class_name"), "text")
    a, b = X2.file_artifacts(s), X2.log_hints(s)
    return a.select("class_name", F.lit("file").alias("kind"), F.col("path_hint").alias("value")).unionByName(b.select("class_name", F.lit("log").alias("kind"), F.concat("tag", F.lit(":"), "message").alias("value")))


@query
def source_intent_extras(t) -> DataFrame:
    text = F.concat(F.lit('static final String KEY = "k'), F.col("user_id") % 5, F.lit('";\ni.getIntExtra(KEY, 0); i.putExtra("'), F.col("event_type"), F.lit('", '), F.col("user_id"), F.lit("); i.hasExtra(A.KEY);"))
    s = t.events.select(F.col("event_type").alias("class_name"), text.alias("text")).distinct()
    x = X2.intent_extras(s)
    return x.groupBy("class_name", "name").agg(F.max("type").alias("type"), F.bool_or("required").alias("required"), F.countDistinct("value_hint").alias("n_hints"))


@query
def composed_flows(t) -> DataFrame:
    line = F.struct(F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("<android.p"), F.col("l_partkey"), F.lit(">"))).otherwise(F.concat(F.lit("<p"), F.col("l_partkey"), F.lit(">"))).alias("method"))
    path = t.lineitem.groupBy(F.col("l_orderkey").alias("flow_id"), "l_linenumber").agg(F.min(line).alias("x")).select("flow_id", "x.pos", "x.method")
    cache = t.part.select(F.concat(F.lit("<p"), F.col("p_partkey"), F.lit(">")).alias("method"), F.col("p_name").alias("summary"), (F.col("p_size") / 100).alias("confidence"), F.when(F.col("p_size") % 2 == 0, "jadx").otherwise("jimple_only").alias("source"))
    f = flows.compose(flows.with_analysis(path, cache))
    return f.select("flow_id", F.col("n_methods").cast("bigint").alias("n_methods"), "summary", "sink", F.round("confidence", 6).alias("confidence"))


@query
def feasibility_rollup(t) -> DataFrame:
    return flows.feasibility(t.orders.select(F.col("o_custkey").alias("flow_id"), F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_totalprice") > 480000, "blocked").otherwise("partial").alias("feasibility")))


@query
def model_call_tabs(t) -> DataFrame:
    c = t.events.select(F.col("event_id").alias("ord"), F.when(F.col("event_type") != "view", F.concat(F.lit("s"), F.col("user_id"))).alias("seed_id"))
    return flows.grouped_calls(c).select("tab", "n", "first")


@query
def permission_best(t) -> DataFrame:
    p = t.events.select(F.col("user_id").cast("string").alias("permission"), F.array(F.concat("event_type", F.col("event_id") % 7)).alias("evidence"), F.col("value").alias("confidence"), F.col("event_id").alias("ord"))
    return flows.permissions(p).select("permission", joined("evidence").alias("evidence"), "confidence")


@query
def confidence_histogram(t) -> DataFrame:
    return triage.confidence_histogram(t.part.select((F.col("p_size") / 50).alias("confidence")))


@query
def hints_with_fallback(t) -> DataFrame:
    classes = t.supplier.select(F.concat(F.lit("n"), F.col("s_nationkey"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("$S"), F.col("s_suppkey"))).otherwise("")).alias("class")).distinct()
    h = t.customer.where("c_nationkey % 3 = 0").select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("class"), F.col("c_mktsegment").alias("hint"))
    return C.hints_for(classes, h).select("class", joined("hints").alias("hints"))


@query
def evidence_verified(t) -> DataFrame:
    facts = t.orders.select(F.col("o_orderkey").alias("seed_id"), F.lit(0).alias("idx"), F.array(F.lit("1")).alias("support_unit_ids"))
    units = t.lineitem.select(F.col("l_orderkey").alias("seed_id"), F.col("l_linenumber").cast("string").alias("unit_id")).distinct()
    return evidence.verified(facts, units)


@query
def timeline_order(t) -> DataFrame:
    e = L.timeline(A.ledger(t).select("user_id", "stage", F.col("ts").cast("string").alias("ts"), "ord"))
    w = Window.partitionBy("user_id").orderBy("at", "ord")
    return e.select("user_id", F.col("ord").alias("event_id"), F.row_number().over(w).cast("bigint").alias("place"))


@query
def catalog_pattern_scores(t) -> DataFrame:
    """The 18 catalog patterns over sets of their own categories, one set for each customer."""
    names = sorted({c for p in rules.CATALOG for k in (4, 5, 6, 8) for c in p[k]})
    cats = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.when((F.col("c_custkey") * 7 + i * 13) % 5 < 2, F.get(F.array(*map(F.lit, names)), i))), lambda x: x.isNotNull())
    rows = t.customer.select("c_custkey", cats.alias("categories"), F.lit(0.3).alias("base"), F.lit("LOW").alias("priority"))
    s = rules.score(rows, "categories", "base", "priority", rules.patterns_table(t.spark, rules.CATALOG))
    return s.select("c_custkey", F.size("patterns").cast("bigint").alias("n_patterns"), F.round("raw_score", 6).alias("raw_score"), "effective_priority")


# Operators that the queries above leave out.


@query
def hit_investigability(t) -> DataFrame:
    site = F.when(F.col("o_custkey") % 3 == 0, "<java.lang.Class.forName(x)>").otherwise("<a.B: void m()>")
    more = F.when(F.col("o_custkey") % 5 == 0, "<dalvik.system.DexClassLoader: void x()>").otherwise("<c.D: void m()>")
    kind = F.when(F.col("o_custkey") % 2 == 0, "Unknown").otherwise("activity")
    length = F.when(F.col("o_orderkey") % 17 > 0, F.col("o_orderkey") % 13)
    x = hits.investigability(F.col("o_orderstatus") == "F", length, F.array(site, more), kind, F.col("o_totalprice") > 200000)
    return t.orders.select("o_orderkey", x.alias("x")).select("o_orderkey", "x.score", "x.reflection_free", joined("x.reflection_sites").alias("sites"))


@query
def preview_shared_out(t) -> DataFrame:
    """Few orders of the upper priorities, so that their places are shared out among the others."""
    k = F.col("o_orderkey") % 500
    o = t.orders.select("o_orderkey", F.when(k == 0, "CRITICAL").when(k < 5, "HIGH").when(k < 50, "MEDIUM").otherwise("LOW").alias("priority"))
    return rollup.stratified_preview(o, "priority", ["o_orderkey"], 1000).select("o_orderkey", "priority")


@query
def extraction_coverage(t) -> DataFrame:
    o = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("o_orderstatus") == "F").alias("guards"), F.count_if(F.col("o_orderstatus") == "P").alias("ambiguous"))
    c = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0)
    level = flows.coverage_level(F.col("calls"), F.col("guards"), F.col("c_mktsegment") == "BUILDING", F.col("ambiguous"))
    return c.select("c_custkey", level.alias("level"), flows.drifted(F.col("guards"), F.col("calls")).alias("drifted"))


@query
def ioc_domains(t) -> DataFrame:
    return t.documents.select("doc_id", F.explode(X.domains(F.col("text"))).alias("domain"))


@query
def ioc_urls(t) -> DataFrame:
    text = F.concat(F.lit("see <"), F.regexp_replace("url", "^http", "HTTP"), F.lit("> and '"), F.col("url"), F.lit("'"))
    return t.pages.select("page_id", F.explode(X.urls(text)).alias("url"))


@query
def method_usage(t) -> DataFrame:
    path = t.lineitem.select(F.col("l_orderkey").alias("flow_id"), F.col("l_partkey").alias("method"))
    return flows.method_usage(path).select("method", "n", F.size("flows").cast("bigint").alias("n_flows"))


@query
def call_texts(t) -> DataFrame:
    e = A.edges(t).select("caller", "callee", "ord", F.concat(F.lit("line "), "ord").alias("callsite"))
    return flows.call_texts(e.select("caller", "callee").distinct(), e)


@query
def flow_inputs(t) -> DataFrame:
    i = t.events.select(F.col("user_id").alias("flow_id"), F.col("event_type").alias("type"), (F.col("event_id") % 3).cast("string").alias("name"), "value", F.col("event_id").alias("ord"))
    return flows.first_inputs(i).select("flow_id", "type", "name", "value")


@query
def callback_edges(t) -> DataFrame:
    cb = t.supplier.select(F.lit("tpch").alias("analysis_id"), F.concat(F.lit("m"), "s_suppkey").alias("method"), F.concat(F.lit("app.N"), "s_nationkey").alias("component"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("site"), F.col("s_suppkey") % 9)).alias("registration_site"))
    return C.callback_edges(cb, _declared(t).select("analysis_id", F.concat(F.lit("<"), "name", F.lit(": void onCreate()>")).alias("method"))).select("caller", "callee")


@query
def kept_cases(t) -> DataFrame:
    o = t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("should_prune"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice") / 500000).alias("pruning_confidence"))
    return triage.keep_cases(o, 0.5).select("o_orderkey")


@query
def fallback_cases(t) -> DataFrame:
    return lookups.fallback_cases(rollup.groups(A.hits(t))).select("case_id", "group_id", F.col("place").cast("bigint").alias("place"))


@query
def changed_runs(t) -> DataFrame:
    """Users whose summary errors change."""
    summary = lambda e: e.groupBy(F.col("user_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    return lookups.changed_runs(summary(t.events.where("event_type <> 'error'")), summary(t.events)).select("run_id", "n")


@query
def bare_runs(t) -> DataFrame:
    """Customers as run folders, urgent orders as ledgers."""
    run = lambda d, c: d.select((F.col(c) % 5).alias("analysis_id"), F.col(c).alias("run_id"))
    return lookups.bare_runs(run(t.customer, "c_custkey"), run(t.orders.where("o_orderpriority = '1-URGENT'"), "o_custkey").distinct()).select("run_id")


@query
def bundle_keys(t) -> DataFrame:
    key = lookups.bundle_key(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey").cast("string")), F.col("o_orderstatus"), F.col("o_orderkey").cast("string"))
    return t.orders.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query
def api_permissions(t) -> DataFrame:
    m = t.spark.createDataFrame([("promo.", "P1"), (".P7", "P2"), ("economy", "P3"), ("P77", "P4")], "api string, permission string")
    p = C.permissions_for(A.edges(t).select(F.col("callee").alias("signature")).distinct(), m)
    return p.select("signature", joined("permissions").alias("permissions"))


@query
def rule_subset(t) -> DataFrame:
    """Rules for the methods of all parts, by brand, that have a keyword."""
    words = t.spark.createDataFrame([("P1",), ("promo",)], "keyword string")
    rules_ = t.part.select(A.callee_of(F.col("p_type"), F.col("p_partkey")).alias("signature"), F.col("p_brand").alias("category_id")).distinct()
    return lookups.rule_subset(rules_, words).select("signature", "category_id")


@query
def framework_flags(t) -> DataFrame:
    nodes = t.supplier.where("s_suppkey % 2 = 0").select(F.lit("tpch").alias("analysis_id"), F.col("s_suppkey").alias("ord"), A.caller_of(F.col("s_nationkey"), F.col("s_suppkey")).alias("method"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") % 4 == 0).alias("is_android_framework"))
    e = t.supplier.select(F.lit("tpch").alias("analysis_id"), "s_suppkey", A.caller_of(F.col("s_nationkey"), F.col("s_suppkey")).alias("caller"))
    return hits.with_framework_flag(e, nodes).select("s_suppkey", "is_framework")


@query
def safe_ids(t) -> DataFrame:
    return t.pages.select("page_id", X.safe_id(F.col("url")).alias("id"))


@query
def printable_runs(t) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.ascii_runs(F.encode("text", "UTF-8"))).cast("bigint").alias("n"))


@query
def best_claims(t) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 500000, 1).alias("confidence"), F.col("o_orderkey").alias("ord"))
    return triage.max_confidence(o, "o_custkey").select("o_custkey", "o_orderkey", "confidence")


@query
def hand_off_errors(t) -> DataFrame:
    checks = ("status", F.col("o_orderstatus") != "P"), ("price", F.col("o_totalprice") < 400000), ("customer", F.col("o_custkey") % 10 > 0)
    return lookups.violations(t.orders, *checks).select("o_orderkey", "errors")
