"""Registered queries over method bodies and claims about them, which are made from the driver's orders.

An order is a method of one of ten classes q.S0 to q.S9, its kind (key modulo 8) the way in which it hands on work. q.T0 to q.T9 are
threads, odd ones without a run() below even ones; q.R0 to q.R9 are runnables, every third abstract; q.L0 to q.L9 are listeners, odd
ones abstract; some of the classes have inner ones.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bodies import ir_summary
from ..operators import defuse as D
from ..operators import grounding as G
from .queries import joined, query

_N = 10
_START = "virtualinvoke $t.<java.lang.Thread: void start()>()"
_LISTENER = D.REGISTRATIONS[0][1]
_CLICK = "virtualinvoke $v.<android.view.View: void setOnClickListener(android.view.View$OnClickListener)>($l)"
#: Statements by kind; {c} is the number of the class, {d} the one after it.
_BODIES = (
    ("$t = new q.T{c}", "$u = (java.lang.Thread) $t", "$w = $u", "virtualinvoke $w.<java.lang.Thread: void start()>()"),
    ("$r = new q.R{c}", "$t = new java.lang.Thread", "specialinvoke $t.<java.lang.Thread: void <init>(java.lang.Runnable)>($r)", _START),
    ("r1 := @parameter0: q.R{c}", "virtualinvoke $h.<android.os.Handler: boolean post(java.lang.Runnable)>(r1)"),
    ("$r = new q.R{c}", "$m = staticinvoke <android.os.Message: android.os.Message obtain(android.os.Handler,java.lang.Runnable)>($h, $r)", "virtualinvoke $h.<android.os.Handler: boolean sendMessage(android.os.Message)>($m)"),
    ("$r = new q.R{d}", "$r = new q.R{c}", "interfaceinvoke $e.<java.util.concurrent.Executor: void execute(java.lang.Runnable)>($r)", "$r = new q.R{d}"),
    ("$l = new q.L{c}", _CLICK),
    ("$l = r0.<q.S{c}: q.L{c} tap>", _CLICK),
    ("r0 := @this: q.S{c}", "$t = r0.<q.S{c}: java.lang.Thread w>", _START),
)


def _units(t) -> DataFrame:
    bodies = F.array(*(F.array(*map(F.lit, b)) for b in _BODIES))
    c = F.col("o_custkey") % _N
    text = F.replace(F.replace(F.col("stmt"), F.lit("{c}"), c.cast("string")), F.lit("{d}"), ((c + 1) % _N).cast("string"))
    rows = t.orders.select("o_orderkey", "o_custkey", F.posexplode(F.get(bodies, (F.col("o_orderkey") % len(_BODIES)).cast("int"))).alias("idx", "stmt"))
    rows = rows.select(F.concat(F.lit("a"), F.col("o_orderkey") % 3).alias("analysis_id"), F.concat(F.lit("<q.S"), c, F.lit(": void m"), "o_orderkey", F.lit("()>")).alias("method"), "idx", text.alias("stmt"))
    ids = rows.select("analysis_id").distinct().withColumn("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(_N // 2 - 1)), lambda n: n.cast("string"))))
    stores = F.array(F.concat(F.lit("$n = new q.T"), "n"), F.concat(F.lit("r0.<q.S"), "n", F.lit(": java.lang.Thread w> = $n")))
    made = ids.select("analysis_id", F.concat(F.lit("<q.S"), "n", F.lit(": void onCreate(android.os.Bundle)>")).alias("method"), F.posexplode(stores).alias("idx", "stmt"))
    return rows.unionByName(made)


def _classes(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """hierarchy, methods and parents of the analyses that orders have; the classes are the same in each."""
    ids = t.orders.select(F.concat(F.lit("a"), F.col("o_orderkey") % 3).alias("analysis_id")).distinct()
    thread, run, tap = "java.lang.Thread", "java.lang.Runnable", "void onClick(android.view.View)"
    above, own, parents = [], [], []
    for n in range(_N):
        above += [(f"q.T{n}", thread), (f"q.T{n}", run), (f"q.R{n}", run), (f"q.L{n}", _LISTENER)]
        own += [(f"q.R{n}", "void run()", n % 3 > 0), (f"q.L{n}", tap, n % 2 == 0)]
        if n % 2:
            above, parents = [*above, (f"q.T{n}", f"q.T{n - 1}")], [*parents, (f"q.T{n}", f"q.T{n - 1}")]
        else:
            own.append((f"q.T{n}", "void run()", True))
        if n % 4 == 0:
            above, own = [*above, (f"q.S{n}$1", run)], [*own, (f"q.S{n}$1", "void run()", True)]
        if n % 4 == 1:
            above, own = [*above, (f"q.S{n}$L", _LISTENER)], [*own, (f"q.S{n}$L", tap, True)]

    def each(rows: list, *names: str) -> DataFrame:
        kinds = ("string", "string", "boolean")
        typed = F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), "array<struct<" + ",".join(f"{n}:{k}" for n, k in zip(names, kinds)) + ">>")
        return ids.select("analysis_id", F.inline(typed))

    return each(above, "class", "supertype"), each(own, "class", "name", "concrete"), each(parents, "class", "parent")


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy(F.regexp_extract("callee", "^<([^:]+):", 1).alias("target"), "pattern", "confidence").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("analysis_id", "caller").alias("callers"))


@query
def found_threading_edges(t) -> DataFrame:
    return _counted(D.found_threading_edges(_units(t), *_classes(t)))


@query
def found_listener_edges(t) -> DataFrame:
    return _counted(D.found_listener_edges(_units(t), *_classes(t), 3))


def _claims(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A customer is a seed, its orders are facts and their lines the statements. An eleventh of the facts name no statement, a
    seventh one that is not there; what they say fits in part."""
    key, none = F.col("o_orderkey"), F.array().cast("array<string>")
    seed = F.concat(F.lit("c"), "o_custkey").alias("seed_id")
    method = F.when(F.col("l_linenumber") % 3 == 1, "setAudioSource").otherwise("addView")
    stmt = F.concat(F.lit("virtualinvoke $m.<q.P"), F.col("l_partkey") % 20, F.lit(": void "), method, F.lit("(int)>("), F.when(F.col("l_partkey") % 2 == 0, F.col("l_linenumber")).otherwise(2038), F.lit(") 10."), F.col("l_partkey") % 5, F.lit(".0.9"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("unit_id"), stmt.alias("stmt"), "l_linenumber")
    units = lines.join(t.orders.select("o_orderkey", seed), "o_orderkey").select("seed_id", "unit_id", "stmt")
    ids = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "unit_id"))).alias("x"))
    own = F.coalesce(F.transform("x", lambda u: u["unit_id"]), none)
    named = F.when(key % 11 > 0, F.concat(own, F.when(key % 7 == 0, F.array(F.concat(F.lit("gone-"), key))).otherwise(none)))
    said = F.array(*map(F.lit, ("records the Microphone", "shows an application_overlay over all of the others", "unrelated words only here", "calls q.p", "type_phone setaudiosource")))
    fact = F.concat(F.get(said, (key % 5).cast("int")), F.lit(" sent to http://h"), F.col("o_custkey") % 7, F.lit(".example.com/x or 10."), key % 6, F.lit(".7.7 and cdn.site"), F.col("o_custkey") % 3, F.lit(".org"))
    facts = t.orders.join(ids, "o_orderkey", "left").select(seed, key.alias("idx"), fact.alias("fact"), named.alias("support_unit_ids"))
    near = F.array(F.concat(F.lit("http://h"), F.col("c_custkey") % 4, F.lit(".example.com/x")), F.concat(F.lit("see site"), F.col("c_custkey") % 2, F.lit(".org")))
    return facts, units, t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("seed_id"), F.posexplode(near).alias("ord", "text"))


@query
def claim_grounding(t) -> DataFrame:
    """Faults of all facts."""
    return G.grounding_faults(*_claims(t)).withColumn("overlap_ratio", F.round("overlap_ratio", 9))


@query
def claim_verdicts_strict(t) -> DataFrame:
    """Verdicts on all seeds, with every fault an error."""
    facts, units, strings = _claims(t)
    out = G.grounding(facts, G.grounding_faults(facts, units, strings, strict=True))
    return out.select("seed_id", "ok", F.array_join("missing_unit_ids", "|").alias("missing"), "n_mismatched", "n_warnings")


@query
def ir_summaries(t) -> DataFrame:
    """Statements, calls and fields of the first four units of each method (a part's lines, by the year of their order; the
    years are analyses that share the methods' names)."""
    stmt = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("virtualinvoke $m.<q.S"), F.col("l_suppkey") % 9, F.lit(": void f()>()"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("$f = r0.<q.P: int f"), F.col("l_suppkey") % 9, F.lit(">"))).otherwise("")
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("string").alias("analysis_id"))
    units = t.lineitem.join(orders, "l_orderkey").select("analysis_id", F.concat(F.lit("m"), "l_partkey").alias("method"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), stmt.alias("stmt"))
    return ir_summary(units, 4).select("analysis_id", "method", joined("statements").alias("statements"), joined("invoked_methods").alias("invoked"), joined("field_accesses").alias("fields"), "unit_count", "truncated")
