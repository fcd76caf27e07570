"""Work that is handed to threads, handlers and executors: edges from where it is started to what runs, and checks of them.

hierarchy: analysis_id, class, supertype (transitive, without the class itself).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signatures as S
from ..plans.durable import checkpointed
from .components import ACCESSIBILITY_METHODS, ENTRY_METHODS

THREAD, RUNNABLE = "java.lang.Thread", "java.lang.Runnable"
#: Most targets of a call whose argument is not resolved, where a bound is asked for.
FALLBACK = 20
LIFECYCLE = tuple(sorted({m for names in ENTRY_METHODS.values() for m in names} | set(ACCESSIBILITY_METHODS)))


def augmented(edges: DataFrame) -> DataFrame:
    """All edges but callback edges to lifecycle methods: these name what is overridden, not where it is registered."""
    life = (F.coalesce("edge_source", F.lit("")) == "flowdroid_callback") & F.coalesce(S.method_of(F.col("callee")).isin(*LIFECYCLE), F.lit(False))
    return edges.where(~life)


def strict(edges: DataFrame) -> DataFrame:
    """Edges that are not synthetic."""
    return edges.where(F.coalesce("edge_layer", F.lit("")) != "synthetic")


def classes_below(hierarchy: DataFrame, supertype: str) -> DataFrame:
    return hierarchy.where(F.col("supertype") == supertype).select("analysis_id", "class").distinct()


def thread_classes(edges: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Classes that are threads: the platform's own, in every analysis, and those below it."""
    own = edges.select("analysis_id").distinct().withColumn("class", F.lit(THREAD))
    return own.union(classes_below(hierarchy, THREAD)).distinct()


def starts(edges: DataFrame, threads: DataFrame) -> DataFrame:
    """Edges (analysis_id, caller, callee, callsite) that start a thread."""
    rows = edges.where((S.method_of(F.col("callee")) == "start") & F.contains("callee", F.lit(" void start()"))).withColumn("class", S.class_of(F.col("callee")))
    return rows.join(threads, ["analysis_id", "class"], "left_semi").drop("class")


def bridged(edges: DataFrame, threads: DataFrame, runnables: DataFrame) -> DataFrame:
    """analysis_id, caller, callsite of edges to run(): of a thread, of a runnable, or made by this module."""
    rows = edges.where((F.length("callsite") > 0) & (S.method_of(F.col("callee")) == "run") & F.contains("callee", F.lit(" void run()"))).withColumn("class", S.class_of(F.col("callee")))
    known = rows.join(threads.union(runnables).distinct(), ["analysis_id", "class"], "left_semi")
    key = ["analysis_id", "caller", "callsite"]
    return known.select(*key).union(rows.where("edge_source = 'threading_synthetic'").select(*key)).distinct()


def missing_runs(edges: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Started threads (with a call site) without an edge to what they run."""
    threads = thread_classes(edges, hierarchy)
    wanted = starts(edges, threads).where(F.length("callsite") > 0)
    return wanted.join(bridged(edges, threads, classes_below(hierarchy, RUNNABLE)), ["analysis_id", "caller", "callsite"], "left_anti")


def validation(edges: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """analysis_id, n_threads, n_runnables (classes below), n_starts, n_synthetic, n_missing. A column of ones and noughts for
    each count is summed once, so no table is joined for its number."""
    names = ("n_threads", "n_runnables", "n_starts", "n_synthetic", "n_missing")
    threads = thread_classes(edges, hierarchy)
    parts = classes_below(hierarchy, THREAD), classes_below(hierarchy, RUNNABLE), starts(edges, threads), edges.where("edge_source = 'threading_synthetic'"), missing_runs(edges, hierarchy)
    rows = edges.select("analysis_id").distinct().select("analysis_id", *(F.lit(0).alias(n) for n in names))
    for name, part in zip(names, parts):
        rows = rows.unionByName(part.select("analysis_id", *(F.lit(int(n == name)).alias(n) for n in names)))
    return rows.groupBy("analysis_id").agg(*(F.sum(n).alias(n) for n in names))


def start_pattern(callee: Column, threads_start: Column) -> Column:
    """How a call hands on work: thread_start (the caller says whether the class is a thread), handler_post, handler_message,
    executor_execute; null if it does not."""
    later = pattern_of(S.class_of(callee), S.method_of(callee), F.get(S.params_of(callee), F.lit(0)))
    return F.when(threads_start & F.contains(callee, F.lit(" void start()")), "thread_start").otherwise(later)


def pattern_of(cls: Column, name: Column, first: Column) -> Column:
    """The same of a call that starts no thread, by class, name and first parameter of its callee."""
    handler = cls == "android.os.Handler"
    return (F.when(handler & name.startswith("post") & (first == RUNNABLE), "handler_post").when(handler & name.startswith("sendMessage") & (first == "android.os.Message"), "handler_message")
            .when(name.isin("execute", "submit") & (first == RUNNABLE), "executor_execute"))


def _listed(rows: DataFrame, place: str, most: int | None) -> DataFrame:
    """analysis_id, the place, run: each run() of the classes of a place once; of the first `most` by name if there is a bound."""
    if most is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("analysis_id", place).orderBy("class"))).where(F.col("_n") <= most)
    return checkpointed(rows.select("analysis_id", place, "run").distinct())


def threading_edges(calls: DataFrame, runs: DataFrame, runnables: DataFrame, most: int | None = None) -> DataFrame:
    """Synthetic edges: analysis_id, caller, callsite, callee, pattern, confidence, edge_source.

    calls: analysis_id, caller, callsite, pattern, thread_new, thread_field, thread_type (classes of the started thread: of its
    `new`, of the `new` that an initialiser puts into its field, declared) and work_new, work_type (the same of the runnable),
    each null where unknown. runs: analysis_id, class, run (the application's run() that a class has or inherits); runnables:
    analysis_id, class. A thread runs its own run() (high, medium, low by how its class is known); a thread without one, and
    handlers and executors, run their runnable's (new: high, type: medium), and where that is unknown those of runnable inner
    classes of the caller, else of its package (low). All of them stand in, unless `most` bounds them to the first by name. They
    are rows that calls meet in a join, never a list, so a large package lies in no single row or task.
    """
    cls = F.coalesce("thread_new", "thread_field", "thread_type")
    sure = F.when(F.col("thread_new").isNotNull(), "high").when(F.col("thread_field").isNotNull(), "medium").otherwise("low")
    # written, so that the planner knows their sizes: what is small is broadcast, and calls are not shuffled for it
    run, able = checkpointed(runs.select("analysis_id", "class", "run")), runnables.join(runs, ["analysis_id", "class"])
    parts = F.split("class", r"\$")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "$"))
    inner = _listed(able.where(F.contains("class", F.lit("$"))).withColumn("owner", F.explode(above)), "owner", most)
    near = _listed(able.withColumn("package", S.package_of(F.col("class"))).where("package <> ''"), "package", most)
    key = ["analysis_id", "caller", "callsite"]
    # calls that ask for nothing are spread: nulls would meet in one task where the other side is too large to be broadcast
    nothing = F.concat(F.lit("?"), F.pmod(F.hash(*key), F.lit(4096)))

    def at(df: DataFrame, asked: Column, other: DataFrame, place: str, found: str, name: str) -> DataFrame:
        other = other.select("analysis_id", F.col(place).alias("_at"), F.col(found).alias(name))
        return df.withColumn("_at", F.coalesce(asked, "_nothing")).join(other, ["analysis_id", "_at"], "left").drop("_at")

    started = F.col("pattern") == "thread_start"
    rows = at(calls.withColumn("_nothing", nothing), F.when(started, cls), run, "class", "run", "own_run")
    # A thread started without a runnable has nothing else to run.
    rest = F.col("own_run").isNull() & (~started | F.col("work_new").isNotNull() | F.col("work_type").isNotNull())
    rows = at(rows, F.when(rest, F.col("work_new")), run, "class", "run", "new_run")
    rows = at(rows, F.when(rest & F.col("new_run").isNull(), F.col("work_type")), run, "class", "run", "type_run")
    told = F.coalesce("own_run", "new_run", "type_run")
    pattern = F.when(F.col("own_run").isNull() & started, "thread_runnable").otherwise(F.col("pattern")).alias("pattern")
    known = F.when(F.col("own_run").isNotNull(), sure).when(F.col("new_run").isNotNull(), "high").when(F.col("type_run").isNotNull(), "medium").otherwise("low")
    # repeats go before a call is multiplied by what stands in for it: told edges and the others differ in pattern or confidence, and
    # no place lists a run() twice. A method's edges stay together from here on, so counts by caller need no shuffle of them
    rows = rows.where(told.isNotNull() | rest).select(*key, told.alias("told"), pattern, known.alias("confidence")).repartition("analysis_id", "caller").distinct()
    rows = rows.withColumn("_nothing", nothing).withColumn("_owner", F.when(F.col("told").isNull(), S.class_of(F.col("caller"))))
    rows = at(rows, F.col("_owner"), inner, "owner", "run", "within")
    rows = at(rows, F.when(F.col("within").isNull(), F.nullif(S.package_of(F.col("_owner")), F.lit(""))), near, "package", "run", "beside")
    rows = rows.withColumn("callee", F.coalesce("told", "within", "beside")).where("callee is not null")
    return rows.select(*key, "callee", "pattern", "confidence").withColumn("edge_source", F.lit("threading_synthetic"))
