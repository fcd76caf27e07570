"""Graph operators as rounds of joins. All analyses advance together, so the rounds follow the longest path, not their sum.

Every round writes its frontier to the shared checkpoint folder: lineage stays short, and a lost executor costs one round.
Edges are written once before the first round, so no round computes them again. Where tables have an analysis_id, it is part
of every key: a path never leaves its analysis.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import checkpointed


def keys_of(df: DataFrame) -> list[str]:
    """analysis_id, where the table has it."""
    return [c for c in ("analysis_id",) if c in df.columns]


def _numbered(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their place, from 1, in their key's order. Rows are dealt by range and numbered range by range; only the
    numbers of rows of each range meet, so no task holds all rows of a key."""
    dealt = checkpointed(rows.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(counts, [*key, "_range"]).withColumn(name, (F.col("_before") + F.col("_place")).cast("bigint")).drop("_range", "_place", "_before")


def _grown(found: DataFrame, level: DataFrame, n: int) -> DataFrame:
    """found and round n's level; every eighth round it is written, so that the plan stays short in long loops."""
    both = found.unionByName(level)
    return both if n % 8 else checkpointed(both)


def weighted_distances(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """analysis_id, method, dist, pred: least summed weight from any root, and the method before on such a path.

    edges: analysis_id, caller, callee, weight (whole, positive); roots: analysis_id, method. Of several predecessors the
    one with the least distance, then name, is taken, which is the order in which a heap would settle them. Each round's minimum
    carries it along: one that was taken at a distance that later shrinks makes its callee's distance shrink too, so what is left
    was taken at a final distance. A round reads the edges once and nothing goes through them after the last.
    """
    edges = checkpointed(edges.select("analysis_id", "caller", "callee", "weight").where("weight is not null"))
    state = checkpointed(roots.select("analysis_id", "method").distinct().select("*", F.struct(F.lit(0).cast("bigint").alias("dist"), F.lit(None).cast("bigint").alias("d"), F.lit(None).cast("string").alias("pred")).alias("best")))
    frontier = state.select("analysis_id", F.col("method").alias("caller"), "best.dist")
    while True:
        steps = frontier.join(edges, ["analysis_id", "caller"])
        found = steps.groupBy("analysis_id", F.col("callee").alias("method")).agg(F.min(F.struct((F.col("dist") + F.col("weight")).cast("bigint").alias("dist"), F.col("dist").alias("d"), F.col("caller").alias("pred"))).alias("new"))
        better = found.join(state, ["analysis_id", "method"], "left").where(F.col("best").isNull() | (F.col("new") < F.col("best")))
        better = checkpointed(better.select("analysis_id", "method", "new", (F.col("best").isNull() | (F.col("new.dist") < F.col("best.dist"))).alias("nearer")))
        if better.isEmpty():
            break
        state = checkpointed(state.unionByName(better.select("analysis_id", "method", F.col("new").alias("best"))).groupBy("analysis_id", "method").agg(F.min("best").alias("best")))
        frontier = better.where("nearer").select("analysis_id", F.col("method").alias("caller"), "new.dist")
    return state.select("analysis_id", "method", "best.dist", "best.pred")


def paths(reached: DataFrame, most: int = 20) -> DataFrame:
    """reached plus hops and path: the methods from the root, of which the first `most` are kept.

    Paths are pushed down the predecessor tree level by level.
    """
    level = checkpointed(reached.where(F.col("pred").isNull()).select("analysis_id", "method", F.lit(0).alias("hops"), F.array("method").alias("path")))
    done, rest = level, checkpointed(reached.where(F.col("pred").isNotNull()))
    for n in count(1):
        above = level.select("analysis_id", F.col("method").alias("pred"), "hops", "path")
        grown = F.when(F.size("path") < most, F.concat("path", F.array("method"))).otherwise(F.col("path"))
        level = checkpointed(rest.join(above, ["analysis_id", "pred"]).select("analysis_id", "method", (F.col("hops") + 1).alias("hops"), grown.alias("path")))
        if level.isEmpty():
            break
        done = _grown(done, level, n)
    return reached.join(done, ["analysis_id", "method"])


def bfs_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """analysis_id, method, level, root: first in, first out, from the roots in order of name, along edges in order of ord.

    A method's parent is the one that the queue would reach it from; its place in the queue is a rank within its level.
    """
    edges = checkpointed(edges.select("analysis_id", "caller", F.col("callee").alias("method"), "ord"))
    first = roots.select("analysis_id", "method").distinct()
    level = checkpointed(_numbered(first, ["analysis_id"], ["method"], "rank").select("analysis_id", "method", "rank", F.col("method").alias("root"), F.lit(0).alias("level")))
    seen = level
    for n in count(1):
        steps = level.select("analysis_id", F.col("method").alias("caller"), "rank", "root").join(edges, ["analysis_id", "caller"])
        first = steps.groupBy("analysis_id", "method").agg(F.min(F.struct("rank", "ord", "root")).alias("k")).join(seen.select("analysis_id", "method"), ["analysis_id", "method"], "left_anti")
        first = first.select("analysis_id", "method", F.col("k.rank").alias("parent"), F.col("k.ord").alias("ord"), F.col("k.root").alias("root"))
        level = checkpointed(_numbered(first, ["analysis_id"], ["parent", "ord", "method"], "rank").select("analysis_id", "method", "rank", "root", F.lit(n).alias("level")))
        if level.isEmpty():
            break
        seen = _grown(seen, level, n)
    return seen.select("analysis_id", "method", "level", "root")


def strict_preferred(strict: DataFrame, augmented: DataFrame) -> DataFrame:
    """Distances over the strict graph where there are some, else over the augmented one, with path_layer."""
    a = strict.select("analysis_id", "method", F.col("dist").alias("sd"), F.col("pred").alias("sp"))
    b = augmented.select("analysis_id", "method", F.col("dist").alias("ad"), F.col("pred").alias("ap"))
    both = a.join(b, ["analysis_id", "method"], "full")
    is_strict = F.col("sd").isNotNull()
    return both.select("analysis_id", "method", F.coalesce("sd", "ad").alias("dist"), F.when(is_strict, F.col("sp")).otherwise(F.col("ap")).alias("pred"), F.when(is_strict, "strict").otherwise("augmented").alias("path_layer"))


def k_hop(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """start, method, direction (caller or callee), hop: methods met within k hops of each start; each hop goes on from all
    methods found so far in either direction."""
    key = keys_of(edges)
    links = checkpointed(edges.select(*key, "caller", "callee").distinct())
    frontier = starts.select(*key, F.col("method").alias("start"), "method")
    found = None
    for hop in range(1, k + 1):
        at = frontier.withColumnRenamed("method", "at")
        up = at.join(links.withColumnRenamed("callee", "at"), [*key, "at"]).select(*key, "start", F.col("caller").alias("method"), F.lit("caller").alias("direction"))
        down = at.join(links.withColumnRenamed("caller", "at"), [*key, "at"]).select(*key, "start", F.col("callee").alias("method"), F.lit("callee").alias("direction"))
        new = up.union(down).distinct()
        new = new.join(found, [*key, "start", "method", "direction"], "left_anti") if found is not None else new
        new = new.withColumn("hop", F.lit(hop))
        new = checkpointed(new) if hop < k else new  # nothing goes on from the last hop, the largest
        found = new if found is None else found.unionByName(new)
        frontier = new.select(*key, "start", "method").distinct()
    return found


def closure(links: DataFrame) -> DataFrame:
    """child, ancestor, depth (least) over links child, parent; pairs found before are not walked again, so cycles end."""
    key = keys_of(links)
    up = checkpointed(links.select(*key, F.col("child").alias("ancestor"), "parent").distinct())
    level = up.select(*key, F.col("ancestor").alias("child"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    out = level
    for depth in count(2):
        found = level.join(up, [*key, "ancestor"]).select(*key, "child", F.col("parent").alias("ancestor")).distinct()
        level = checkpointed(found.join(out, [*key, "child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        out = _grown(out, level, depth)
    return out


def resolve_methods(calls: DataFrame, methods: DataFrame, parents: DataFrame, most: int = 25) -> DataFrame:
    """calls (analysis_id, class, name) plus owner: the nearest class, from the called one up, that has the method, among
    `most` classes. methods: analysis_id, class, name; parents: analysis_id, class, parent (one each). Calls that are settled
    leave the loop."""
    have = checkpointed(methods.select("analysis_id", F.col("class").alias("at"), "name", F.lit(True).alias("_has")).distinct())
    up = checkpointed(parents.groupBy("analysis_id", F.col("class").alias("at")).agg(F.min("parent").alias("_up")))
    key = ["analysis_id", "class", "name"]
    left, found = calls.select(*key).distinct().withColumn("at", F.col("class")), None
    for n in range(most):
        seen = checkpointed(left.join(have, ["analysis_id", "at", "name"], "left"))
        done = seen.where("_has").select(*key, F.col("at").alias("owner"))
        found = done if found is None else _grown(found, done, n)
        left = seen.where("_has is null").select(*key, "at").join(up, ["analysis_id", "at"]).select(*key, F.col("_up").alias("at"))
        if left.isEmpty():
            break
    return calls.join(found, key, "left")


def nearest_ancestor(chain: DataFrame, marked: DataFrame, most: int = 15) -> DataFrame:
    """method, component, depth: the nearest method up the predecessor chain (itself included) that is marked, at most `most`
    steps away. chain: method, pred; marked: method, component.
    """
    key = keys_of(chain)
    at = chain.select(*key, "method", F.col("method").alias("at"))
    up = chain.select(*key, F.col("method").alias("at"), "pred")
    out = None
    for depth in range(most + 1):
        hit = at.join(marked.select(*key, F.col("method").alias("at"), "component"), [*key, "at"]).select(*key, "method", "component", F.lit(depth).alias("depth"))
        out = hit if out is None else out.unionByName(hit)
        at = at.join(hit.select(*key, "method").distinct(), [*key, "method"], "left_anti").join(up, [*key, "at"]).where(F.col("pred").isNotNull()).select(*key, "method", F.col("pred").alias("at"))
        at = checkpointed(at)
        if at.isEmpty():
            break
    return out.groupBy(*key, "method").agg(F.min_by(F.struct("component", "depth"), F.struct("depth", "component")).alias("c")).select(*key, "method", "c.*")


def backward_slice(units: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed_id, method, unit_id: units from which a seed's units are reached within their method.

    units: method, unit_id, succs; seeds: seed_id, method, unit_id.
    """
    key = [*keys_of(units), "method"]
    back = checkpointed(units.select(*key, F.col("unit_id").alias("from"), F.explode("succs").alias("unit_id")))
    seen = checkpointed(seeds.select("seed_id", *key, "unit_id").distinct())
    level = seen
    for n in count(1):
        level = checkpointed(level.join(back, [*key, "unit_id"]).select("seed_id", *key, F.col("from").alias("unit_id")).distinct().join(seen, ["seed_id", *key, "unit_id"], "left_anti"))
        if level.isEmpty():
            break
        seen = _grown(seen, level, n)
    return seen


def union_edges(*sources: DataFrame) -> DataFrame:
    """Edges of several sources, one for each caller, callee and call site: that of the earliest source, then ord."""
    rows = None
    for n, s in enumerate(sources):
        one = s.withColumn("source_ord", F.lit(n))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    key = [*keys_of(rows), "caller", "callee", "callsite"]
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("source_ord", "ord")).alias("r")).select(*key, "r.*")


def to_dot(edges: DataFrame, most: int = 500) -> DataFrame:
    """n (edges) and dot text of each analysis; `skipped` where it has more than `most` edges, with an empty graph."""
    line = F.concat(F.lit('  "'), F.col("caller"), F.lit('" -> "'), F.col("callee"), F.lit('";'))
    n = edges.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n"))
    small = edges.join(n.where(F.col("n") <= most), "analysis_id").groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))).alias("x"))
    drawn = small.select("analysis_id", F.concat(F.lit("digraph {\n"), F.array_join(F.transform("x", lambda x: x["l"]), "\n"), F.lit("\n}")).alias("dot"))
    return n.join(drawn, "analysis_id", "left").select("analysis_id", "n", F.coalesce("dot", F.lit("digraph { }")).alias("dot"), F.col("dot").isNull().alias("skipped"))
