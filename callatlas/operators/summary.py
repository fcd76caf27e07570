"""Co-occurrence patterns beyond one group: of whole applications, packages, entrypoints and blocks, and their order.

Group rows: analysis_id, ord, group_id, caller, caller_class, categories and, where texts were searched, string_categories.
Categories come from a catalog, so a set of them is small however many groups a key has; examples are least rows, combined
before the shuffle. Null categories and groups without any count as groups and add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signatures as S
from . import rules

_NONE = "array<string>"


def all_categories(api: Column, strings: Column | None = None) -> Column:
    """Categories of calls and of texts together, sorted and distinct, without nulls and blanks."""
    none = F.array().cast(_NONE)
    both = F.coalesce(api, none) if strings is None else F.concat(F.coalesce(api, none), F.coalesce(strings, none))
    return F.array_sort(F.array_distinct(F.filter(both, lambda c: F.length(c) > 0)))


def _with_categories(group_rows: DataFrame) -> DataFrame:
    strings = F.col("string_categories") if "string_categories" in group_rows.columns else None
    return group_rows.withColumn("categories", all_categories(F.col("categories"), strings))


def _united(rows: DataFrame, key: list[str], example: Column) -> DataFrame:
    """n_groups, categories and examples (map of a category to its first example) of each key."""
    flat = rows.select(*key, "ord", example.alias("_example"), F.posexplode_outer("categories").alias("_pos", "category"))
    per = flat.groupBy(*key, "category").agg(F.min_by("_example", "ord").alias("e"), F.count_if(F.coalesce("_pos", F.lit(0)) == 0).alias("n"))
    found = F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("category", "e"))))
    out = per.groupBy(*key).agg(F.sum("n").alias("n_groups"), found.alias("_found"))
    return out.select(*key, "n_groups", F.col("_found.category").alias("categories"), F.map_from_entries("_found").alias("examples"))


def app_patterns(group_rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """analysis_id, n_groups, categories, examples, patterns: what all groups of an application satisfy together."""
    rows = _with_categories(group_rows)
    return rules.with_patterns(_united(rows, ["analysis_id"], F.struct("group_id", "caller_class", "caller")), "categories", patterns)


def pattern_examples(app_rows: DataFrame) -> DataFrame:
    """analysis_id, pattern_id, category, group_id, caller_class, caller: which group shows each category of a pattern first."""
    each = app_rows.select("analysis_id", "categories", "examples", F.explode("patterns").alias("p"))
    named = each.select("analysis_id", "examples", F.col("p.pattern_id").alias("pattern_id"), F.explode(rules.evidence(F.col("p"), F.col("categories"))).alias("category"))
    return named.select("analysis_id", "pattern_id", "category", F.col("examples")[F.col("category")].alias("e")).select("analysis_id", "pattern_id", "category", "e.*")


def _top(rows: DataFrame, name: str, most: int) -> DataFrame:
    """The first rows of each analysis that satisfy a pattern: most patterns, then most groups, then the name."""
    order = Window.partitionBy("analysis_id").orderBy(F.desc(F.size("patterns")), F.desc("n_groups"), name)
    return rows.where(F.size("patterns") > 0).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def package_patterns(group_rows: DataFrame, patterns: DataFrame, most: int = 50) -> DataFrame:
    """Packages whose groups satisfy a pattern together, with the first three classes, in order (place), the first `most`."""
    rows = _with_categories(group_rows).withColumn("package", S.package_of(F.col("caller_class"))).where("package <> ''")
    key = ["analysis_id", "package"]
    first = rows.groupBy(*key, "caller_class").agg(F.min("ord").alias("o"))
    early = first.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("o"))).where("n <= 3")
    classes = early.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "caller_class")))["caller_class"].alias("classes"))
    united = _united(rows, key, F.col("group_id")).drop("examples")
    return _top(rules.with_patterns(united.join(classes, key), "categories", patterns), "package", most)


def entrypoint_union(group_rows: DataFrame, patterns: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """analysis_id, entrypoint, n_groups, categories, patterns, example_path (25 methods), shortest_path_len.

    group_rows also have reachable, example_path, path_len. reached (analysis_id, method, root, path, distance: a breadth-first
    search from the entrypoints) decides for callers it has; others go to the first method of their own path, if they are
    reachable, and are left out otherwise. The path is that of the first shortest group, or of the first where none has a length.
    """
    rows = _with_categories(group_rows)
    own = F.when(F.col("reachable"), F.nullif(F.get("example_path", F.lit(0)), F.lit("")))
    if reached is None:
        rows = rows.withColumn("entrypoint", own)
    else:
        found = reached.select("analysis_id", F.col("method").alias("caller"), "root", F.col("path").alias("_path"), F.col("distance").alias("_len"))
        rows = rows.join(found, ["analysis_id", "caller"], "left")
        known = F.col("root").isNotNull()
        rows = rows.withColumn("entrypoint", F.coalesce("root", own)).withColumn("example_path", F.when(known, F.col("_path")).otherwise(F.col("example_path")))
        rows = rows.withColumn("path_len", F.when(known, F.col("_len")).otherwise(F.col("path_len")))
    key = ["analysis_id", "entrypoint"]
    rows = rows.where(F.col("entrypoint").isNotNull())
    shortest = rows.groupBy(*key).agg(F.min_by("example_path", F.struct(F.col("path_len").isNull(), "path_len", "ord")).alias("p"), F.min("path_len").alias("shortest_path_len"))
    united = _united(rows, key, F.col("group_id")).drop("examples").join(shortest, key)
    united = united.withColumn("example_path", F.slice(F.coalesce("p", F.array().cast(_NONE)), 1, 25)).drop("p")
    return rules.with_patterns(united, "categories", patterns)


def top_entrypoints(union_rows: DataFrame, most: int = 50) -> DataFrame:
    return _top(union_rows, "entrypoint", most)


def level_summary(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """analysis_id, n, n_with_patterns, counts: rows of a level (groups or blocks), those that satisfy any pattern, and how many
    satisfy each, as structs pattern_id and n in order of definition."""
    found = rules.with_patterns(_with_categories(rows), "categories", patterns)
    flat = found.select("analysis_id", F.size("patterns").alias("_size"), F.posexplode_outer("patterns").alias("_pos", "p"))
    head = F.coalesce("_pos", F.lit(0)) == 0
    per = flat.groupBy("analysis_id", F.col("p.ord").alias("_ord"), F.col("p.pattern_id").alias("pattern_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(head).alias("_rows"), F.count_if(head & (F.col("_size") > 0)).alias("_some"))
    counts = F.array_sort(F.collect_list(F.when(F.col("_ord").isNotNull(), F.struct("_ord", "pattern_id", "n"))))
    out = per.groupBy("analysis_id").agg(F.sum("_rows").alias("n"), F.sum("_some").alias("n_with_patterns"), counts.alias("c"))
    return out.withColumn("counts", F.transform("c", lambda x: F.struct(x["pattern_id"].alias("pattern_id"), x["n"].alias("n")))).drop("c")


def kept_blocks(block_rows: DataFrame) -> DataFrame:
    """Blocks of the application, and library blocks that satisfy a pattern (is_library, patterns)."""
    return block_rows.where(~F.col("is_library") | (F.size("patterns") > 0))


def block_order(block_rows: DataFrame) -> DataFrame:
    """place of each block in its analysis: effective priority, then raw score and investigability, both falling, then ord."""
    order = Window.partitionBy("analysis_id").orderBy(S.priority_rank(F.col("effective_priority")), F.desc("raw_score"), F.desc("investigability"), "ord")
    return block_rows.withColumn("place", F.row_number().over(order))


def inventory_preview(rows: DataFrame, least_hits: int = 1, most: int = 80) -> DataFrame:
    """Packages of an analysis with enough hits: most hits, then most methods, then the name; the first `most`."""
    order = Window.partitionBy("analysis_id").orderBy(F.desc("n_hits"), F.desc("n_methods"), "package")
    return rows.where(F.coalesce("n_hits", F.lit(0)) >= least_hits).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def callgraph_summary(nodes: DataFrame, edges: DataFrame, entries: DataFrame, most: int = 50) -> DataFrame:
    """analysis_id, n_nodes, n_edges, sources (structs edge_source and n, sorted), n_entrypoints, entrypoints (the first `most`
    by name). Each table is counted by itself before the counts meet."""
    n = nodes.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    by = edges.groupBy("analysis_id", "edge_source").agg(F.count(F.lit(1)).alias("n"))
    e = by.groupBy("analysis_id").agg(F.sum("n").alias("n_edges"), F.array_sort(F.collect_list(F.struct("edge_source", "n"))).alias("sources"))
    one = entries.select("analysis_id", "method").distinct()
    total = one.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n_entrypoints"))
    first = one.withColumn("_n", F.row_number().over(Window.partitionBy("analysis_id").orderBy("method"))).where(F.col("_n") <= most)
    named = first.groupBy("analysis_id").agg(F.array_sort(F.collect_list("method")).alias("entrypoints"))
    out = n.join(e, "analysis_id", "full").join(total, "analysis_id", "full").join(named, "analysis_id", "left")
    return out.na.fill(0, ["n_nodes", "n_edges", "n_entrypoints"])
