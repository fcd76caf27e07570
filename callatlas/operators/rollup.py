"""Roll-ups of hits: methods, outer classes, packages, and stratified previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signatures as S
from . import rules


def _ordered(value, order: str = "ord"):
    """Values of a group in input order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def groups(hits: DataFrame) -> DataFrame:
    """Hits of one caller: ids and signatures in input order, categories, counts and best of the priorities, mean score (0.5
    if none has one), the first hit as representative."""
    rank = S.priority_rank(F.col("priority"))
    out = hits.groupBy("analysis_id", "caller").agg(
        F.count(F.lit(1)).alias("n_hits"), _ordered(F.col("hit_id")).alias("hit_ids"), _ordered(F.col("callee")).alias("signatures"),
        F.array_sort(F.collect_set("category_id")).alias("categories"), F.min_by("priority", F.struct(rank, F.col("ord"))).alias("priority"),
        *(F.count_if(F.col("priority") == p).alias(f"n_{p.lower()}") for p in rules.RANKS),
        F.coalesce(F.avg("investigability"), F.lit(0.5)).alias("investigability"), F.max("weight").alias("weight"), F.min("ord").alias("ord"), F.min_by("hit_id", "ord").alias("representative"))
    return out.withColumn("group_id", S.sha1_id("grp-", F.col("caller"))).withColumn("caller_class", S.class_of(F.col("caller")))


def blocks(group_rows: DataFrame) -> DataFrame:
    """Groups of one outer class: categories together, sums, best priority, mean score."""
    rows = group_rows.withColumn("outer", S.outer_class(F.col("caller_class")))
    return rows.groupBy("analysis_id", "outer").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n_hits").alias("n_hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories")))).alias("categories"),
        F.min_by("priority", F.struct(S.priority_rank(F.col("priority")), F.col("ord"))).alias("priority"), F.max("weight").alias("weight"),
        F.avg("investigability").alias("investigability"), F.min("ord").alias("ord"),
    ).withColumn("block_id", S.sha1_id("block-", F.col("outer"), length=12))


def package_union(group_rows: DataFrame, examples: int = 3) -> DataFrame:
    """Categories of all groups of a package, their number, and the first classes seen."""
    rows = group_rows.withColumn("package", S.package_of(F.col("caller_class")))
    first = rows.groupBy("analysis_id", "package", "caller_class").agg(F.min("ord").alias("o"), F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set("categories"))).alias("c"))
    return first.groupBy("analysis_id", "package").agg(
        F.sum("n").alias("n_groups"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))).alias("categories"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("o", "caller_class"))), lambda x: x["caller_class"]), 1, examples).alias("examples"))


def inventory(*parts: tuple[str, DataFrame]) -> DataFrame:
    """package and a count from each source; each part is counted by itself before the rows meet."""
    names = [n for n, _ in parts]
    rows = None
    for name, df in parts:
        one = df.groupBy("package").agg(F.count(F.lit(1)).alias("n")).select("package", *(F.col("n").alias(x) if x == name else F.lit(0).cast("bigint").alias(x) for x in names))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("package").agg(*(F.sum(n).alias(n) for n in names))


def dominant(rows: DataFrame, key: str) -> DataFrame:
    """The most frequent values of a column, all of them at a tie."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("n"))), "n").select(key, "n")


def preview_shares(have: dict[str, int], limit: int, shares=(("CRITICAL", 0.4), ("HIGH", 0.3), ("MEDIUM", 0.2), ("LOW", 0.1))) -> dict[str, int]:
    """Rows to take of each priority: its share of the limit; then what is left by how many rows each still has, rounded
    down; then the rest to the priorities with the most rows left, in order of priority at a tie."""
    names = [p for p, _ in shares]
    take = {p: min(have.get(p, 0), int(limit * s)) for p, s in shares}
    spare = {p: have.get(p, 0) - take[p] for p in names}
    left, total = limit - sum(take.values()), sum(spare.values())
    if left > 0 and total > 0:
        for p in names:
            take[p] += min(int(left * spare[p] / total), spare[p])
    for p in sorted(names, key=lambda p: take[p] - have.get(p, 0)):
        take[p] += max(0, min(limit - sum(take.values()), have.get(p, 0) - take[p]))
    return take


def stratified_preview(rows: DataFrame, priority: str, order: list, limit: int) -> DataFrame:
    """At most `limit` rows, shared out among the priorities (preview_shares), in each the first in `order`.

    Only the number of rows of each priority comes to the driver. The rank is bounded by a literal, so each partition keeps
    no more than `limit` rows of a priority before they meet.
    """
    have = {r[priority]: r["n"] for r in rows.groupBy(priority).agg(F.count(F.lit(1)).alias("n")).collect()}
    take = preview_shares(have, limit)
    quota = F.lit(0)
    for p, n in take.items():
        quota = F.when(F.col(priority) == p, n).otherwise(quota)
    numbered = rows.withColumn("stratum_rank", F.row_number().over(Window.partitionBy(priority).orderBy(*order)))
    return numbered.where(F.col("stratum_rank") <= max(take.values())).where(F.col("stratum_rank") <= quota)


def capped(rows: DataFrame, key: list[str], distinct: list[str], order: str, most: int) -> DataFrame:
    """The first `most` different rows of each key, in input order."""
    first = rows.groupBy(*key, *distinct).agg(F.min(order).alias(order))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where(F.col("n") <= most)
