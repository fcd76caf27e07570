"""Mixing sources to target weights with hash-threshold histograms: no sort of the documents, no sampling noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._common import WORD, durable

HASH_BITS = 60
#: Each level of the histogram splits a bucket into 2**15, so four levels reach single hash values.
LEVEL_BITS = 15
#: Tables of one row a source are broadcast up to so many sources (a few MB), else joined as they come.
FEW_SOURCES = 50_000


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], most: float) -> list[tuple[str | None, int, float]]:
    """(source, size, target): by code point, null last, weights repeat; no target above `most` times its source's size,
    what is cut off goes to the others by weight until none is above."""
    rows = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[k % len(weights)] for k in range(len(rows))]
    total, capped = sum(n for _, n in rows), set()
    while True:
        rest = sum(w for k, w in enumerate(weight) if k not in capped)
        level = (total - sum(most * rows[k][1] for k in capped)) / rest if rest else 0.0
        above = {k for k, (_, n) in enumerate(rows) if k not in capped and level * weight[k] > most * n}
        if not above:
            break
        capped |= above
    return [(s, n, float(most * n) if k in capped else level * weight[k]) for k, (s, n) in enumerate(rows)]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW_SOURCES else df


def _boundaries(part: DataFrame, shift: int) -> DataFrame:
    """The bucket of each source in which its budget ends: source, rem (what is left of it there), bucket, rows, words."""
    sums = part.groupBy("source", "rem", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("before", upto - F.col("words"))
    return sums.where((F.col("before") <= F.col("rem")) & (F.col("rem") < F.col("before") + F.col("words"))).select(
        "source", (F.col("rem") - F.col("before")).alias("rem"), "bucket", "rows", "words")


def _measured(docs: DataFrame, *more) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(*more, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                       F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("bigint").alias("h"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, carry: bool = False) -> DataFrame:
    """How many words of each document a mix takes whose sources hold given shares.

    docs: doc_id, text, source; other columns are ignored. A document's size is its number of words (null text: 0).
    Sources in code point order, null last as a source of its own, weigh weights[0], weights[1], ... repeating and share
    the sum of all sizes; a target stops at `most` times its source's size and the excess is shared again by weight.

    Each source takes whole passes over all its documents as often as they fit and, for the rest of the budget, the
    documents whose hash lies below a threshold. Thresholds for smaller budgets are nested in those for larger ones.
    They come from sums of words by source and hash bucket: only the bucket in which a budget ends is split further, so a
    level holds at most 2**15 sums a source, and the documents are filtered, not sorted. The document at the threshold
    gives the words that are left; rows that share its hash (repeated doc_ids, null doc_ids) share them in proportion,
    rounded down. Only the list of sources, one row each, comes to the driver.

    Returns one row for each row of docs: doc_id, source, size, source_size, target, taken, and with `carry` the whole row
    as struct `row`. An empty table gives no rows.
    Reruns agree, as the hash is of doc_id alone.
    """
    sized = durable(_measured(docs))
    sizes = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    plan = []
    for source, n, target in source_targets(sizes, weights, most):
        words = int(target + 0.5)
        plan.append((source, n, target, words // n if n else 0, words % n if n else 0))
    spark = docs.sparkSession
    fields = "source string, source_size bigint, target double, passes bigint, rem bigint"
    budgets = spark.createDataFrame(plan, fields)
    marks = {p[0]: (0, 0, 0, 1) for p in plan}  # source: all below lo, of [lo, hi) rem of so many words
    open_ = spark.createDataFrame([(p[0], p[4], 0) for p in plan if p[4]], "src string, rem bigint, lo bigint")
    shift = HASH_BITS
    while shift and not open_.isEmpty():
        within = sized.join(_small(open_, len(plan)), sized["source"].eqNullSafe(open_["src"]) & (F.shiftright("h", shift) == F.shiftright("lo", shift)))
        shift -= LEVEL_BITS
        found = _boundaries(within.select("source", "rem", "h", "size"), shift).collect()
        for r in found:
            marks[r["source"]] = (r["bucket"] << shift, (r["bucket"] + 1) << shift, r["rem"], r["words"])
        open_ = spark.createDataFrame([(r["source"], r["rem"], r["bucket"] << shift) for r in found if r["rows"] > 1 and r["rem"]], "src string, rem bigint, lo bigint")
    limits = spark.createDataFrame([(s, *m) for s, m in marks.items()], "s string, lo bigint, hi bigint, left_over bigint, words bigint")
    budgets = budgets.join(limits, budgets["source"].eqNullSafe(limits["s"])).drop("s").withColumnRenamed("source", "src")
    exact = F.expr("cast(size as decimal(18,0)) * cast(left_over as decimal(18,0)) div cast(words as decimal(18,0))")
    extra = F.when(F.col("h") < F.col("lo"), F.col("size")).when(F.col("h") < F.col("hi"), exact).otherwise(F.lit(0))
    rows = _measured(docs, F.struct(*docs.columns).alias("row")) if carry else sized
    return rows.join(_small(budgets, len(plan)), rows["source"].eqNullSafe(budgets["src"])).select(
        *(["row"] if carry else []), "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("passes") + extra).cast("bigint").alias("taken"))
