"""Filter interaction audit by inclusion-exclusion.

Documents are reduced to five failure flags. For each of the 32 sets of filters one sum of flag products counts the documents
that fail all of them; every figure of every order follows from these 32 sums, so no order is ever run over the documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, let

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
FULL = SETS - 1
#: What a document counts for: always, as a good one, as a toxic one.
WEIGHTS = ("every", "good", "toxic")


def text_flags(text: Column, least_words: int = 100, distinct: int = 80, capitals: int = 10) -> list[Column]:
    """Failures of the filters that need the text alone: A few words, B repeated words (distinct ones below `distinct` %),
    C many capitals (over `capitals` % of the code points), D one of the characters #$%&*|."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    sizes = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("d")))
    upper, points = F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint"), F.char_length(text).cast("bigint")
    return [sizes["n"] < least_words, 100 * sizes["d"] < distinct * sizes["n"], 100 * upper > capitals * points, text.rlike("[#$%&*|]")]


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k set: fails FILTERS[k]), good, toxic, n: how many documents are alike in these.

    Neither texts nor documents meet: a text is its SHA-256 from the scan on; rows are counted by doc_id and text before they
    meet the labels, and by text before a text's smallest doc_id is found, so that a group of copies is a row for each part.
    """
    text = F.coalesce("text", F.lit(""))
    flags = text_flags(text)
    mask = F.lit(0)
    for k, flag in enumerate(flags):
        mask = mask + F.when(flag, 1 << k).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("key"), F.coalesce("lang", F.lit("")).alias("part"), mask.alias("mask"))
    rows = rows.groupBy("doc_id", "key", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(marked, "doc_id", "left").select("doc_id", "key", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    # rows are distinct by doc_id here, so the smallest one's n is all of its rows
    alike = rows.groupBy("key", "part", "mask", "good", "toxic").agg(F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("at_first"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"))
    return first_of_texts(alike)


def first_of_texts(alike: DataFrame) -> DataFrame:
    """Adds the failure E to groups of rows of one text: those of its smallest doc_id, and those without any, pass. The window is
    over the groups of one text, a few for each part, however many copies it has."""
    smallest = F.min("first").over(Window.partitionBy("key"))
    passing = F.col("no_id") + F.when(F.col("first") == smallest, F.col("at_first")).otherwise(0)
    rows = alike.withColumn("passing", passing)
    two = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    return rows.select("part", "good", "toxic", F.explode(two).alias("x")).select("part", F.col("x.mask").alias("mask"), "good", "toxic", F.col("x.n").alias("n")).where("n > 0")


def joint_failures(rows: DataFrame) -> DataFrame:
    """One row a part and weight: joint[S], for each set S of filters, how many documents fail all of S (those of the empty set
    are all documents), as sums of products of flags."""
    kinds = F.array(F.lit("every"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic")))
    flags = [F.getbit("mask", F.lit(k)).cast("bigint").alias(f) for k, f in enumerate(FILTERS)]
    rows = rows.select("part", "n", *flags, F.explode(kinds).alias("weight")).where("weight is not null")
    products = (" * ".join(["n", *(f for k, f in enumerate(FILTERS) if s >> k & 1)]) for s in range(SETS))
    sums = rows.groupBy("part", "weight").agg(*(F.expr(f"sum({product})").alias(f"j{s}") for s, product in enumerate(products)))
    return sums.select("part", "weight", F.array(*(f"j{s}" for s in range(SETS))).alias("joint"))


def _over_subsets(values: Column, of: Column, term) -> Column:
    """Sum over the subsets S of `of` of (-1)^|S| term(S, values[S])."""
    subsets = F.filter(F.sequence(F.lit(0), F.lit(FULL)), lambda s: s.bitwiseAND(of) == s)
    return F.aggregate(subsets, F.lit(0).cast("bigint"), lambda acc, s: acc + F.when(F.bit_count(s) % 2 == 0, term(s, F.get(values, s))).otherwise(-term(s, F.get(values, s))))


def survivors(joint: Column) -> Column:
    """Möbius inversion: for each set T of filters, how many documents fail none of T."""
    return F.transform(F.sequence(F.lit(0), F.lit(FULL)), lambda t: _over_subsets(joint, t, lambda s, j: j))


def unique_failures(joint: Column, bit: Column) -> Column:
    """How many documents fail the filter `bit` and no other: the survivors of the others, less those of all."""
    kept = survivors(joint)
    return F.get(kept, F.lit(FULL) - bit) - F.get(kept, F.lit(FULL))


def shapley(joint: Column, bit: Column) -> Column:
    """What the filter `bit` removes, summed over all orders. In the game of removals a set S has the Harsanyi dividend
    (-1)^(|S|+1) joint[S], which its members share alike; times the number of orders, a share is an integer."""
    orders = factorial(len(FILTERS))
    share = lambda s, j: F.when(s.bitwiseAND(bit) == bit, -j * F.floor(orders / F.greatest(F.bit_count(s), F.lit(1))).cast("bigint")).otherwise(0)
    return _over_subsets(joint, F.lit(FULL), share)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What five filters remove in each of the 120 orders, for each part of the documents: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns of either are ignored. A part is a value of lang, null
    being the empty string. A to D judge a text alone (see text_flags); E fails rows whose text some smaller doc_id has, in
    any part, removed or not. Null texts are empty: they fail A, pass B, C and D, and are equal to each other. Rows of the
    smallest doc_id of a text pass E, repeated ones too; a null doc_id is neither smaller nor larger than another. Of several
    labels of a doc_id a document is good, or toxic, if one says so; null labels say nothing; rows of a doc_id share labels.
    Every row of docs counts. Long texts are scanned once. An empty table has no part and gives no rows.

    Returns 600 rows a part, zeros included; sums and rows of orders are made in one task a part from 96 numbers.
    """
    joint = joint_failures(failures(docs, labels))
    zero = F.array(*[F.lit(0).cast("bigint")] * SETS)
    parts = joint.groupBy("part").agg(*(F.coalesce(F.any_value(F.when(F.col("weight") == w, F.col("joint")), True), zero).alias(w) for w in WEIGHTS))
    parts = parts.select("part", *WEIGHTS, *(survivors(F.col(w)).alias(f"kept_{w}") for w in WEIGHTS))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)
    of_filter = F.transform(F.split(F.lit(",".join(FILTERS)), ","), lambda x: F.struct(x.alias("letter"), bit(x).alias("bit"), unique_failures(F.col("every"), bit(x)).alias("unique_fails"), shapley(F.col("every"), bit(x)).alias("shapley")))
    parts = parts.withColumn("of_filter", of_filter)
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = lambda k: bit(F.substring("filter_order", k, F.lit(1)))
    before = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda k: k < F.col("step")), F.lit(0), lambda acc, k: acc + at(k))
    steps = steps.withColumn("before", before).withColumn("bit", at(F.col("step")))
    lost = lambda w: F.get(f"kept_{w}", F.col("before")) - F.get(f"kept_{w}", F.col("before") + F.col("bit"))
    own = F.filter("of_filter", lambda f: f["bit"] == F.col("bit"))[0]
    return steps.select(
        "part", "filter_order", "step", F.get("kept_every", F.col("before") + F.col("bit")).alias("kept"), lost("every").alias("removed"),
        (F.get("every", F.col("bit")) - lost("every")).alias("redundant"), own["unique_fails"].alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), own["shapley"].alias("shapley"))
