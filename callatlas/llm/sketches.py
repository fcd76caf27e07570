"""Document fingerprints: threshold-scaled sketches, with DataFrame functions only.

A sketch holds every shingle hash below a fixed fraction of the hash range. Its size follows the text's, so sketches of very
unequal documents still compare by containment, and the sketch of a union is the union of the sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, durable


def word_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))


def sketch(hashes: Column, shingle: int = 5, fraction: float = 1 / 8) -> Column:
    """Sorted distinct hashes below `fraction` of the range, of the shingles of an array of word hashes.

    `hashes` must be a column of a table, not an expression: it is looked up for every word. A text of fewer words, but
    not none, is one shingle; one without words has an empty sketch.
    """
    n = F.size(hashes)
    gram = lambda h, i: F.when(i <= n - shingle, F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, shingle))))
    whole = F.when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.expr("cast(array() as array<bigint>)"))
    grams = F.when(n >= shingle, F.transform(hashes, gram)).otherwise(whole)
    bound = int(fraction * (1 << 63))
    return F.sort_array(F.array_distinct(F.filter(grams, lambda x: F.shiftrightunsigned(x, 1) < F.lit(bound))))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return F.sort_array(F.array_union(a, b))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; where both are empty, 1 for equal texts and else 0."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(same.cast("double"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; null where a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def text_of(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def next_keys(keys: DataFrame, partitions: int | None = None) -> DataFrame:
    """d, z, th and the same of the row that follows in descending order of doc_id (null last, ties by th); the first row
    follows the last.

    keys: d, z, th, n, distinct by d, z, th. Rows are dealt by range and each range is ordered by itself; only the first
    row of each range comes to the driver, to link the ranges, so no task orders all keys.
    """
    spark = keys.sparkSession
    order = [F.col("z"), F.col("d").desc(), F.col("th")]
    dealt = keys.repartitionByRange(partitions, *order) if partitions else keys.repartitionByRange(*order)
    dealt = durable(dealt.withColumn("range", F.spark_partition_id()))
    one = F.struct("d", "z", "th", "n")
    firsts = [(r["range"], r["one"]) for r in dealt.groupBy("range").agg(F.min_by(one, F.struct("z", F.bitwise_not("d"), "th")).alias("one")).orderBy("range").collect()]
    after = [(a[0], *b[1]) for a, b in zip(firsts, firsts[1:] + firsts[:1])]
    wrap = spark.createDataFrame(after, "range int, fd bigint, fz boolean, fth bigint, fn int")
    lead = F.lead(one).over(Window.partitionBy("range").orderBy(*order))
    found = dealt.withColumn("next", lead).join(wrap, "range")
    following = F.coalesce("next", F.struct(F.col("fd").alias("d"), F.col("fz").alias("z"), F.col("fth").alias("th"), F.col("fn").alias("n")))
    return found.select("d", "z", "th", "n", following.alias("next"))


def edited_sketches(docs: DataFrame, shingle: int = 5, fraction: float = 1 / 8) -> DataFrame:
    """Sketches of each text and of its edited text, and how alike they are.

    docs: doc_id, text; other columns are ignored. Null texts are empty. The edited text has its last floor(n_chars / 3)
    code points replaced by the first as many, or all, of the next document's, in descending order of doc_id (null last;
    different texts of one doc_id in order of their hash; repeated rows follow each other); after the last comes the first.
    A single document is its own next.

    The order is found on keys alone. Texts are then shuffled once, by key, and of each text only the part that its
    predecessor needs goes to it, with the sketch. Returns one row for each row of docs: doc_id, n_chars, edited, sketch,
    edited_sketch, near_edited, near_next, contained (share of the sketch that the edited text's holds). An empty table
    gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).select(
        F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("z"), F.xxhash64("text").alias("th"), "text")
    keys = rows.select("d", "z", "th", F.char_length("text").alias("n")).distinct()
    links = durable(next_keys(keys))
    own = links.select("d", "z", "th", "n")
    wanted = links.select("next.d", "next.z", "next.th", F.col("d").alias("pd"), F.col("z").alias("pz"), F.col("th").alias("pth"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    key = ["d", "z", "th"]
    sketched = rows.withColumn("hashes", word_hashes(F.col("text"))).withColumn("sketch", sketch(F.col("hashes"), shingle, fraction)).drop("hashes")
    sketched = sketched.repartition(*key)
    copy = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    heads = sketched.join(wanted, key).withColumn("copy", copy).where("copy = 1").select(
        F.col("pd").alias("d"), F.col("pz").alias("z"), F.col("pth").alias("th"), F.expr("left(text, k)").alias("head"), F.col("sketch").alias("next_sketch"), F.struct(*key).alias("next"))
    full = sketched.join(own, key).withColumn("copy", copy).join(heads, key)
    last = F.col("copy") == 1
    cut = F.floor(F.col("n") / 3).cast("int")
    full = full.select(
        *key, "n", "text", "sketch", F.when(last, F.col("next_sketch")).otherwise(F.col("sketch")).alias("next_sketch"), (~last | (F.col("next.th") == F.col("th"))).alias("next_same"),
        F.concat(F.expr("left(text, n - cast(floor(n / 3) as int))"), F.when(last, F.col("head")).otherwise(F.left(F.col("text"), cut))).alias("edited"))
    full = full.withColumn("hashes", word_hashes(F.col("edited"))).withColumn("edited_sketch", sketch(F.col("hashes"), shingle, fraction))
    return full.select(
        F.when(~F.col("z"), F.col("d")).alias("doc_id"), F.col("n").cast("bigint").alias("n_chars"), "edited", "sketch", "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch"), F.col("edited") == F.col("text")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), F.col("next_same")).alias("near_next"), containment(F.col("sketch"), F.col("edited_sketch")).alias("contained"))
