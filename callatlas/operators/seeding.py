"""Seeds: sensitive call sites of each analysis from the surest source that has any.

catalog: signature, category, ord; of a repeated signature the last category counts. A search source has the files in which a
method's name was found: analysis_id, method_name, file_path, ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signatures as S

#: How sure a seed is, by source: calls that were read, a remote and a local search for the method's name.
CONFIDENCE = {"calls": 1.0, "remote": 0.4, "local": 0.3}
#: Files that a search gives for a name, and least length of a name that is searched.
HITS, NAME = 10, 3
_COLUMNS = ("analysis_id", "seed_id", "source", "category", "signature", "caller_method", "caller_class", "place", "confidence")


def categories(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("signature").agg(F.max_by("category", "ord").alias("category"))


def _rows(found: DataFrame, source: str, origin: str, method: Column, owner: Column, place: Column) -> DataFrame:
    seed = F.sha1(F.concat_ws("|", origin, "signature", F.coalesce(place.cast("string"), F.lit("None"))))
    out = found.select("analysis_id", seed.alias("seed_id"), F.lit(source).alias("source"), "category", "signature", method.alias("caller_method"), owner.alias("caller_class"), place.cast("string").alias("place"), F.lit(CONFIDENCE[source]).alias("confidence"))
    return out.select(*_COLUMNS)


def from_calls(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Seeds of calls (analysis_id, caller, callee, offset) whose callee is in the catalog."""
    found = calls.join(categories(catalog).withColumn("callee", F.col("signature")), "callee")
    return _rows(found, "calls", "caller", F.col("caller"), S.class_of(F.col("caller")), F.col("offset"))


def from_search(hits: DataFrame, catalog: DataFrame, source: str, most: int = HITS) -> DataFrame:
    """Seeds of files that a search for the names of the catalog's methods found, `most` for each name, cut before the join with
    the signatures of that name. A file that is not named is UNKNOWN."""
    named = categories(catalog).withColumn("method_name", S.method_of(F.col("signature"))).where(F.length("method_name") >= NAME)
    first = Window.partitionBy("analysis_id", "method_name").orderBy("ord", "file_path")
    cut = hits.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    return _rows(cut.join(named, "method_name"), source, "method_name", F.coalesce("file_path", F.lit("UNKNOWN")), F.lit("UNKNOWN"), F.col("file_path"))


def first_with_any(*sources: DataFrame) -> DataFrame:
    """Rows of the first source that an analysis has any in. One plan: every row is marked with its source's place, and the least
    place of its analysis, found by a combined minimum, keeps it; nothing is asked on the driver."""
    every = None
    for place, rows in enumerate(sources):
        marked = rows.withColumn("_place", F.lit(place))
        every = marked if every is None else every.unionByName(marked)
    best = every.groupBy("analysis_id").agg(F.min("_place").alias("_place"))
    return every.join(best, ["analysis_id", "_place"], "left_semi").drop("_place")


def seeds(calls: DataFrame, remote: DataFrame, local: DataFrame, catalog: DataFrame) -> DataFrame:
    """analysis_id, seed_id (SHA-1 of caller or searched name, signature and place), source, category, signature, caller_method,
    caller_class, place, confidence: seeds from calls, for analyses without
    any from a remote search, and for those without either from a local one. Repeated rows give repeated seeds."""
    return first_with_any(from_calls(calls, catalog), from_search(remote, catalog, "remote"), from_search(local, catalog, "local"))
