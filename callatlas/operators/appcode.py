"""Which code is the application's own: classes, methods of paths, call neighbourhoods, and component tables cut to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signatures as S
from .components import is_library

#: Texts of library methods in a call neighbourhood.
NOISE = ("androidx.", "com.google.android.material", "kotlin", "java.", "android.", "com.google.android.gms")
#: Beginnings of platform methods in a path.
PLATFORM = ("<android.", "<java.", "<javax.", "<dalvik.")


def normal_prefix(value: Column) -> Column:
    """a.b, a.b. and a.b.* are all a.b.; a blank is none."""
    bare = F.regexp_replace(F.trim(value), r"\.\*$", "")
    return F.when(F.length(bare) > 0, F.when(bare.endswith("."), bare).otherwise(F.concat(bare, F.lit("."))))


def app_prefixes(components: DataFrame, packages: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """analysis_id, prefix: the manifest's package, the most frequent packages of components that are no library's (all at a
    tie), and prefixes that were chosen by hand (extra: analysis_id, prefix)."""
    names = components.select("analysis_id", "name").distinct().where(F.contains("name", F.lit(".")) & ~is_library(F.col("name")) & ~S.is_framework_name(F.col("name")))
    counts = names.groupBy("analysis_id", F.regexp_extract("name", r"^(.*\.)[^.]*$", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("analysis_id").agg(F.max("n").alias("n"))
    out = counts.join(top, ["analysis_id", "n"]).select("analysis_id", "prefix").union(packages.where(F.length("package") > 0).select("analysis_id", F.col("package").alias("prefix")))
    if extra is not None:
        out = out.union(extra.select("analysis_id", normal_prefix(F.col("prefix")).alias("prefix")).where("prefix is not null"))
    return out.distinct()


def class_kinds(classes: DataFrame, components: DataFrame, prefixes: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """classes (analysis_id, class) plus kind: component (itself or its outer class), else ignored, else app, else library.

    components: analysis_id, name; prefixes as app_prefixes gives them; ignored: analysis_id, prefix. The prefixes of one
    analysis are few and stay together in one array; components are joined by name.
    """
    known = components.select("analysis_id", F.col("name").alias("_name")).distinct()
    rows = classes.withColumn("_outer", S.outer_class(F.col("class")))
    rows = rows.join(known.select("analysis_id", F.col("_name").alias("_outer"), F.lit(True).alias("_by_outer")), ["analysis_id", "_outer"], "left")
    rows = rows.join(known.select("analysis_id", F.col("_name").alias("class"), F.lit(True).alias("_by_name")), ["analysis_id", "class"], "left")
    rows = rows.join(prefixes.groupBy("analysis_id").agg(F.collect_set("prefix").alias("_app")), "analysis_id", "left")
    begins = lambda c: F.coalesce(F.exists(c, lambda p: F.startswith(F.col("class"), p)), F.lit(False))
    skip = F.lit(False)
    if ignored is not None:
        packed = ignored.select("analysis_id", normal_prefix(F.col("prefix")).alias("p")).groupBy("analysis_id").agg(F.collect_set("p").alias("_ignored"))
        rows, skip = rows.join(packed, "analysis_id", "left"), begins("_ignored")
    kind = F.when(F.col("_by_outer") | F.col("_by_name"), "component").when(skip, "ignored").when((F.length("class") > 0) & begins("_app"), "app").otherwise("library")
    return rows.select(*classes.columns, kind.alias("kind"))


def app_methods(methods: Column, package: Column, most: int = 20) -> Column:
    """Methods that name the package, or none of the library texts; the first `most` in order."""
    noise = F.lit("(" + "|".join(p.replace(".", r"\.") for p in NOISE) + ")")
    own = lambda m: F.when(F.length(package) > 0, F.contains(m, package)).otherwise(False)
    return F.slice(F.filter(methods, lambda m: F.coalesce(own(m), F.lit(False)) | ~F.rlike(m, noise)), 1, most)


def path_methods(paths: DataFrame) -> DataFrame:
    """analysis_id, method: different methods of paths (analysis_id, path) that are not the platform's."""
    rows = paths.select("analysis_id", F.explode("path").alias("method"))
    return rows.where(~F.rlike("method", F.lit("^(" + "|".join(p.replace(".", r"\.") for p in PLATFORM) + ")"))).distinct()


def referenced_components(seeds: DataFrame, rows: DataFrame, fallback: int = 10) -> DataFrame:
    """rows (analysis_id, ord, component, ...) of components that the analysis's seeds (component_name, caller) name, by
    themselves, as class of the caller or as its outer class. Where seeds name none: the first `fallback` rows by ord; without
    seeds none."""
    cls = F.nullif(F.regexp_extract("caller", r"^<([^:]+):", 1), F.lit(""))
    named = seeds.select("analysis_id", F.explode(F.array(F.nullif("component_name", F.lit("")), cls, S.outer_class(cls))).alias("component")).where("component is not null").distinct()
    bare = seeds.select("analysis_id").distinct().join(named, "analysis_id", "left_anti")
    first = rows.join(bare, "analysis_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("analysis_id").orderBy("ord"))).where(F.col("_n") <= fallback).drop("_n")
    return rows.join(named, ["analysis_id", "component"], "left_semi").unionByName(first)
