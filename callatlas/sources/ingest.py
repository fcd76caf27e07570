"""Readers that bring program-graph artifacts into typed tables, and the writers beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "struct<method:string,class:string,is_android_framework:boolean>"
EDGE = "struct<caller:string,callee:string,callsite:struct<unit:string>,edge_source:string,edge_layer:string,pattern:string,confidence:string>"
CALLBACK = "struct<method:string,type:string,component:string,registration_site:string,registrationSite:string>"
CALLGRAPH = f"nodes array<{NODE}>, edges array<{EDGE}>, callbacks array<{CALLBACK}>"
CATEGORY = "struct<priority:string,description:string,weight:double,requires_slice:boolean,pha_tags:array<string>,permission_hints:array<string>,signatures:struct<methods:array<string>,fields:array<string>,strings:array<string>>>"
CFG = "method string, units array<struct<id:string,stmt:string,succs:array<string>>>"


def read_callgraphs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each call-graph document; analysis_id is the name of its folder."""
    rows = spark.read.schema(CALLGRAPH).option("multiLine", True).json(path)
    return rows.withColumn("analysis_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def nodes(graphs: DataFrame) -> DataFrame:
    return graphs.select("analysis_id", F.posexplode("nodes").alias("ord", "n")).select("analysis_id", "ord", "n.*")


def edges(graphs: DataFrame) -> DataFrame:
    rows = graphs.select("analysis_id", F.posexplode("edges").alias("ord", "e")).select("analysis_id", "ord", "e.*")
    return rows.withColumn("callsite", F.col("callsite.unit")).where((F.length("caller") > 0) & (F.length("callee") > 0))


def callbacks(graphs: DataFrame) -> DataFrame:
    """Both spellings of the registration site are read."""
    rows = graphs.select("analysis_id", F.explode("callbacks").alias("c")).select("analysis_id", "c.*")
    return rows.withColumn("registration_site", F.coalesce("registration_site", "registrationSite")).drop("registrationSite")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """category_id, kind (methods, fields, strings), signature and the category's attributes, one row for each signature."""
    rows = spark.read.schema(f"version string, categories map<string,{CATEGORY}>").option("multiLine", True).json(path)
    cats = rows.select(F.explode("categories").alias("category_id", "c"))
    kinds = F.map_from_arrays(F.array(F.lit("methods"), F.lit("fields"), F.lit("strings")), F.array("c.signatures.methods", "c.signatures.fields", "c.signatures.strings"))
    flat = cats.select("category_id", F.upper("c.priority").alias("priority"), F.col("c.weight").alias("weight"), F.coalesce("c.requires_slice", F.lit(False)).alias("requires_slice"), F.explode(kinds).alias("kind", "s"))
    return flat.select("category_id", "priority", "weight", "requires_slice", "kind", F.explode("s").alias("signature"))


def read_cfgs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(CFG).option("multiLine", True).json(path)
    return rows.select("method", F.posexplode("units").alias("idx", "u")).select("method", "idx", F.col("u.id").alias("unit_id"), F.col("u.stmt").alias("stmt"), F.col("u.succs").alias("succs"))


def read_sources(spark: SparkSession, root: str, most_bytes: int = 1_000_000) -> DataFrame:
    """path, class_name, text of .java and .kt files up to a size, below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{java,kt}").load(root)
    rel = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    base = root.split(":")[-1].rstrip("/")
    inner = F.regexp_replace(rel, f"^.*{base}/", "")
    return files.where(F.col("length") <= most_bytes).select(inner.alias("path"), F.translate(F.regexp_replace(inner, r"\.(java|kt)$", ""), "/", ".").alias("class_name"), F.decode("content", "UTF-8").alias("text"))


def source_of(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """Source of each class: its own file, else its outer class's."""
    exact = sources.select(F.col("class_name").alias("class"), F.col("path").alias("p1"))
    outer = sources.select(F.col("class_name").alias("outer"), F.col("path").alias("p2"))
    rows = classes.withColumn("outer", F.substring_index("class", "$", 1))
    return rows.join(exact, "class", "left").join(outer, "outer", "left").select("class", F.coalesce("p1", "p2").alias("path"))


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """source and sink of the results of a taint report in XML."""
    rows = spark.read.format("xml").option("rowTag", "Result").schema("Sink struct<_Statement:string>, Sources struct<Source:array<struct<_Statement:string>>>").load(path)
    return rows.select(F.explode("Sources.Source").alias("s"), F.col("Sink._Statement").alias("sink")).select(F.col("s._Statement").alias("source"), "sink")


def read_rules_text(spark: SparkSession, path: str) -> DataFrame:
    """signature, kind (source or sink) of lines `signature -> _SOURCE_`; # begins a comment."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & F.col("value").contains("->"))
    return lines.select(F.trim(F.substring_index("value", "->", 1)).alias("signature"), F.when(F.col("value").contains("_SOURCE_"), "source").otherwise("sink").alias("kind"))


def write_table(df: DataFrame, path: str, keys: tuple[str, ...] = ("analysis_id",)) -> None:
    """Overwrite the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def cache_misses(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    return wanted.join(cached, key, "left_anti")


def signature_index(entries: DataFrame) -> DataFrame:
    """signature, category_id of catalog rows (ord, category_id, signature): of a repeated signature the last."""
    return entries.groupBy(F.trim("signature").alias("signature")).agg(F.max_by("category_id", "ord").alias("category_id"))


def read_techniques(spark: SparkSession, path: str) -> DataFrame:
    """technique_id, name, tactics of the attack patterns of a STIX bundle; objects without an id of the source are left out,
    and of a repeated id the last counts."""
    ref, phase = "struct<source_name:string,external_id:string>", "struct<phase_name:string>"
    rows = spark.read.schema(f"objects array<struct<type:string,name:string,external_references:array<{ref}>,kill_chain_phases:array<{phase}>>>").option("multiLine", True).json(path)
    each = rows.select(F.posexplode("objects").alias("ord", "o")).where("o.type = 'attack-pattern'")
    ours = F.filter("o.external_references", lambda r: (r["source_name"] == "mitre-attack") & (F.length(r["external_id"]) > 0))
    named = F.filter(F.coalesce("o.kill_chain_phases.phase_name", F.array().cast("array<string>")), lambda p: F.length(p) > 0)
    flat = each.select("ord", F.get(ours, F.lit(0))["external_id"].alias("technique_id"), F.struct(F.col("o.name").alias("name"), named.alias("tactics")).alias("t")).where("technique_id is not null")
    return flat.groupBy("technique_id").agg(F.max_by("t", "ord").alias("t")).select("technique_id", "t.*")


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """input, run_id of lines `input` or `input,id`, null without an id; blank lines and those that begin with # are left out."""
    line = F.trim("value")
    rows = spark.read.text(path).where((F.length(line) > 0) & ~line.startswith("#"))
    return rows.select(F.trim(F.substring_index(line, ",", 1)).alias("input"), F.when(F.contains(line, F.lit(",")), F.trim(F.regexp_extract(line, r"^[^,]*,(.*)$", 1))).alias("run_id"))


def settings(read: dict, environment: dict[str, str], forced: dict[str, str], usual: dict[str, str], overrides: dict[str, object]) -> dict:
    """Settings as read; then variables of the environment (variable: section.name), the forced ones always, the usual ones
    where nothing is set; then overrides (section.name: value) that are not empty. `read` stays as it is."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in read.items()}
    given = [(key, environment.get(name), True) for name, key in forced.items()] + [(key, environment.get(name), False) for name, key in usual.items()] + [(key, v, True) for key, v in overrides.items()]
    for key, value, always in given:
        section, _, name = key.partition(".")
        if value and (always or not out.get(section, {}).get(name)):
            out.setdefault(section, {})[name] = value
    return out


def read_table(spark: SparkSession, path: str, analysis_id: str | None = None) -> DataFrame:
    """A table that write_table wrote; of one analysis only its folder is read."""
    rows = spark.read.parquet(path)
    return rows if analysis_id is None else rows.where(F.col("analysis_id") == analysis_id)


def delete_analysis(spark: SparkSession, path: str, analysis_id: str) -> bool:
    """Remove one analysis from a table that write_table wrote; whether it was there. The name must be one folder's."""
    if not analysis_id or "/" in analysis_id or analysis_id in (".", ".."):
        raise ValueError(f"not the name of an analysis: {analysis_id!r}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(analysis_id)
    folder = hadoop.Path(path, f"analysis_id={escaped}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and files.delete(folder, True)


def latest_runs(files: DataFrame) -> DataFrame:
    """analysis_id, run_id of the file changed last (analysis_id, run_id, modified); the greater name at a tie."""
    return files.groupBy("analysis_id").agg(F.max_by("run_id", F.struct("modified", "run_id")).alias("run_id"))
