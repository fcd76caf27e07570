"""Column functions over decompiled source text: constants, file paths, log calls, intent extras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip, strip_comments

#: Fixed patterns.
STRING_CONSTANT = r"\b(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?String\s+(\w+)\s*=\s*\"([^\"]+)\""
LITERAL = r"\"([^\"]+)\""
FILE_CALL = r"(FileOutputStream|openFileOutput|setOutputFile|Files\.newOutputStream|new File\()"
LOG_CALL = r"\bLog\.(\w+)\s*\(\s*([^,]+)\s*,\s*([^)]+)\)"
GET_EXTRA = r"\.(get\w+Extra)\s*\(\s*([^,\)]+?)\s*(?:,|\))"
HAS_EXTRA = r"\.hasExtra\s*\(\s*([^)]+?)\s*\)"
PUT_EXTRA = r"\.putExtra\s*\(\s*([^,]+?)\s*,\s*([^)]+?)\s*\)"
SET_ACTION = r"\.setAction\s*\(\s*([^)]+?)\s*\)"
#: Fixed values.
EXTENSIONS = (".zip", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".mp4", ".mp3", ".wav", ".aac", ".txt", ".json", ".db", ".log", ".bin")
FOLDERS = (("cacheDir", "cacheDir/"), ("getCacheDir", "cacheDir/"), ("externalCacheDir", "externalCacheDir/"), ("getExternalCacheDir", "externalCacheDir/"), ("filesDir", "filesDir/"), ("getFilesDir", "filesDir/"), ("externalFilesDir", "externalFilesDir/"), ("getExternalFilesDir", "externalFilesDir/"))
GETTER_TYPES = {"getStringExtra": "string", "getCharSequenceExtra": "string", "getIntExtra": "int", "getBooleanExtra": "boolean", "getLongExtra": "long", "getFloatExtra": "float", "getDoubleExtra": "double", "getParcelableExtra": "parcelable", "getSerializableExtra": "serializable", "getStringArrayExtra": "string_array", "getIntArrayExtra": "int_array"}


def _groups(text: Column, pattern: str, *groups: int) -> list[Column]:
    return [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]


def constants(source: Column) -> Column:
    """array<struct<name,value>> of string constants, of one name the last."""
    names, values = _groups(source, STRING_CONSTANT, 1, 2)
    pairs = F.arrays_zip(names.alias("name"), values.alias("value"))
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["name"] == p["name"]))


def clean_token(token: Column) -> Column:
    bare = F.btrim(strip(token), F.lit(");"))
    return F.replace(strip(F.regexp_replace(bare, r"^\(([^)]+)\)", "")), F.lit("this."), F.lit(""))


def resolve(token: Column, known: Column) -> Column:
    """Text of a literal or constant; null for anything else. known: what constants() gives."""
    t = clean_token(token)
    find = lambda name: F.get(F.transform(F.filter(known, lambda c: c["name"] == name), lambda c: c["value"]), F.lit(0))
    return F.when(t.startswith('"') & t.endswith('"') & (F.length(t) >= 2), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.coalesce(find(t), F.when(t.contains("."), find(F.substring_index(t, ".", -1)))))


def _ends_like_file(literal: Column) -> Column:
    return F.lower(literal).rlike("(" + "|".join(e.replace(".", r"\.") for e in EXTENSIONS) + ")$")


def path_hints(line: Column) -> Column:
    """Paths that a line's literals name, within the folder that the line names, distinct in order; of two or more literals
    also the first and last as `a*b`."""
    literals = F.regexp_extract_all(line, F.lit(LITERAL), F.lit(1))
    folder = F.lit(None).cast("string")
    for key, prefix in reversed(FOLDERS):
        folder = F.when(F.contains(line, F.lit(key)), prefix).otherwise(folder)
    is_file = lambda x: x.contains("/") | _ends_like_file(x)
    within = lambda x: F.when(folder.isNotNull() & ~x.contains("/"), F.concat(folder, x)).otherwise(x)
    single = F.transform(F.filter(literals, lambda x: ~F.lower(x).isin(*EXTENSIONS) & (is_file(x) | folder.isNotNull())), within)
    last = F.element_at(literals, F.lit(-1))
    both = F.when((F.size(literals) >= 2) & is_file(last), F.array(within(F.concat(F.regexp_replace(F.get(literals, F.lit(0)), "^/+", ""), F.lit("*"), last)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(literals) > 0, F.array_distinct(F.concat(single, both))).otherwise(F.array().cast("array<string>"))


def key_of(sources: DataFrame) -> list[str]:
    """class_name, within its analysis where the table has analysis_id."""
    return [c for c in ("analysis_id", "class_name") if c in sources.columns]


def lines_of(sources: DataFrame) -> DataFrame:
    """class_name, known, n, line: the lines of each file without comments, with the file's constants."""
    clean = sources.select(*key_of(sources), strip_comments(F.col("text")).alias("text")).withColumn("known", constants(F.col("text")))
    return clean.select(*key_of(sources), "known", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "line"))


def file_artifacts(sources: DataFrame, most: int = 20) -> DataFrame:
    """class_name, path_hint, line of calls that open files: the first of each path, at most `most` a class."""
    found = lines_of(sources).where(F.col("line").rlike(FILE_CALL)).select(*key_of(sources), "n", "line", F.posexplode(path_hints(F.col("line"))).alias("k", "path_hint"))
    first = found.groupBy(*key_of(sources), "path_hint").agg(F.min(F.struct("n", "k", F.left(strip(F.col("line")), F.lit(200)).alias("line"))).alias("at"))
    ranked = first.groupBy(*key_of(sources)).agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "path_hint"))), 1, most).alias("x"))
    return ranked.select(*key_of(sources), F.explode("x").alias("x")).select(*key_of(sources), "x.path_hint", "x.at.line")


def log_hints(sources: DataFrame, most: int = 30) -> DataFrame:
    """class_name, level, tag, message: the first log call of a line whose tag and message are known; the first of each, at
    most `most` a class."""
    part = lambda g: F.regexp_extract("line", LOG_CALL, g)
    found = lines_of(sources).where(F.col("line").rlike(LOG_CALL)).select(*key_of(sources), "n", F.lower(part(1)).alias("level"), resolve(part(2), F.col("known")).alias("tag"), resolve(part(3), F.col("known")).alias("message")).where("tag is not null and message is not null")
    first = found.groupBy(*key_of(sources), "tag", "message").agg(F.min(F.struct("n", "level")).alias("at"))
    ranked = first.groupBy(*key_of(sources)).agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "tag", "message"))), 1, most).alias("x"))
    return ranked.select(*key_of(sources), F.explode("x").alias("x")).select(*key_of(sources), "x.at.level", "x.tag", "x.message")


def intent_extras(sources: DataFrame) -> DataFrame:
    """class_name, name, type, required, value_hint of each use of an extra; roll up with evidence.required_extras."""
    clean = sources.select(*key_of(sources), strip_comments(F.col("text")).alias("text")).withColumn("known", constants(F.col("text")))
    kind = F.lit(None).cast("string")
    for getter, name in GETTER_TYPES.items():
        kind = F.when(F.col("x.m") == getter, name).otherwise(kind)
    got = clean.select(*key_of(sources), "known", F.explode(F.arrays_zip(*(c.alias(n) for c, n in zip(_groups(F.col("text"), GET_EXTRA, 1, 2), "ma")))).alias("x")).select(*key_of(sources), resolve(F.col("x.a"), F.col("known")).alias("name"), kind.alias("type"), F.lit(False).alias("required"), F.lit(None).cast("string").alias("value_hint"))
    has = clean.select(*key_of(sources), "known", F.explode(_groups(F.col("text"), HAS_EXTRA, 1)[0]).alias("a")).select(*key_of(sources), resolve(F.col("a"), F.col("known")).alias("name"), F.lit(None).cast("string").alias("type"), F.lit(True).alias("required"), F.lit(None).cast("string").alias("value_hint"))
    value = clean_token(F.col("x.v"))
    hint = F.coalesce(resolve(F.col("x.v"), F.col("known")), F.when(value.rlike(r"^(-?\d+|true|false)$"), value))
    put = clean.select(*key_of(sources), "known", F.explode(F.arrays_zip(*(c.alias(n) for c, n in zip(_groups(F.col("text"), PUT_EXTRA, 1, 2), "av")))).alias("x")).select(*key_of(sources), resolve(F.col("x.a"), F.col("known")).alias("name"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("required"), hint.alias("value_hint"))
    return got.union(has).union(put).where("name is not null")


def actions(sources: DataFrame) -> DataFrame:
    clean = sources.select(*key_of(sources), strip_comments(F.col("text")).alias("text")).withColumn("known", constants(F.col("text")))
    found = clean.select(*key_of(sources), "known", F.explode(_groups(F.col("text"), SET_ACTION, 1)[0]).alias("a"))
    return found.select(*key_of(sources), resolve(F.col("a"), F.col("known")).alias("action")).where("action is not null").distinct()


def reflection_targets(source: Column) -> Column:
    """struct<literals,has_call,non_literal> of Class.forName in a source."""
    literals = F.regexp_extract_all(source, F.lit(r"Class\s*\.\s*forName\s*\(\s*\"([^\"]+)\""), F.lit(1))
    return F.struct(literals.alias("literals"), source.rlike(r"Class\s*\.\s*forName\s*\(").alias("has_call"), source.rlike(r"Class\s*\.\s*forName\s*\(\s*[^\"\s)]").alias("non_literal"))
