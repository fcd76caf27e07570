"""Method bodies out of source text. Counting braces needs a scan with state, so it is one of the few Arrow functions here."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODIFIERS = r"(?:public|private|protected|static|final|synchronized|native|abstract|\s)*"


def method_body(source: str | None, method: str | None, inner: str | None = None, most_lines: int = 100, most_chars: int = 5000) -> str | None:
    """From a method's declaration to the brace that closes it, within an inner class if one is named; cut at the limits."""
    if not source or not method:
        return None
    begin, end = 0, len(source)
    if inner:
        at = re.search(rf"\bclass\s+{re.escape(inner)}\b[^{{]*\{{", source)
        if not at:
            return None
        begin, end = at.end(), _closing(source, at.end() - 1)
    declared = re.compile(rf"^[ \t]*{MODIFIERS}[\w.<>]+(?:\[\])*\s+{re.escape(method)}\s*\([^)]*\)[^;{{]*\{{", re.M)
    found = declared.search(source, begin, end)
    if not found:
        return None
    body = source[found.start() : _closing(source, found.end() - 1)].strip("\n")
    lines = body.split("\n")
    cut = "\n".join(lines[:most_lines] + (["    // ... truncated"] if len(lines) > most_lines else []))
    return cut if len(cut) <= most_chars else cut[:most_chars] + "\n// ... truncated"


def _closing(source: str, opening: int) -> int:
    """Place after the brace that closes the one at `opening`; the end of the text if none does."""
    depth = 0
    for m in re.finditer(r"[{}]", source[opening:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return opening + m.end()
    return len(source)


def method_sources(methods: DataFrame, sources: DataFrame, most_lines: int = 100, most_chars: int = 5000) -> DataFrame:
    """method, class, source of methods (method, class, short) whose class or outer class has a file (class_name, text)."""
    rows = methods.withColumn("outer", F.substring_index("class", "$", 1)).join(sources.withColumnRenamed("class_name", "outer"), "outer", "left")
    rows = rows.select("method", "class", "short", F.when(F.col("class").contains("$"), F.substring_index("class", "$", -1)).alias("inner"), "text")

    def run(batches):
        for batch in batches:
            bodies = [method_body(t, m, i, most_lines, most_chars) for t, m, i in zip(batch["text"].to_pylist(), batch["short"].to_pylist(), batch["inner"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["method"], batch["class"], pa.array(bodies, pa.string())], ["method", "class", "source"])

    return rows.mapInArrow(run, "method string, class string, source string")


def ir_summary(units: DataFrame, most: int = 100) -> DataFrame:
    """Statements, invoked methods and field accesses of each method's first units, their number, and whether some were cut.
    units: method, idx, stmt, and analysis_id, where each analysis has its own methods. Units are cut before they are collected,
    so a row holds `most` of them, however long its method is."""
    key = [c for c in ("analysis_id", "method") if c in units.columns]
    whole = Window.partitionBy(*key)
    numbered = units.select(*key, "idx", "stmt", F.row_number().over(whole.orderBy("idx", "stmt")).alias("_n"), F.count(F.lit(1)).over(whole).alias("unit_count"))
    per = numbered.where(F.col("_n") <= most).groupBy(*key, "unit_count").agg(F.array_sort(F.collect_list(F.struct("_n", "stmt"))).alias("x"))
    statements = F.filter(F.transform("x", lambda u: u["stmt"]), lambda s: F.length(s) > 0)
    calls = F.filter(F.transform(F.filter("statements", lambda s: s.contains("invoke")), lambda s: F.regexp_extract(s, "<([^>]+)>", 1)), lambda s: F.length(s) > 0)
    out = per.withColumn("statements", statements)
    return out.select(*key, "statements", calls.alias("invoked_methods"), F.filter("statements", lambda s: s.contains(".<") & s.contains(": ")).alias("field_accesses"), "unit_count", (F.col("unit_count") > most).alias("truncated"))


def lookup_strategy(has_source: Column, has_ir: Column) -> Column:
    return F.when(has_source & has_ir, "jadx_with_jimple").when(has_source, "jadx").when(has_ir, "jimple_only").otherwise("not_found")
