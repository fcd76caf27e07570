"""Grounding of claims: whether the words and the addresses of a fact occur in the statements that it names, or near them.

facts: seed_id, idx, fact, support_unit_ids; units: seed_id, unit_id, stmt, text of one unit once; strings: seed_id, text: texts
near a seed. Where facts have an analysis_id, it is part of every key. A fact meets the statements that it names only, through
equal keys; no pair of a seed's facts and units is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import let, semantic_tokens

#: Texts of a seed that count, the first by order.
STRINGS = 200
#: What an address looks like, by label, in the order in which faults are named.
ADDRESSES = (("url", r"(?i)https?://[^\s\"'<>]+"), ("ip", r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), ("domain", r"\b[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"))
REPAIR = "Only claim facts directly supported by unit_ids and matching statement text."
_FAULT = "struct<place:int,severity:string,reason:string,overlap_ratio:double>"


def _key(facts: DataFrame) -> list[str]:
    return [c for c in ("analysis_id", "seed_id") if c in facts.columns]


def tokens(text: Column) -> Column:
    """Words of three characters or more of a claim, repeats included, in lower case."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z0-9_.$]+"), F.lit(0)), lambda w: F.length(w) > 2)


def supported(facts: DataFrame, units: DataFrame) -> DataFrame:
    """facts plus statements (those that a fact names, in its order, joined by blanks; an unknown one is empty; null if it names none)
    and missing (the unknown ids)."""
    key = _key(facts)
    named = facts.select(*key, "idx", F.posexplode("support_unit_ids").alias("place", "unit_id"))
    met = named.join(units.select(*key, "unit_id", "stmt", F.lit(True).alias("_known")), [*key, "unit_id"], "left")
    one = F.struct("place", F.coalesce("stmt", F.lit("")).alias("stmt"))
    per = met.groupBy(*key, "idx").agg(F.array_sort(F.collect_list(one)).alias("x"), F.array_sort(F.collect_set(F.when(F.col("_known").isNull(), F.col("unit_id")))).alias("missing"))
    per = per.select(*key, "idx", F.array_join(F.transform("x", lambda u: u["stmt"]), " ").alias("statements"), "missing")
    none = F.expr("cast(array() as array<string>)")
    return facts.join(per, [*key, "idx"], "left").withColumn("missing", F.coalesce("missing", none))


def _overlap(rows: DataFrame) -> DataFrame:
    """rows plus n_tokens, n_met, n_direct: words of the claim, those that the statements have or stand for, and those that they have
    as they are."""
    # what a lambda asks for is bound once for a row; a column that only a lambda names would be computed for each word
    said = F.lower(F.coalesce("statements", F.lit("")))
    words = F.array_distinct(F.filter(F.split(said, r"\s+"), lambda w: F.length(w) > 0))
    direct = lambda x: lambda t: F.contains(x["said"], t)
    named = lambda x, t: F.exists(x["names"], lambda n: F.contains(n, t) | F.contains(t, n)) | F.exists(x["words"], lambda w: F.contains(t, w))
    claim, said = tokens(F.coalesce("fact", F.lit(""))).alias("tokens"), said.alias("said")
    names = semantic_tokens(F.coalesce("statements", F.lit(""))).alias("names")
    met = let(F.struct(claim, said, names, words.alias("words")), lambda x: F.size(F.filter(x["tokens"], lambda t: direct(x)(t) | named(x, t))))
    as_said = let(F.struct(claim, said), lambda x: F.size(F.filter(x["tokens"], direct(x))))
    return rows.withColumns({"n_tokens": F.size(claim), "n_met": met, "n_direct": as_said})


def _percent(ratio: Column, places: int) -> Column:
    return F.concat(F.format_string(f"%.{places}f", F.bround(ratio * 100, places)), F.lit("%"))


def _of_words(strict: bool, least: float) -> Column:
    """Faults of a claim's words: in strict mode that none is in the statements; else a low (under `least`) or a moderate (under
    half) share of them, which is a warning or information."""
    judged = (F.col("n_tokens") > 0) & (F.length("statements") > 0)
    ratio = F.when(F.col("n_tokens") > 0, F.col("n_met") / F.col("n_tokens")).otherwise(0.0)
    fault = lambda severity, reason, r: F.array(F.struct(F.lit(0).alias("place"), F.lit(severity).alias("severity"), reason.alias("reason"), r.alias("overlap_ratio"))).cast(f"array<{_FAULT}>")
    none = F.expr(f"cast(array() as array<{_FAULT}>)")
    if strict:
        return F.when(judged & (F.col("n_direct") == 0), fault("error", F.lit("No token overlap with supporting statements"), F.lit(None).cast("double"))).otherwise(none)
    low = F.concat(F.lit("Low token overlap ("), _percent(ratio, 1), F.lit(" < "), _percent(F.lit(float(least)), 0), F.lit(")"))
    moderate = F.concat(F.lit("Moderate token overlap ("), _percent(ratio, 1), F.lit(")"))
    return F.when(judged & (ratio < least), fault("warning", low, ratio)).when(judged & (ratio < 0.5), fault("info", moderate, ratio)).otherwise(none)


def _of_addresses(strict: bool) -> Column:
    """Faults of a claim's addresses: those that no text near the seed is and no statement has. An IP address is also met by its
    first two numbers, a domain by its last two parts, within a text or a statement."""
    said = F.coalesce("statements", F.lit(""))
    within = lambda part: F.exists("_strings", lambda s: F.contains(s, part)) | F.contains(said, part)
    out = []
    for place, (label, pattern) in enumerate(ADDRESSES, 1):
        found = F.regexp_extract_all(F.coalesce("fact", F.lit("")), F.lit(pattern), F.lit(0))
        part = {"ip": lambda m: F.substring_index(m, ".", 2), "domain": lambda m: F.substring_index(m, ".", -2)}.get(label)
        met = lambda m, part=None: F.array_contains("_strings", m) | F.contains(said, m)
        missed = F.filter(found, lambda m: ~(met(m) | within(part(m)))) if part else F.filter(found, lambda m: ~met(m))  # noqa: B023
        text = F.lit("' not present in slice or strings" if strict else "' not directly present in slice or strings")
        out.append(F.transform(missed, lambda m: F.struct(F.lit(place).alias("place"), F.lit("error" if strict else "warning").alias("severity"), F.concat(F.lit(f"{label} '"), m, text).alias("reason"), F.lit(None).cast("double").alias("overlap_ratio"))))  # noqa: B023
    return F.concat(*out)


def grounding_faults(facts: DataFrame, units: DataFrame, strings: DataFrame, least: float = 0.2, strict: bool = False) -> DataFrame:
    """Faults of facts: key, idx, place, severity (error, warning, info), reason, overlap_ratio.

    A fact whose statements have few of its words, directly, as another name of a constant or a method, or as a part, is told of;
    so is every address that nothing near has. Unit ids that the slice does not have are errors in either mode; in strict mode
    so are addresses, and words only if none occurs. A fact without words or without statements is not judged by its words.
    Of a seed the first STRINGS texts count, which bounds what goes with its facts.
    """
    key = _key(facts)
    near = strings.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("ord", "text"))).where(F.col("_n") <= STRINGS).groupBy(*key).agg(F.collect_set("text").alias("_strings"))
    rows = _overlap(supported(facts, units).join(near, key, "left").withColumn("_strings", F.coalesce("_strings", F.expr("cast(array() as array<string>)"))))
    missing = F.transform("missing", lambda u: F.struct(F.lit(-1).alias("place"), F.lit("error").alias("severity"), F.concat(F.lit("missing unit "), u).alias("reason"), F.lit(None).cast("double").alias("overlap_ratio")))
    faults = F.concat(missing.cast(f"array<{_FAULT}>"), _of_words(strict, least), _of_addresses(strict).cast(f"array<{_FAULT}>"))
    return rows.select(*key, "idx", F.explode(faults).alias("f")).select(*key, "idx", "f.*")


def grounding(facts: DataFrame, faults: DataFrame) -> DataFrame:
    """Verdict on each seed with facts: key, ok, missing_unit_ids, n_mismatched, n_warnings, repair_hint. Warnings and information do
    not fail a seed."""
    key = _key(facts)
    count = lambda c: F.count(F.when(c, 1))
    error, unit = F.col("severity") == "error", F.col("place") == -1
    per = faults.groupBy(*key).agg(F.array_sort(F.collect_set(F.when(unit, F.substring_index("reason", "missing unit ", -1)))).alias("missing_unit_ids"), count(error & ~unit).alias("n_mismatched"), count(~error).alias("n_warnings"))
    rows = facts.select(*key).distinct().join(per, key, "left")
    none = F.expr("cast(array() as array<string>)")
    rows = rows.select(*key, F.coalesce("missing_unit_ids", none).alias("missing_unit_ids"), F.coalesce("n_mismatched", F.lit(0)).alias("n_mismatched"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"))
    ok = (F.size("missing_unit_ids") == 0) & (F.col("n_mismatched") == 0)
    return rows.withColumn("ok", ok).withColumn("repair_hint", F.when(ok, "").otherwise(REPAIR))
