"""Evidence: what claims rest on, techniques, reflection verdicts, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def missing_support(facts: DataFrame, units: DataFrame) -> DataFrame:
    """fact key, missing: ids that a fact names and its seed's slice does not have."""
    wanted = facts.select("seed_id", "idx", F.explode("support_unit_ids").alias("unit_id"))
    return wanted.join(units, ["seed_id", "unit_id"], "left_anti").groupBy("seed_id", "idx").agg(F.array_sort(F.collect_set("unit_id")).alias("missing"))


def verified(facts: DataFrame, units: DataFrame) -> DataFrame:
    gone = missing_support(facts, units).select("seed_id").distinct().withColumn("gone", F.lit(True))
    return facts.select("seed_id").distinct().join(gone, "seed_id", "left").select("seed_id", F.when(F.col("gone"), "FAILED").otherwise("VERIFIED").alias("status"))


def token_overlap(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """key, claim_id, n_tokens, n_found, ratio: share of a claim's tokens that its source's text has.

    claims: key, claim_id, claim; sources: key, text. The tokens of each text stay in its row, so no pair of tokens is made.
    """
    own = sources.select("key", X.tokens(F.col("text")).alias("vocabulary"))
    rows = claims.select("key", "claim_id", X.tokens(F.col("claim")).alias("tokens")).join(own, "key")
    found = F.size(F.array_intersect("tokens", "vocabulary"))
    n = F.size("tokens")
    return rows.select("key", "claim_id", n.cast("bigint").alias("n_tokens"), found.cast("bigint").alias("n_found"), F.when(n > 0, found / n).otherwise(0.0).alias("ratio"))


def techniques(evidence: DataFrame, category_rules: DataFrame, keyword_rules: DataFrame) -> DataFrame:
    """evidence_id, technique_id: by the evidence's category, and by keywords that its claim contains."""
    by_category = evidence.join(category_rules, evidence["category"] == category_rules["key"]).select("evidence_id", "technique_id")
    words = keyword_rules.agg(F.collect_list(F.struct(F.lower("key").alias("key"), "technique_id")).alias("rules"))
    rows = evidence.join(F.broadcast(words), F.lit(True))
    met = F.filter("rules", lambda r: F.contains(F.lower(F.col("claim")), r["key"]))
    return by_category.union(rows.select("evidence_id", F.explode(F.transform(met, lambda r: r["technique_id"])).alias("technique_id"))).distinct()


def indicators_in(rows: DataFrame, text: str, indicators: DataFrame, boundary: bool = True) -> DataFrame:
    """rows exploded by the indicators (a short list) that their text has."""
    packed = indicators.agg(F.collect_list("indicator").alias("_indicators"))
    met = (lambda i: X.has_indicator(F.col(text), i)) if boundary else (lambda i: F.contains(F.lower(F.col(text)), F.lower(i)))
    return rows.join(F.broadcast(packed), F.lit(True)).withColumn("indicator", F.explode(F.filter("_indicators", met))).drop("_indicators")


#: Categories whose indicators are telling enough to be searched in texts; the first without boundaries.
STRING_CATEGORIES = ("SOCIAL_ENGINEERING_PERMISSION_LURE_SETTINGS", "C2_MESSAGING_PLATFORM_ENDPOINTS")


def method_strings(units: DataFrame) -> DataFrame:
    """analysis_id, method, text: different texts in the statements (stmt) of a method."""
    return units.select("analysis_id", "method", F.explode(X.statement_strings(F.col("stmt"))).alias("text")).distinct()


def string_categories(strings: DataFrame, indicators: DataFrame, categories: tuple[str, ...] = STRING_CATEGORIES) -> DataFrame:
    """analysis_id, method, category_id, indicators (sorted) whose text occurs in a method's, in any case.

    indicators: category_id, indicator, written by hand and kept in one row. Only `categories` count; the first takes any
    occurrence, the others one within boundaries. A text of under 5 characters must be the indicator itself.
    """
    packed = indicators.where(F.col("category_id").isin(*categories)).agg(F.collect_list(F.struct("category_id", "indicator")).alias("_rules"))
    low = F.lower(F.col("text"))
    holds = lambda r: (F.contains(low, F.lower(r["indicator"])) & ((F.length(low) >= 5) | (low == F.lower(r["indicator"]))) & ((r["category_id"] == categories[0]) | X.has_indicator(F.col("text"), r["indicator"])))
    met = strings.where(F.length("text") > 0).join(F.broadcast(packed), F.lit(True)).select("analysis_id", "method", F.explode(F.filter("_rules", holds)).alias("r"))
    return met.groupBy("analysis_id", "method", F.col("r.category_id").alias("category_id")).agg(F.array_sort(F.collect_set("r.indicator")).alias("indicators"))


def reflection_verdicts(hits: DataFrame, reflection: str, crypto: str, target: str = "target_is_sensitive") -> DataFrame:
    """hit_id, verdict of reflection hits: a sensitive target, else a chain of calls in one caller, else crypto beside it.

    One caller's flags are aggregated by themselves and joined back, so a busy caller costs no window.
    """
    per = hits.groupBy("analysis_id", "caller").agg(F.count_if(F.col("category_id") == reflection).alias("n_reflection"), F.bool_or(F.col("category_id") == crypto).alias("has_crypto"))
    rows = hits.where(F.col("category_id") == reflection).join(per, ["analysis_id", "caller"])
    verdict = F.when(F.coalesce(F.col(target), F.lit(False)), "sensitive_target").when(F.col("n_reflection") > 1, "obfuscated_chain").when(F.col("has_crypto"), "crypto_chain")
    return rows.select("analysis_id", "hit_id", verdict.alias("verdict"))


def confidence(coverage: Column, claims: Column, resolution: Column) -> Column:
    """0.3 coverage, 0.4 mean of the claims, 0.3 resolution, to 2 places."""
    return F.round(F.lit(0.3) * coverage + F.lit(0.4) * claims + F.lit(0.3) * resolution, 2)


def phase_status(unclaimed: Column, unresolved: Column) -> Column:
    return F.when((unclaimed > 0.5) | (unresolved > 0.5), "failed").when((unclaimed > 0) | (unresolved > 0.2), "partial").otherwise("ok")


def required_extras(rows: DataFrame) -> DataFrame:
    """component, extra: one type or `mixed`, required if it is anywhere, hints sorted."""
    out = rows.groupBy("component", "extra").agg(F.array_sort(F.collect_set("type")).alias("types"), F.bool_or("required").alias("required"), F.array_sort(F.collect_set("hint")).alias("hints"))
    return out.withColumn("type", F.when(F.size("types") == 1, F.get("types", F.lit(0))).otherwise("mixed"))


def search(files: DataFrame, query: str, limit: int) -> DataFrame:
    """path and first line of the first files, by path, that contain a text."""
    found = files.where(F.contains("text", F.lit(query)))
    return found.select("path", X.first_line_with(F.col("text"), F.lit(query)).alias("line")).orderBy("path").limit(limit)
