"""Set-predicate rules: which patterns a set of categories satisfies, and what they add to its score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ord int, pattern_id string, description string, boost double, all_of array<string>, any_of array<string>, any_of_2 array<string>, min_count int, from_set array<string>, priority_override string"
RANKS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def pattern(ord_: int, pattern_id: str, boost: float, all_of=(), any_of=(), any_of_2=(), min_count=0, from_set=(), override=None, description="") -> tuple:
    return (ord_, pattern_id, description, boost, sorted(all_of), sorted(any_of), sorted(any_of_2), min_count, sorted(from_set), override)


def patterns_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


#: Pattern, boost, all of, any of, any of (second), least number, out of, priority, as the scoring defines them.
CATALOG = [
    pattern(0, "P_DROP_INSTALL_VIA_DM", 0.20, ["SYSTEM_MANIPULATION_PACKAGE", "DELIVERY_PAYLOAD_DOWNLOAD_DOWNLOADMANAGER"], override="HIGH"),
    pattern(1, "P_DROP_INSTALL_VIA_NET", 0.15, ["SYSTEM_MANIPULATION_PACKAGE", "C2_NETWORKING"], override="HIGH"),
    pattern(2, "P_DROP_INSTALL_SETTINGS_LURE", 0.20, ["SYSTEM_MANIPULATION_PACKAGE", "SOCIAL_ENGINEERING_PERMISSION_LURE_SETTINGS"], override="HIGH"),
    pattern(3, "P_DROP_TO_ACCESSIBILITY", 0.25, ["SYSTEM_MANIPULATION_PACKAGE", "ABUSE_ACCESSIBILITY"], override="CRITICAL"),
    pattern(4, "P_DYNLOAD_EVASION", 0.15, ["DYNAMIC_CODE_LOADING"], ["EVASION_CRYPTO_OBFUSCATION", "EVASION_REFLECTION", "ANTI_ANALYSIS_ANTI_DEBUG"]),
    pattern(5, "P_NATIVELOAD_EVASION", 0.12, ["NATIVE_CODE_LOADING"], ["EVASION_CRYPTO_OBFUSCATION", "ANTI_ANALYSIS_ANTI_DEBUG"]),
    pattern(6, "P_ODF_REMOTE_STREAM", 0.25, ["ABUSE_ACCESSIBILITY", "SURVEILLANCE_SCREEN_CAPTURE"], ["C2_NETWORKING", "C2_PUSH_FCM"], override="CRITICAL"),
    pattern(7, "P_ODF_INPUT_AUTOMATION", 0.20, ["ABUSE_ACCESSIBILITY", "INPUT_INJECTION"], ["C2_NETWORKING", "C2_PUSH_FCM"], override="CRITICAL"),
    pattern(8, "P_ODF_OVERLAY_OR_WEBINJECT", 0.20, ["ABUSE_ACCESSIBILITY"], ["INPUT_PROMPT_OVERLAY", "WEBVIEW_PHISHING"], override="CRITICAL"),
    pattern(9, "P_OTP_SMS_INTERCEPT_EXFIL", 0.15, ["INTERCEPT_SMS_MESSAGES"], ["C2_NETWORKING", "EXFIL_ALTERNATIVE_PROTOCOL"]),
    pattern(10, "P_OTP_NOTIFICATION_CAPTURE_AND_HIDE", 0.20, ["COLLECTION_NOTIFICATIONS", "DEFENSE_EVASION_NOTIFICATION_SUPPRESSION"]),
    pattern(11, "P_OTP_SMS_AND_NOTIFICATION_HIDE", 0.25, ["INTERCEPT_SMS_MESSAGES", "DEFENSE_EVASION_NOTIFICATION_SUPPRESSION"], override="CRITICAL"),
    pattern(12, "P_SMISHING_SPREAD", 0.20, ["SMS_CONTROL_SEND", "C2_NETWORKING"], ["COLLECTION_CONTACTS", "COLLECTION_SMS_MESSAGES"], override="HIGH"),
    pattern(13, "P_STALKERWARE_PERSIST_LOCATION", 0.20, ["SURVEILLANCE_LOCATION", "PERSISTENCE_BATTERY_OPTIMIZATION_ALLOWLIST"], ["PERSISTENCE_BROADCAST_RECEIVERS", "PERSISTENCE_SCHEDULED_TASKS", "PERSISTENCE_FOREGROUND_SERVICE"]),
    pattern(14, "P_STALKERWARE_COLLECTION_BUNDLE", 0.25, min_count=3, from_set=["SURVEILLANCE_LOCATION", "SURVEILLANCE_AUDIO", "SURVEILLANCE_CAMERA", "COLLECTION_SMS_MESSAGES", "COLLECTION_CONTACTS", "COLLECTION_CALL_LOG", "COLLECTION_FILES_MEDIA"], override="HIGH"),
    pattern(15, "P_STALKERWARE_SMS_COMMAND_CONTROL", 0.15, ["C2_NETWORKING"], ["COLLECTION_SMS_MESSAGES", "INTERCEPT_SMS_MESSAGES"], ["PERSISTENCE_BROADCAST_RECEIVERS", "PERSISTENCE_SCHEDULED_TASKS"]),
    pattern(16, "P_PUSH_WAKEUP_THEN_FETCH", 0.10, ["C2_PUSH_FCM"], ["C2_NETWORKING", "DYNAMIC_CODE_LOADING"]),
    pattern(17, "P_TOLL_FRAUD_CHAIN", 0.20, ["DYNAMIC_CODE_LOADING", "DEFENSE_EVASION_NOTIFICATION_SUPPRESSION"], ["TOLL_FRAUD_OPERATOR_GATING", "TOLL_FRAUD_FORCE_CELLULAR"], override="CRITICAL"),
]


def matches(p: Column, categories: Column) -> Column:
    """Whether a pattern (struct of SCHEMA) holds: all of, any of, any of the second, at least min_count of from_set. A clause
    without members holds."""
    some = lambda c: (F.size(c) == 0) | F.arrays_overlap(c, categories)
    enough = (p["min_count"] == 0) | (F.size(p["from_set"]) == 0) | (F.size(F.array_intersect(p["from_set"], categories)) >= p["min_count"])
    return F.forall(p["all_of"], lambda x: F.array_contains(categories, x)) & some(p["any_of"]) & some(p["any_of_2"]) & enough


def _packed(patterns: DataFrame) -> DataFrame:
    """All patterns as one row; a rule table is written by hand, so it is small whatever the data's size."""
    return patterns.agg(F.array_sort(F.collect_list(F.struct(*(f.name for f in patterns.schema.fields)))).alias("_patterns"))


def with_patterns(rows: DataFrame, categories: str, patterns: DataFrame) -> DataFrame:
    """rows plus `patterns`, the structs of the patterns that hold, in order of definition."""
    joined = rows.join(F.broadcast(_packed(patterns)), F.lit(True))
    return joined.withColumn("patterns", F.filter("_patterns", lambda p: matches(p, F.col(categories)))).drop("_patterns")


def evidence(p: Column, categories: Column) -> Column:
    """Which categories satisfied each clause: all of all_of, the first of any_of and any_of_2, min_count of from_set."""
    first = lambda c: F.slice(F.array_sort(F.array_intersect(c, categories)), 1, 1)
    counted = F.when(p["min_count"] > 0, F.slice(F.array_sort(F.array_intersect(p["from_set"], categories)), F.lit(1), p["min_count"])).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array_sort(p["all_of"]), first(p["any_of"]), first(p["any_of_2"]), counted))


def score(rows: DataFrame, categories: str, base: str, priority: str, patterns: DataFrame, block: bool = False) -> DataFrame:
    """rows plus patterns, boost, raw_score, threat_score (at most 1) and effective_priority (promotion only).

    At block level a pattern adds 0.4 of its boost, rounded to 3 places.
    """
    found = with_patterns(rows, categories, patterns)
    worth = (lambda p: F.round(p["boost"] * 0.4, 3)) if block else (lambda p: p["boost"])
    found = found.withColumn("boost", F.aggregate("patterns", F.lit(0.0), lambda acc, p: acc + worth(p)))
    rank = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, RANKS)), c), F.lit(0)), F.lit(99))
    best = F.array_min(F.concat(F.array(rank(F.col(priority))), F.transform(F.filter("patterns", lambda p: p["priority_override"].isNotNull()), lambda p: rank(p["priority_override"]))))
    promoted = F.coalesce(F.get(F.array(*map(F.lit, RANKS)), best.cast("int") - 1), F.col(priority))
    none = F.size(categories) == 0
    found = found.withColumn("raw_score", F.when(none, 0.0).otherwise(F.coalesce(F.col(base), F.lit(0.0)) + F.col("boost")))
    return found.withColumn("threat_score", F.least("raw_score", F.lit(1.0))).withColumn("effective_priority", promoted)


def pattern_counts(rows: DataFrame, level: str) -> DataFrame:
    """level, pattern_id, n: how many rows of a level satisfy each pattern."""
    return rows.select(F.explode("patterns.pattern_id").alias("pattern_id")).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(level))
