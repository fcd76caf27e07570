"""Column functions over what a component takes and leaves: extras, paths, component names, constants by platform version."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, DataFrame
from pyspark.sql import functions as F

#: Flag of an extra's type; types that no flag can carry.
EXTRA_FLAGS = {"string": "--es", "string_array": "--esa", "int": "--ei", "int_array": "--eia", "long": "--el", "boolean": "--ez", "float": "--ef", "double": "--ed"}
NOT_INJECTABLE = ("parcelable", "serializable", "unknown", "mixed")
#: Folders of an application, by the name they have in code.
FOLDERS = {"cacheDir/": "/data/data/{}/cache/", "filesDir/": "/data/data/{}/files/", "externalCacheDir/": "/sdcard/Android/data/{}/cache/", "externalFilesDir/": "/sdcard/Android/data/{}/files/"}
#: Class, then value, name, first platform version and, if any, the version that gave it up.
VERSIONED = {
    "android.media.MediaRecorder$AudioSource": (
        (0, "DEFAULT", 1), (1, "MIC", 1), (2, "VOICE_UPLINK", 4), (3, "VOICE_DOWNLINK", 4), (4, "VOICE_CALL", 4), (5, "CAMCORDER", 7), (6, "VOICE_RECOGNITION", 7), (7, "VOICE_COMMUNICATION", 11), (9, "UNPROCESSED", 24), (10, "VOICE_PERFORMANCE", 29)),
    "android.hardware.camera2.CameraCharacteristics": ((0, "LENS_FACING_FRONT", 21), (1, "LENS_FACING_BACK", 21), (2, "LENS_FACING_EXTERNAL", 23)),
    "android.location.LocationRequest": ((100, "PRIORITY_HIGH_ACCURACY", 9), (102, "PRIORITY_BALANCED_POWER_ACCURACY", 9), (104, "PRIORITY_LOW_POWER", 9), (105, "PRIORITY_NO_POWER", 9)),
    "android.net.ConnectivityManager": ((0, "TYPE_MOBILE", 1, 28), (1, "TYPE_WIFI", 1, 28), (6, "TYPE_WIMAX", 8, 28), (7, "TYPE_BLUETOOTH", 13, 28), (9, "TYPE_ETHERNET", 13, 28)),
    "android.telephony.TelephonyManager": ((0, "PHONE_TYPE_NONE", 1), (1, "PHONE_TYPE_GSM", 1), (2, "PHONE_TYPE_CDMA", 4), (3, "PHONE_TYPE_SIP", 11)),
}
VERSIONED_ROWS = [(enum, *row, *([None] * (4 - len(row)))) for enum, rows in VERSIONED.items() for row in rows]


def versioned_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VERSIONED_ROWS, "enum_class string, value int, semantic string, added int, deprecated int")


def versioned_constant(enum: Column, value: Column, target: Column) -> Column:
    """struct<semantic, confidence> of a constant for a target version: 0.95 if the version has it, 0.5 if it gave it up, 0.7
    if it came later; null for an unknown constant. The table is a literal of the plan."""
    rows = F.array(*(F.struct(F.lit(e).alias("e"), F.lit(v).alias("v"), F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(d).cast("int").alias("d")) for e, v, n, a, d in VERSIONED_ROWS))
    met = F.get(F.filter(rows, lambda r: (r["e"] == enum) & (r["v"] == value)), F.lit(0))
    sure = F.when(met["a"] > target, 0.7).when(met["d"] <= target, 0.5).otherwise(0.95)
    return F.when(met["n"].isNotNull(), F.struct(met["n"].alias("semantic"), sure.alias("confidence")))


def extra_flag(kind: Column) -> Column:
    """Flag of an extra's type, null if none carries it."""
    return F.create_map(*(F.lit(x) for pair in EXTRA_FLAGS.items() for x in pair))[kind]


def is_injectable(kind: Column) -> Column:
    return ~F.coalesce(kind, F.lit("unknown")).isin(*NOT_INJECTABLE)


def resolve_path(hint: Column, package: Column) -> Column:
    """Absolute path of a hint: as it is, or below the package's folder; null where neither is known."""
    out = F.when(hint.startswith("/"), hint)
    for name, folder in FOLDERS.items():
        before, after = folder.split("{}")
        out = out.when(hint.startswith(name) & (F.length(package) > 0), F.concat(F.lit(before), package, F.lit(after), F.substr(hint, F.lit(len(name) + 1))))
    return out


def is_stable_path(hint: Column) -> Column:
    """Whether a file's name is fixed: it has a dot, no wildcard and no open end."""
    name = F.regexp_extract(hint, r"([^/]*)$", 1)
    return F.coalesce((F.length(hint) > 0) & ~name.rlike(r"[*?]") & ~name.endswith("_") & F.contains(name, F.lit(".")), F.lit(False))


def component_of(value: Column, package: Column) -> Column:
    """Class of pkg/.Name, pkg/a.Name, .Name or a.Name; null for a blank."""
    pkg, cls = F.regexp_extract(value, r"^([^/]*)/", 1), F.regexp_extract(value, r"^[^/]*/(.*)$", 1)
    slashed = F.when(cls.startswith(".") & (F.length(pkg) > 0), F.concat(pkg, cls)).when(F.length(cls) > 0, cls).otherwise(pkg)
    plain = F.when(value.startswith(".") & (F.length(package) > 0), F.concat(package, value)).otherwise(value)
    return F.when(F.length(value) > 0, F.when(F.contains(value, F.lit("/")), slashed).otherwise(plain))


def seed_warnings(component: Column, component_type: Column, confidence: Column, bad_extras: Column, n_facts: Column, n_open: Column) -> Column:
    """Names of what is doubtful in a seed's analysis, in order, never null; nothing is stopped by them. bad_extras: number of
    extras that no flag carries, each with its own warning."""
    sure = F.coalesce(confidence, F.lit(0.0))
    none = F.array().cast("array<string>")
    one = lambda c, name: F.when(c, F.array(F.lit(name))).otherwise(none)
    unnamed = F.coalesce(F.length(component), F.lit(0)) == 0
    extras = F.when(unnamed, none).otherwise(F.array_repeat(F.lit("non_injectable_extra"), F.coalesce(bad_extras, F.lit(0)).cast("int")))
    return F.concat(one(unnamed, "missing_component_name"), one(F.coalesce(component_type, F.lit("Unknown")) == "Unknown", "unknown_component_type"), one(sure < 0.5, "low_confidence"), extras,
                    one(n_facts == 0, "no_facts"), one(n_open > n_facts, "high_uncertainty"))


def automation(warnings: Column) -> Column:
    """full, partial or manual, by the warnings of seed_warnings."""
    has = lambda name: F.array_contains(warnings, name)
    extras, untyped, low = has("non_injectable_extra"), has("unknown_component_type"), has("low_confidence")
    return F.when(has("missing_component_name") | has("no_facts") | (low & (untyped | extras)), "manual").when(extras | untyped | low, "partial").otherwise("full")


def effect_text(effect: Column, statement: Column, value: Column) -> Column:
    """Text of an observed effect: the first of its three fields that is not empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (effect, statement, value)))
