"""Components and entrypoints: what an application declares and where the platform enters it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signatures as S

#: Lifecycle methods by component type.
ENTRY_METHODS = {
    "activity": ("onCreate", "onStart", "onResume", "onPause", "onStop", "onDestroy", "onNewIntent", "onActivityResult"),
    "service": ("onCreate", "onStartCommand", "onBind", "onHandleIntent", "onDestroy"),
    "receiver": ("onReceive",),
    "provider": ("onCreate", "query", "insert", "update", "delete", "call"),
}
ACCESSIBILITY_SUPERTYPE = "android.accessibilityservice.AccessibilityService"
ACCESSIBILITY_METHODS = ("onAccessibilityEvent", "onInterrupt", "onServiceConnected")
#: Methods that the platform calls, by the class they are inherited from.
_FRAGMENT = ("onAttach", "onCreate", "onCreateView", "onViewCreated", "onActivityCreated", "onStart", "onResume", "onPause", "onStop", "onDestroyView", "onDestroy", "onDetach")
BASE_METHODS = {
    "android.app.Activity": ENTRY_METHODS["activity"], "android.app.Service": ENTRY_METHODS["service"], "android.app.IntentService": ("onHandleIntent",),
    "android.content.BroadcastReceiver": ENTRY_METHODS["receiver"], "android.content.ContentProvider": ENTRY_METHODS["provider"], "android.app.Application": ("onCreate",),
    ACCESSIBILITY_SUPERTYPE: ACCESSIBILITY_METHODS, "android.app.Fragment": _FRAGMENT, "androidx.fragment.app.Fragment": _FRAGMENT,
}
#: Prefixes of common libraries.
LIBRARY_PREFIXES = (
    "androidx.", "android.support.", "com.google.android.material.", "com.google.android.gms.", "com.google.android.play.", "com.android.billingclient.", "com.google.android.datatransport.", "com.google.firebase.", "com.google.mlkit.",
    "kotlin.", "kotlinx.", "org.jetbrains.kotlin.", "org.jetbrains.annotations.", "okhttp3.", "okio.", "retrofit2.", "com.squareup.okhttp.", "com.squareup.okhttp3.", "com.squareup.retrofit.", "com.squareup.retrofit2.", "com.squareup.picasso.", "com.squareup.moshi.",
    "com.fasterxml.jackson.", "com.google.gson.", "org.json.", "org.slf4j.", "org.apache.logging.", "ch.qos.logback.", "timber.log.", "org.apache.commons.", "org.apache.http.", "io.reactivex.", "rx.", "io.reactivex.rxjava3.",
    "dagger.", "javax.inject.", "com.google.dagger.", "butterknife.", "com.jakewharton.", "com.bumptech.glide.", "com.github.bumptech.glide.", "org.junit.", "org.mockito.", "org.robolectric.",
)


def is_library(name: Column) -> Column:
    return F.rlike(name, F.lit("^(" + "|".join(p.replace(".", r"\.") for p in LIBRARY_PREFIXES) + ")"))


def components(manifest: DataFrame) -> DataFrame:
    """analysis_id, component_type, name of a manifest's lists, names completed by the package. manifest: analysis_id,
    package_name, activities, services, receivers, providers (arrays of names)."""
    lists = F.array(*(F.struct(F.lit(kind).alias("component_type"), F.coalesce(F.col(column), F.array().cast("array<string>")).alias("names")) for kind, column in (("activity", "activities"), ("service", "services"), ("receiver", "receivers"), ("provider", "providers"))))
    rows = manifest.select("analysis_id", "package_name", F.explode(lists).alias("x")).select("analysis_id", "package_name", "x.component_type", F.explode("x.names").alias("name"))
    return rows.select("analysis_id", "component_type", S.component_name(F.col("name"), F.col("package_name")).alias("name"))


def entrypoints(methods: DataFrame, declared: DataFrame, subtypes: DataFrame | None = None) -> DataFrame:
    """Methods (analysis_id, method) that the platform calls on declared components; accessibility services have more."""
    m = methods.select("analysis_id", "method", S.class_of(F.col("method")).alias("name"), S.method_of(F.col("method")).alias("short")).distinct()
    allowed = F.lit(False)
    for kind, names in ENTRY_METHODS.items():
        allowed = allowed | ((F.col("component_type") == kind) & F.col("short").isin(*names))
    at = m.join(declared, ["analysis_id", "name"])
    out = at.where(allowed)
    if subtypes is not None:
        served = subtypes.where(F.col("supertype") == ACCESSIBILITY_SUPERTYPE).select(F.col("class").alias("name")).distinct()
        out = out.unionByName(at.where((F.col("component_type") == "service") & F.col("short").isin(*ACCESSIBILITY_METHODS)).join(served, "name", "left_semi"))
    return out.select("analysis_id", "method").distinct()


def inherited_entrypoints(methods: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Concrete methods (analysis_id, method) of classes that extend, or are, a platform base class, by name. subtypes: class,
    supertype (transitive), and analysis_id, where each analysis has its own.

    Methods are few of a name, so their repeats are taken out behind the shuffle only: a map of all rows of a scan, which would
    combine next to nothing, grows with the scan."""
    own = [c for c in ("analysis_id",) if c in subtypes.columns]
    allowed = F.create_map(*(x for base, names in BASE_METHODS.items() for x in (F.lit(base), F.array(*map(F.lit, names)))))
    bases = subtypes.where(F.col("supertype").isin(*BASE_METHODS)).select(*own, "class", F.explode(allowed[F.col("supertype")]).alias("short"))
    rows = methods.select("analysis_id", "method", S.class_of(F.col("method")).alias("class"), S.method_of(F.col("method")).alias("short"))
    rows = rows.where(F.col("short").isin(*sorted({n for names in BASE_METHODS.values() for n in names})))
    below = rows.join(bases, [*own, "class", "short"], "left_semi")
    itself = rows.where(F.array_contains(allowed[F.col("class")], F.col("short")))
    return below.unionByName(itself).select("analysis_id", "method").repartition("analysis_id", "method").distinct()


def app_prefixes(names: DataFrame) -> DataFrame:
    """analysis_id, prefix (first two parts of the package): the most frequent outside libraries, all at a tie."""
    rows = names.where(~is_library(F.col("class")) & ~S.is_framework_name(F.col("class"))).select("analysis_id", F.substring_index(S.package_of(F.col("class")), ".", 2).alias("prefix")).where("prefix <> ''")
    counts = rows.groupBy("analysis_id", "prefix").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("analysis_id").agg(F.max("n").alias("n"))
    return counts.join(top, ["analysis_id", "n"]).select("analysis_id", "prefix")


def of_app(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows (analysis_id, class) whose class is a prefix or lies below one. The prefixes of one analysis are few and stay
    together in one array."""
    packed = prefixes.groupBy("analysis_id").agg(F.collect_set("prefix").alias("_prefixes"))
    inside = F.exists("_prefixes", lambda p: (F.col("class") == p) | F.startswith(F.col("class"), F.concat(p, F.lit("."))))
    return rows.join(packed, "analysis_id").where(inside).drop("_prefixes")


def permissions_for(signatures: DataFrame, permission_map: DataFrame) -> DataFrame:
    """signature, permissions: those whose API text occurs in the signature. permission_map (api, permission) is a short list."""
    packed = permission_map.agg(F.collect_list(F.struct("api", "permission")).alias("_map"))
    met = F.filter("_map", lambda m: F.contains(F.col("signature"), m["api"]))
    return signatures.join(F.broadcast(packed), F.lit(True)).select("signature", F.array_sort(F.array_distinct(F.transform(met, lambda m: m["permission"]))).alias("permissions"))


def listener_edges(registrations: DataFrame, implementors: DataFrame, most: int = 20) -> DataFrame:
    """Synthetic edges of a listener registration to the methods of its implementors: in the same outer class with high
    confidence, else in the same package with medium, else all with low; the first `most` by name.

    registrations: analysis_id, caller, callsite, listener; implementors: listener, class, method, and analysis_id, where each
    analysis has its own.
    """
    rows = registrations.join(implementors, [c for c in ("analysis_id", "listener") if c in implementors.columns]).withColumn("owner", S.class_of(F.col("caller")))
    tier = F.when(S.outer_class(F.col("owner")) == S.outer_class(F.col("class")), 1).when(S.package_of(F.col("owner")) == S.package_of(F.col("class")), 2).otherwise(3)
    per = rows.withColumn("tier", tier).groupBy("analysis_id", "caller", "callsite", "listener").agg(F.min("tier").alias("best"), F.array_sort(F.collect_set(F.struct("tier", "method"))).alias("x"))
    chosen = F.slice(F.filter("x", lambda x: x["tier"] == F.col("best")), 1, most)
    out = per.select("analysis_id", "caller", "callsite", "best", F.explode(chosen).alias("x"))
    return out.select("analysis_id", "caller", "callsite", F.col("x.method").alias("callee"), F.when(F.col("best") == 1, "high").when(F.col("best") == 2, "medium").otherwise("low").alias("confidence"), F.lit("listener_synthetic").alias("edge_source"))


def callback_edges(callbacks: DataFrame, entries: DataFrame) -> DataFrame:
    """Edges to callbacks from where they are registered, else from every entrypoint of their component."""
    own = entries.select("analysis_id", S.class_of(F.col("method")).alias("component"), F.col("method").alias("entry"))
    rows = callbacks.join(own, ["analysis_id", "component"], "left")
    return rows.select("analysis_id", F.coalesce("registration_site", "entry").alias("caller"), F.col("method").alias("callee"), F.lit("callback_synthetic").alias("edge_source")).where("caller is not null").distinct()


def hints_for(classes: DataFrame, hints: DataFrame) -> DataFrame:
    """Hints (class, hint) of each class, those of its outer class where it has none."""
    own = [c for c in ("analysis_id",) if c in hints.columns]
    exact = hints.groupBy(*own, "class").agg(F.array_sort(F.collect_set("hint")).alias("own"))
    outer = exact.select(*own, F.col("class").alias("outer"), F.col("own").alias("outer_own"))
    rows = classes.withColumn("outer", S.outer_class(F.col("class"))).join(exact, [*own, "class"], "left").join(outer, [*own, "outer"], "left")
    return rows.select(*own, "class", F.coalesce("own", "outer_own", F.array().cast("array<string>")).alias("hints"))
