"""What a method hands on, read from its statements alone: definitions, uses and what they stand for.

units: analysis_id, method, idx, stmt: the statements of method bodies in order, as the intermediate representation prints them.
hierarchy: analysis_id, class, supertype (transitive, without the class itself). A use of a local stands for the last definition
before it in the body's order; definitions through other locals and casts are followed for at most STEPS steps.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signatures as S
from ..plans.durable import checkpointed
from . import threads as T

# Executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Steps through locals and casts, each counting one.
STEPS = 6
BODY = ["analysis_id", "method"]
_LOCAL = r"[a-zA-Z$][\w$#]*"
_SIGNATURE = r"<[^:>]+: \S+ (?:<\w+>|[^\s(<>]+)\([^)]*\)>"
_FIELD = r"<[^:>]+: \S+ [^\s>(]+>"
#: Arguments: constants in quotes may hold commas.
_ARGUMENT = r'"(?:[^"\\]|\\.)*"|[^,\s][^,]*'
_DEFINED = rf"^({_LOCAL}) :?= (.+)$"
_INVOKED = rf"^(?:{_LOCAL} = )?(\w+)invoke (?:({_LOCAL})\.)?({_SIGNATURE})\((.*)\)$"
_STORED = rf"^{_LOCAL}\.({_FIELD}) = (.+)$"
_CAST = re.compile(r"\([^()]+\) (\S+)", re.ASCII)
#: Rows of a walk, in their order at one place: what is defined there counts for what is used there. A use, the start of a thread
#: and the sending of a message differ in where the work comes from.
DEFINITION, GIVEN, USE, START, SEND = range(5)

#: Methods whose stores tell what a field holds.
INITIALISERS = ("<init>", "onCreate", "onStartCommand", "onReceive")
MESSAGE = "android.os.Message"
#: Registering method, type of its first parameter, whether it has no other, method that is called back.
REGISTRATIONS = (
    ("setOnClickListener", "android.view.View$OnClickListener", True, "void onClick(android.view.View)"),
    ("addPrimaryClipChangedListener", "android.content.ClipboardManager$OnPrimaryClipChangedListener", True, "void onPrimaryClipChanged()"),
    ("setOnImageAvailableListener", "android.media.ImageReader$OnImageAvailableListener", False, "void onImageAvailable(android.media.ImageReader)"),
    ("registerReceiver", "android.content.BroadcastReceiver", False, "void onReceive(android.content.Context,android.content.Intent)"),
)
RUN = "void run()"


def _found(text: Column, pattern: str, group: int) -> Column:
    """A group, that cannot be empty, of an anchored pattern, else null. nullif would try the pattern twice, and four times in two."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def is_local(value: Column) -> Column:
    return value.rlike(f"^{_LOCAL}$") & (value != "null")


def new_class(value: Column) -> Column:
    """Class of `new c`, else null."""
    return F.when(value.startswith("new "), _found(value, r"^new ([\w.$]+)$", 1))


def field_of(value: Column) -> Column:
    """Field that a value reads, of an object or a class, else null."""
    return F.when(F.contains(value, F.lit("<")) & ~F.contains(value, F.lit("invoke ")), _found(value, rf"^(?:{_LOCAL}\.)?({_FIELD})$", 1))


def type_of(value: Column) -> Column:
    """Type that a value shows: of its new, cast, field, called method, parameter or this, else null."""
    invoked = F.when(F.contains(value, F.lit("invoke ")), _found(value, rf"^\w+invoke (?:{_LOCAL}\.)?({_SIGNATURE})", 1))
    cast, given = F.when(value.startswith("("), _found(value, r"^\(([^()]+)\) ", 1)), F.when(value.startswith("@"), _found(value, r"^@\w+: (\S+)$", 1))
    return F.coalesce(new_class(value), cast, _found(field_of(value), r"^<[^:]+: (\S+) ", 1), S.return_of(invoked), given)


def _arguments(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_ARGUMENT), F.lit(0)), lambda a: F.trim(a))


def definitions(units: DataFrame) -> DataFrame:
    """analysis_id, method, idx, local, value of every statement that defines a local."""
    return units.where(F.col("stmt").rlike(_DEFINED)).select(*BODY, "idx", F.regexp_extract("stmt", _DEFINED, 1).alias("local"), F.regexp_extract("stmt", _DEFINED, 2).alias("value"))


def invocations(units: DataFrame) -> DataFrame:
    """analysis_id, method, idx, stmt, kind, base, callee, args of every statement with a call, its result used or not."""
    part = lambda k: _found(F.col("stmt"), _INVOKED, k)
    return units.where(F.col("stmt").rlike(_INVOKED)).select(*BODY, "idx", "stmt", part(1).alias("kind"), F.nullif(part(2), F.lit("")).alias("base"), part(3).alias("callee"), _arguments(F.regexp_extract("stmt", _INVOKED, 4)).alias("args"))


def _walk(batches: Iterator[pa.RecordBatch], steps: int) -> Iterator[pa.RecordBatch]:
    """Goes through bodies in their order with the last definition of each local, and the last work given to each, in hand."""
    body, last, given = None, {}, {}

    def led(value: str | None, passes: str | None) -> tuple[str | None, str | None]:
        depth = 0
        while depth < steps:
            cast = _CAST.fullmatch(value) if value and value[0] == "(" else None
            if cast:
                value, passes, depth = cast[1], None, depth + 1
            if depth == steps or value == "null" or value not in last:
                break
            (value, passes, _), depth = last[value], depth + 1
        return value, passes

    for batch in batches:
        uses, found = [], []
        columns = ("analysis_id", "method", "side", "local", "value", "passes", "fits")
        idx = batch["idx"].to_pylist() if GIVEN in batch["side"].unique().to_pylist() else []
        for n, (a, m, side, local, value, passes, fits) in enumerate(zip(*(batch[c].to_numpy(zero_copy_only=False).tolist() for c in columns))):
            if body != (a, m):
                body, last, given = (a, m), {}, {}
            if side == DEFINITION:
                last[local] = value, passes, fits
            elif side == GIVEN:  # the first that can be run, by its parameter's type or its own
                if (fits or (value != "null" and value in last and last[value][2])) and (local not in given or given[local][0] != idx[n]):
                    given[local] = idx[n], value
            else:
                value, passes = led(value, passes)
                first = last[local][0] if local in last else None
                work = value if side == USE else passes
                if side == START:
                    work = given.get(local) or (given.get(first) if first != "null" else None)
                    work = work and work[1]
                uses.append(n)
                found.append((value, first, led(work, None)[0]))
        told = [pa.array(c, pa.string()) for c in zip(*found)] if found else [pa.array([], pa.string())] * 3
        kept = batch.select([*BODY, "idx", "use"]).take(pa.array(uses, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, *told], [*kept.schema.names, "value", "first", "work"])


def walked(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """analysis_id, method, idx, use, value (what the use stands for), first (the last definition of its local), work (what it hands on, followed too).

    rows: analysis_id, method, idx, side, local, value, passes (the work that a message passes on), fits (the type can be run),
    place, use (a struct of what else a use has, null for others). A value that is a local is followed to the last definition at or before the use,
    a cast to what it casts, each a step. Bodies are shuffled and sorted once; a task holds a value for each local of one body.
    """
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*BODY, "idx", "use")) + ", value string, first string, work string"
    # bodies by a number first: it is compared without reading their names
    ordered = rows.repartition(*BODY).withColumn("_body", F.xxhash64(*BODY)).sortWithinPartitions("_body", *BODY, "idx", "side", "place", "value")
    return ordered.mapInArrow(lambda batches: _walk(batches, steps), kind)


def resolved(uses: DataFrame, defs: DataFrame, column: str, steps: int = STEPS) -> DataFrame:
    """uses with the local in `column` followed to what it stands for: a value that is no local, a local without a definition, or what
    `steps` steps lead to. Every definition along the way is the last one before the use."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    use = F.struct(*(F.col(c).alias(f"_{c}") for c in uses.columns if c not in (*BODY, "idx", column))).alias("use")
    asked = uses.select(*BODY, "idx", F.lit(USE).alias("side"), *none("string", "local"), F.col(column).alias("value"), *none("string", "passes"), *none("boolean", "fits"), *none("int", "place"), use)
    given = defs.select(*BODY, "idx", F.lit(DEFINITION).alias("side"), "local", "value", *none("string", "passes"), *none("boolean", "fits"), *none("int", "place"), *none(asked.schema["use"].dataType, "use"))
    return walked(given.unionByName(asked), steps).select(*(c if c in (*BODY, "idx") else F.col("value").alias(c) if c == column else F.col(f"use._{c}").alias(c) for c in uses.columns))


def answers(methods: DataFrame, parents: DataFrame, classes: DataFrame) -> DataFrame:
    """analysis_id, class, name, target: the application's concrete method that answers a call of `name` on the class: its own or
    that of the nearest class above that has one. methods: analysis_id, class, name (`void run()`), concrete, of the
    application; parents: analysis_id, class, parent; classes: analysis_id, class, name."""
    from ..plans.graph import resolve_methods

    found = resolve_methods(classes.distinct(), methods, parents).where("owner is not null")
    real = methods.where("concrete").select("analysis_id", F.col("class").alias("owner"), "name").distinct()
    return found.join(real, ["analysis_id", "owner", "name"]).select("analysis_id", "class", "name", F.concat(F.lit("<"), "owner", F.lit(": "), "name", F.lit(">")).alias("target"))


def _told(rows: DataFrame, asked: Column, other: DataFrame, at: str, *found: str) -> DataFrame:
    """rows with the columns `found` (name AS name) of the row of other, of the same analysis, that is asked for. Rows that ask for
    nothing are spread: nulls would meet in one task where the other side is too large to be broadcast."""
    nothing = F.concat(F.lit("?"), F.pmod(F.hash("method", "idx"), F.lit(4096)))
    other = other.select("analysis_id", F.col(at).alias("_at"), *map(F.expr, found))
    return rows.withColumn("_at", F.coalesce(asked, nothing)).join(other, ["analysis_id", "_at"], "left").drop("_at")


def kin(hierarchy: DataFrame) -> DataFrame:
    """analysis_id, class, thread: classes below Runnable or Thread, and whether below Thread. The platform's own are not among them."""
    rows = hierarchy.where(F.col("supertype").isin(T.THREAD, T.RUNNABLE))
    return rows.groupBy("analysis_id", "class").agg(F.max(F.col("supertype") == T.THREAD).alias("thread"))


def _threads(rows: DataFrame, able: DataFrame, **asked: Column) -> DataFrame:
    """rows with a column for each class asked for: whether it is a thread."""
    for name, cls in asked.items():
        rows = _told(rows, cls, able, "class", "thread AS _thread").withColumn(name, F.coalesce((cls == T.THREAD) | F.coalesce("_thread", F.lit(False)), F.lit(False))).drop("_thread")
    return rows


def _passed(value: Column) -> Column:
    """The argument of a value that is Message.obtain with a runnable, else null."""
    made_by = _found(value, rf"^staticinvoke ({_SIGNATURE})\(", 1)
    place = F.when((S.method_of(made_by) == "obtain") & (S.class_of(made_by) == MESSAGE), F.array_position(S.params_of(made_by), T.RUNNABLE))
    inner = F.regexp_extract(value, rf"^staticinvoke {_SIGNATURE}\((.*)\)$", 1)
    return F.when(F.contains(value, F.lit(MESSAGE)), F.when(place > 0, F.get(_arguments(inner), (place - 1).cast("int"))))


def _read(units: DataFrame, able: DataFrame) -> DataFrame:
    """Rows to walk (see `walked`), from one scan: definitions, arguments of threads' constructors, and as uses started threads, what
    is posted, messages, stores of initialisers into fields of their class. able: of `kin`."""
    has = lambda text: F.contains("stmt", F.lit(text))
    # no call hands on work without one of these texts; patterns are tried on what is left, each once
    near = has("invoke ") & (has(" void start()") | has("android.os.Handler") | has("execute(") | has("submit(") | (has("specialinvoke ") & has("<init>(")))
    stmt, callee = F.col("stmt"), F.col("callee")
    rows = units.select(
        *BODY, "idx", "stmt", F.when(has("= "), _found(stmt, _DEFINED, 1)).alias("local"), F.when(near, _found(stmt, _INVOKED, 3)).alias("callee"),
        F.when(has("> = "), F.when(S.method_of(F.col("method")).isin(*INITIALISERS), _found(stmt, _STORED, 1))).alias("field"))
    called = lambda c: F.when(callee.isNotNull(), c)
    rows = rows.select(
        *BODY, "idx", "stmt", "local", "callee", F.when(F.regexp_extract("field", "^<([^:]+):", 1) == S.class_of(F.col("method")), F.col("field")).alias("field"),
        F.when(F.col("local").isNotNull(), F.regexp_extract("stmt", _DEFINED, 2)).alias("value"), called(_found(stmt, _INVOKED, 1)).alias("kind"), called(F.nullif(F.regexp_extract("stmt", _INVOKED, 2), F.lit(""))).alias("base"),
        called(_arguments(F.regexp_extract("stmt", _INVOKED, 4))).alias("args"), called(S.class_of(callee)).alias("class"), called(S.method_of(callee)).alias("name"), called(S.params_of(callee)).alias("types"))
    begun = (F.col("name") == "start") & F.contains("callee", F.lit(" void start()")) & F.col("base").isNotNull() & F.col("method").isNotNull() & F.col("idx").isNotNull()
    pattern = F.when(begun, "thread_start").otherwise(T.pattern_of(F.col("class"), F.col("name"), F.get("types", F.lit(0))))
    rows = rows.withColumn("pattern", F.when(F.col("field").isNotNull(), "store").otherwise(called(pattern)))
    side = F.when(F.col("pattern") == "thread_start", START).when(F.col("pattern") == "handler_message", SEND).otherwise(USE)
    value = F.when(F.col("pattern") == "thread_start", F.col("base")).when(F.col("pattern") == "store", F.regexp_extract("stmt", _STORED, 2)).otherwise(F.get("args", F.lit(0)))
    use = F.struct("stmt", "pattern", "class", "field")

    def row(side: Column, local: Column, value: Column, passes: Column | None = None, place: Column | None = None, asked: Column | None = None, owner: Column | None = None, use: Column | None = None) -> Column:
        texts = [(F.lit(None).cast("string") if c is None else c).alias(n) for n, c in (("passes", passes), ("asked", asked), ("owner", owner))]
        return F.struct(side.cast("int").alias("side"), local.alias("local"), value.alias("value"), *texts, (F.lit(None).cast("int") if place is None else place).alias("place"), (F.lit(None).cast(kind) if use is None else use).alias("use"))

    kind = rows.select(use.alias("use")).schema["use"].dataType
    rows = rows.withColumns({"asked_value": F.when(F.col("pattern").isNotNull(), value), "shown": type_of(F.col("value"))})
    defined = F.when(F.col("local").isNotNull(), row(F.lit(DEFINITION), F.col("local"), F.col("value"), _passed(F.col("value")), asked=F.col("shown")))
    used = F.when(F.col("pattern").isNotNull(), row(side, F.when(side == START, F.col("base")), F.col("asked_value"), F.when(side == SEND, _passed(F.col("asked_value"))), use=use))
    given = F.when((F.col("kind") == "special") & (F.col("name") == "<init>") & F.col("base").isNotNull(), F.transform("args", lambda arg, n: row(F.lit(GIVEN), F.col("base"), arg, place=n, asked=F.get("types", n), owner=F.col("class"))))
    rows = rows.select(*BODY, "idx", F.explode_outer(F.concat(F.array(defined, used), F.coalesce(given, F.array()))).alias("row"))
    rows = rows.where("row is not null").select(*BODY, "idx", "row.*")
    rows = _threads(rows, able, of_thread=F.col("owner")).where((F.col("side") != GIVEN) | F.col("of_thread")).drop("of_thread", "owner")
    rows = _told(rows, F.col("asked"), able, "class", "true AS _able")
    return rows.withColumn("fits", F.coalesce(F.col("_able") | F.col("asked").isin(T.THREAD, T.RUNNABLE), F.lit(False))).drop("_able", "asked")


def field_threads(stores: DataFrame, able: DataFrame) -> DataFrame:
    """analysis_id, field, field_class: the thread class that an initialiser makes anew for a field; of several the first by method
    and place. stores: analysis_id, method, idx, field, value; able: of `kin`."""
    made = _threads(stores.withColumn("field_class", new_class(F.col("value"))), able, is_thread=F.col("field_class")).where("is_thread")
    return made.groupBy("analysis_id", "field").agg(F.min_by("field_class", F.struct("method", "idx")).alias("field_class"))


def handed_on(units: DataFrame, hierarchy: DataFrame, able: DataFrame | None = None) -> DataFrame:
    """Calls that hand work to threads, handlers and executors, as `threads.threading_edges` takes them: analysis_id, caller, callsite,
    pattern, thread_new, thread_field, thread_type, work_new, work_type. able: of `kin`, where it is at hand.

    A thread is started by start() on a class below Thread, or on a local that stands for one. Its class is that of its `new`,
    else of the `new` that an initialiser stores into its field, else the type that its definition shows. What it runs is the
    argument of the last constructor called on the local, or on the local that it is a copy of. A message is followed to the
    Message.obtain that made it. Statements of any other form hand on nothing; bodies are read, shuffled and sorted once.
    """
    able = checkpointed(kin(hierarchy)) if able is None else able
    uses = checkpointed(walked(_read(units, able)).select(*BODY, "idx", "use.*", "value", "first", "work"))
    stores = checkpointed(field_threads(uses.where("pattern = 'store'"), able))
    begun = uses.where("pattern = 'thread_start'").withColumn("thread_type", F.coalesce(type_of(F.col("first")), type_of(F.col("value")))).withColumn("made", new_class(F.col("value"))).withColumn("field", field_of(F.col("value")))
    begun = _threads(begun, able, by_callee=F.col("class"), by_type=F.col("thread_type"), is_thread=F.col("made")).where("by_callee or by_type")
    begun = _told(begun, F.col("field"), stores, "field", "field_class AS thread_field")
    begun = begun.select(*BODY, "stmt", "pattern", F.when(F.col("is_thread"), F.col("made")).alias("thread_new"), "thread_field", F.coalesce("thread_type", "class").alias("thread_type"), "work")
    none = [F.lit(None).cast("string").alias(c) for c in ("thread_new", "thread_field", "thread_type")]
    posts = uses.where("pattern not in ('thread_start', 'store') and (pattern <> 'handler_message' or work is not null)").select(*BODY, "stmt", "pattern", *none, "work")
    every = begun.unionByName(posts)
    return every.select("analysis_id", F.col("method").alias("caller"), F.col("stmt").alias("callsite"), "pattern", "thread_new", "thread_field", "thread_type", new_class(F.col("work")).alias("work_new"), F.coalesce(type_of(F.col("work")), F.when(F.col("work").isNotNull() & (F.col("pattern") == "thread_start"), F.lit(T.RUNNABLE))).alias("work_type"))


def found_threading_edges(units: DataFrame, hierarchy: DataFrame, methods: DataFrame, parents: DataFrame, most: int | None = None) -> DataFrame:
    """Synthetic threading edges from statements alone (see `handed_on`, `answers` and `threads.threading_edges`)."""
    able = checkpointed(kin(hierarchy))
    calls = checkpointed(handed_on(units, hierarchy, able))
    below = able.select("analysis_id", "class")
    named = calls.select("analysis_id", F.explode(F.array("thread_new", "thread_field", "thread_type", "work_new", "work_type")).alias("class")).where("class is not null")
    runs = checkpointed(answers(methods, parents, below.union(named).distinct().withColumn("name", F.lit(RUN))).select("analysis_id", "class", F.col("target").alias("run")))
    return T.threading_edges(calls, runs, below, most)


def registrations(units: DataFrame) -> DataFrame:
    """analysis_id, method, idx, stmt, pattern, listener, answer, value: calls that register a listener, and what it stands for."""
    defs = checkpointed(definitions(units))
    calls = invocations(units).withColumn("types", S.params_of(F.col("callee"))).withColumn("pattern", S.method_of(F.col("callee")))
    known = F.array(*(F.struct(F.lit(m).alias("name"), F.lit(c).alias("listener"), F.lit(a).alias("alone"), F.lit(s).alias("answer")) for m, c, a, s in REGISTRATIONS))
    fit = F.get(F.filter(known, lambda k: (k["name"] == F.col("pattern")) & (k["listener"] == F.get("types", F.lit(0))) & (~k["alone"] | (F.size("types") == 1))), F.lit(0))
    rows = calls.withColumn("fit", fit).where("fit is not null and size(args) > 0")
    return resolved(rows.select(*BODY, "idx", "stmt", "pattern", "fit.listener", "fit.answer", F.get("args", F.lit(0)).alias("value")), defs, "value")


def _nearest(open_: DataFrame, able: DataFrame, most: int) -> DataFrame:
    """open_ (analysis_id, caller, listener, and others) with `callee`: targets of classes that fit the listener and lie within the
    caller's class, else in its package; the first `most` by class. able: analysis_id, listener, class, target."""
    parts = F.split("class", r"\$")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "$"))

    def first(rows: DataFrame, at: str) -> DataFrame:
        w = Window.partitionBy("analysis_id", "listener", at).orderBy("class")
        return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select("analysis_id", "listener", at, F.col("target").alias("callee"))

    inner = first(able.where(F.contains("class", F.lit("$"))).withColumn("owner", F.explode(above)), "owner")
    near = first(able.withColumn("package", S.package_of(F.col("class"))).where("package <> ''"), "package")
    rows = open_.withColumn("owner", S.class_of(F.col("caller"))).withColumn("package", S.package_of(F.col("owner")))
    within = rows.join(inner, ["analysis_id", "listener", "owner"]).select(*open_.columns, "callee")
    beside = rows.join(inner.select("analysis_id", "listener", "owner").distinct(), ["analysis_id", "listener", "owner"], "left_anti").join(near, ["analysis_id", "listener", "package"]).select(*open_.columns, "callee")
    return within.union(beside)


def found_listener_edges(units: DataFrame, hierarchy: DataFrame, methods: DataFrame, parents: DataFrame, most: int = T.FALLBACK) -> DataFrame:
    """Synthetic edges from where a listener is registered to what it is called back by: analysis_id, caller, callsite, callee,
    pattern, confidence, edge_source, edge_layer.

    A listener made anew gives its class's method with high confidence, one whose type is a class of the application with medium;
    else the listeners within the caller's class, or in its package, stand in with low, cut to `most` before the join. Only
    classes that the listener's type can hold count.
    """
    found = registrations(units).select("analysis_id", F.col("method").alias("caller"), F.col("stmt").alias("callsite"), "pattern", "listener", "answer", new_class(F.col("value")).alias("made"), type_of(F.col("value")).alias("shown"))
    found = checkpointed(found.withColumn("class", F.coalesce("made", "shown")))
    kinds = hierarchy.sparkSession.createDataFrame([(c, s) for _, c, _, s in REGISTRATIONS], "listener string, name string")
    fits = hierarchy.select("analysis_id", "class", F.col("supertype").alias("listener")).distinct().join(kinds, "listener")
    able = answers(methods, parents, fits.select("analysis_id", "class", "name"))
    able = checkpointed(fits.join(able, ["analysis_id", "class", "name"]).select("analysis_id", "listener", "class", "target"))
    told = found.join(able, ["analysis_id", "listener", "class"], "left")
    out = ["analysis_id", "caller", "callsite", "callee", "pattern", "confidence"]
    direct = told.where("target is not null").select("analysis_id", "caller", "callsite", F.col("target").alias("callee"), "pattern", F.when(F.col("made").isNotNull(), "high").otherwise("medium").alias("confidence"))
    low = _nearest(told.where("target is null").select("analysis_id", "caller", "callsite", "pattern", "listener"), able, most).withColumn("confidence", F.lit("low"))
    return direct.unionByName(low.select(*out)).distinct().withColumn("edge_source", F.lit("listener_registration_synthetic")).withColumn("edge_layer", F.lit("synthetic"))
