"""Hand-offs between stages: documents held against nested schemas, and calls against the claims that cover them.

A schema is compiled to one SQL expression over a VARIANT, so a document is parsed once and never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FAULT = "struct<loc:string,message:string>"
_NONE = f"cast(array() as array<{_FAULT}>)"
_STRING, _STRINGS, _BOOLEAN = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "boolean"}
_SHARE = {"type": "number", "minimum": 0, "maximum": 1}

#: What hand-offs have to hold, by kind.
CLAIM = {
    "type": "object", "required": ["claim_id", "claim_type", "tier1_field", "unit_id", "interpretation", "source_unit_ids", "resolved_by", "confidence"],
    "properties": {
        "claim_id": {"type": "string", "pattern": "^c[0-9]{3}$"}, "claim_type": {"type": "string", "enum": ["effect", "constraint", "input"]}, "tier1_field": {"type": "string", "enum": ["path_constraints", "observable_effects", "required_inputs"]},
        "unit_id": _STRING, "interpretation": {"type": "string", "minLength": 10}, "source_unit_ids": _STRINGS | {"minItems": 1}, "resolved_by": {"type": "string", "enum": ["jadx", "cfg", "heuristic", "unresolved"]}, "confidence": _SHARE, "needs_investigation": _BOOLEAN,
    },
}
LOOKUP = {"type": "object", "required": ["unit_id", "tool_used", "success"], "properties": {"unit_id": _STRING, "tool_used": {"type": "string", "enum": ["read_java_source", "read_cfg_units", "search_java_source"]}, "tool_args": {"type": "object"}, "success": _BOOLEAN}}
FACT = {"type": "object", "required": ["statement", "confidence"], "properties": {"statement": {"type": "string", "minLength": 5}, "support_unit_ids": _STRINGS, "from_deterministic": _BOOLEAN, "confidence": _SHARE}}
SCHEMAS = {
    "structure": {
        "type": "object", "required": ["seed_id", "api_calls", "extraction_coverage", "extraction_confidence"],
        "properties": {"seed_id": _STRING, "api_calls": {"type": "array", "items": {"type": "object"}}, "control_guards": {"type": "array", "items": {"type": "object"}}, "ambiguous_units": _STRINGS, "flagged_for_review": _STRINGS, "extraction_coverage": {"type": "string", "enum": ["complete", "partial", "minimal"]}, "extraction_confidence": _SHARE},
    },
    "claim": CLAIM, "lookup": LOOKUP, "fact": FACT,
    "behaviour": {"type": "object", "required": ["seed_id", "claims"], "properties": {"seed_id": _STRING, "claims": {"type": "array", "items": CLAIM}, "source_lookups": {"type": "array", "items": LOOKUP}, "unresolved": _STRINGS, "unclaimed_apis": _STRINGS}},
}
#: Shares of calls without a claim, and of open ambiguities, above which a phase has failed, or is partial.
UNCLAIMED_FAILS, OPEN_FAILS, OPEN_PARTIAL = 0.5, 0.5, 0.2


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, use: str) -> str:
    """`use`, an array of faults in which `name` stands for the value, computed once. By aggregate, as get(transform(..)) works out the
    type of all that it holds anew for every row."""
    return f"aggregate(array({value}), {_NONE}, (_before, {name}) -> {use})"


def _shown(value: str) -> str:
    """A value as messages show it: strings in quotes, others as JSON."""
    return f"IF(schema_of_variant({value}) = 'STRING', concat('\\'', try_variant_get({value}, '$', 'string'), '\\''), to_json({value}))"


def _told(when: str, loc: list[str], message: str) -> str:
    """A fault, or null."""
    place = f"concat({', '.join(loc)})" if loc else "''"
    return f"IF({when}, named_struct('loc', {place}, 'message', {message}), NULL)"


def _at(loc: list[str], part: str) -> list[str]:
    return [*loc, "'.'", part] if loc else [part]


#: What schema_of_variant says of simple values. Objects and arrays are told by a cast instead: it would go through all that they hold.
_NAMED = {"string": "= 'STRING'", "boolean": "= 'BOOLEAN'", "integer": "= 'BIGINT'", "null": "= 'VOID'", "number": "NOT RLIKE '^(OBJECT|ARRAY|STRING|BOOLEAN|VOID)'"}


def _array(parts: list[tuple[bool, str]]) -> str:
    """One array of parts in order, each (whether it is an array, SQL of a fault or null, or of an array of faults)."""
    runs: list[str] = []
    for many, group in groupby(parts, lambda p: p[0]):
        sql = [x for _, x in group]
        runs += sql if many else [f"array_compact(array({', '.join(sql)}))"]
    return _NONE if not runs else runs[0] if len(runs) == 1 else f"concat({', '.join(runs)})"


def faults(value: str, schema: dict) -> Column:
    """array<struct<loc, message>>: where the VARIANT in column `value` departs from a schema, in order of the schema; loc names the
    place by keys and places joined by dots, empty for the whole. Of a value of a wrong type only that is told. A null value has no
    faults."""
    return F.expr(_array(_parts(value, schema, [], count())))


def _parts(value: str, schema: dict, loc: list[str], names: Iterator[int]) -> list[tuple[bool, str]]:
    """Parts of `_array` for a value. What is judged item by item or key by key is read once, by one cast."""
    wanted, keys, items = schema.get("type"), dict.fromkeys([*schema.get("required", ()), *schema.get("properties", {})]), schema.get("items")
    wrong = f"concat({_shown(value)}, {_quoted(f' is not of type {wanted!r}')})"
    checks = [(False, _told(f"{value} IS NOT NULL AND {when}", loc, message)) for when, message in _checks(value, schema)]
    if wanted in _NAMED and not keys and items is None:
        fits, told = f"schema_of_variant({value}) {_NAMED[wanted]}", _checks(value, schema)
        first = "".join(f" WHEN {when} THEN {_told('true', loc, message)}" for when, message in [(f"NOT ({fits})", wrong), *told[:1]])
        return [(False, f"CASE WHEN {value} IS NULL THEN NULL{first} END"), *((False, _told(f"{fits} AND {when}", loc, message)) for when, message in told[1:])]
    if wanted == "object" and not keys and not checks:
        return [(False, _told(f"{value} IS NOT NULL AND try_variant_get({value}, '$', 'struct<>') IS NULL", loc, wrong))]
    o, a = (f"{c}{next(names)}" for c in "oa")
    read = []  # what is bound for this value: name, SQL
    if keys or wanted == "object":
        plain = {k for n, k in enumerate(keys) if k.lower() not in [x.lower() for x in list(keys)[:n]]}
        fields = ", ".join(f"`{k.replace('`', '``')}`: variant" for k in keys if k in plain)
        read.append((o, f"try_variant_get({value}, '$', {_quoted(f'struct<{fields}>')})"))
        # fields of a struct are found in any case; a name that differs from another by its case alone is read by itself
        child = {k: f"{o}.`{k.replace('`', '``')}`" if k in plain else f"try_variant_get({value}, {_quoted(f'$.{k}')}, 'variant')" for k in keys}
        checks += [(False, _told(f"{value} IS NOT NULL AND {child[k]} IS NULL", loc, _quoted(f"'{k}' is a required property"))) for k in schema.get("required", ())]
        for k, inner in schema.get("properties", {}).items():
            checks += _parts(child[k], inner, _at(loc, _quoted(k)), names)
    if items is not None or "minItems" in schema or wanted == "array":
        read.append((a, f"try_variant_get({value}, '$', 'array<variant>')"))
        if "minItems" in schema:
            checks.append((False, _told(f"size({a}) < {schema['minItems']}", loc, f"concat({_shown(value)}, ' is too short')")))
    if items is not None:
        x, k = (f"{c}{next(names)}" for c in "xk")
        inner = _parts(x, items, _at(loc, f"CAST({k} AS STRING)"), names)
        one = len(inner) == 1 and not inner[0][0]
        every = f"transform({a}, ({x}, {k}) -> {inner[0][1] if one else _array(inner)})"
        checks.append((True, f"coalesce({f'array_compact({every})' if one else f'flatten({every})'}, {_NONE})"))
    fits = {None: "true", "object": f"{o} IS NOT NULL", "array": f"{a} IS NOT NULL"}.get(wanted) or f"schema_of_variant({value}) {_NAMED[wanted]}"
    out = _array(checks)
    if wanted is not None:
        out = f"CASE WHEN {value} IS NULL THEN {_NONE} WHEN {fits} THEN {out} ELSE array({_told('true', loc, wrong)}) END"
    for name, sql in reversed(read):
        out = _let(name, sql, out)
    return [(True, out)]


def _checks(value: str, schema: dict) -> list[tuple[str, str]]:
    """Checks of a value by itself: SQL of what is wrong, SQL of the message."""
    text, number, told = f"try_variant_get({value}, '$', 'string')", f"try_variant_get({value}, '$', 'double')", []
    if "enum" in schema:
        told.append((f"{text} NOT IN ({', '.join(map(_quoted, schema['enum']))})", f" is not one of {schema['enum']}"))
    if "pattern" in schema:
        told.append((f"NOT {text} RLIKE {_quoted(schema['pattern'])}", f" does not match '{schema['pattern']}'"))
    if "minLength" in schema:
        told.append((f"char_length({text}) < {schema['minLength']}", " is too short"))
    low, high = schema.get("minimum"), schema.get("maximum")
    less, more = f" is less than the minimum of {low}", f" is greater than the maximum of {high}"
    told = [(when, _quoted(message)) for when, message in told]
    if low is not None and high is not None and low <= high:  # at most one of both
        told.append((f"{number} NOT BETWEEN {low} AND {high}", f"IF({number} < {low}, {_quoted(less)}, {_quoted(more)})"))
    else:
        told += [(f"{number} {sign} {bound}", _quoted(message)) for sign, bound, message in (("<", low, less), (">", high, more)) if bound is not None]
    return [(when, f"concat({_shown(value)}, {message})") for when, message in told]


def validated(rows: DataFrame, kind: Column, text: str = "body", schemas: dict | None = None) -> DataFrame:
    """rows plus ok and errors (`loc: message`, of places in order; `message` alone for the whole). A text that is no JSON, or null, has
    one error; a kind without a schema is not judged further than that."""
    body = F.try_parse_json(F.col(text))
    rows = rows.withColumn("_body", body).withColumn("_kind", kind)
    found = F.expr(_NONE)
    for name, schema in (schemas or SCHEMAS).items():
        found = F.when(F.col("_kind") == name, faults("_body", schema)).otherwise(found)
    told = F.transform(found, lambda f: F.when(f["loc"] == "", f["message"]).otherwise(F.concat(f["loc"], F.lit(": "), f["message"])))
    errors = F.when(F.col("_body").isNull(), F.array(F.lit("no JSON"))).otherwise(told)
    return rows.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0).drop("_body", "_kind")


def claim_coverage(calls: DataFrame, claims: DataFrame, ambiguous: DataFrame, lookups: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Verdict on each seed with calls or ambiguous units: seed_id, n_calls, n_claimed, coverage, n_ambiguous, n_looked_up,
    unresolved_ratio, status.

    All tables have seed_id, unit_id (repeats count once; calls of a seed count by rows for its size); claims also claim_type, of which
    `effect` covers a call; where tables have an analysis_id it is part of the key. A seed has failed if more than half of its
    calls are not claimed, is partial if any is not; then an open share of the ambiguous units above a half fails it and one
    above a fifth makes it partial; a seed without calls is ok.
    """
    key = [c for c in ("analysis_id", "seed_id") if c in calls.columns]
    unit = [*key, "unit_id"]
    none = [F.lit(0).alias(n) for n in ("call", "claim", "ask", "found", "open")]
    put = lambda df, name: df.select(*unit, *(F.lit(1).alias(name) if n == name else c for n, c in zip(("call", "claim", "ask", "found", "open"), none)))
    marks = put(calls, "call")
    for df, name in ((claims.where("claim_type = 'effect'"), "claim"), (ambiguous, "ask"), (lookups, "found"), (unresolved, "open")):
        marks = marks.unionByName(put(df, name))
    # every mark of a unit is summed in one pass behind one shuffle: maps of a scan's units, which combine little, grow with the scan
    per = marks.repartition(*unit).groupBy(*unit).agg(*(F.sum(n).alias(n) for n in ("call", "claim", "ask", "found", "open")))
    named = F.col("unit_id").isNotNull()
    for k in key:
        named = named & F.col(k).isNotNull()
    called, asked = F.col("call") > 0, F.col("ask") > 0
    claimed, seen = named & (F.col("claim") > 0), named & (F.col("found") > 0)
    count = lambda c: F.count(F.when(c, 1))
    rows = per.groupBy(*key).agg(F.sum("call").alias("n_calls"), count(called & claimed).alias("n_claimed"), count(called & ~claimed).alias("n_unclaimed"), count(asked).alias("n_ambiguous"), count(asked & seen).alias("n_looked_up"), F.sum("ask").alias("_asked"), F.sum("open").alias("_open"))
    rows = rows.where("n_calls > 0 or _asked > 0")
    open_ = F.when(F.col("_asked") > 0, F.col("_open") / F.col("_asked")).otherwise(0.0)
    missed = F.when(F.col("n_calls") > 0, F.col("n_unclaimed") / F.col("n_calls")).otherwise(0.0)
    status = (F.when(F.col("n_calls") == 0, "ok").when(missed > UNCLAIMED_FAILS, "failed").when(F.col("n_unclaimed") > 0, "partial").when(open_ > OPEN_FAILS, "failed").when(open_ > OPEN_PARTIAL, "partial").otherwise("ok"))
    units = F.col("n_claimed") + F.col("n_unclaimed")
    return rows.select(*key, "n_calls", "n_claimed", F.when(units > 0, F.col("n_claimed") / units).otherwise(1.0).alias("coverage"), "n_ambiguous", "n_looked_up", open_.alias("unresolved_ratio"), status.alias("status"))


def unclaimed(calls: DataFrame, claims: DataFrame) -> DataFrame:
    """key, unit_id of calls that no effect claim covers, once each."""
    unit = [c for c in ("analysis_id", "seed_id", "unit_id") if c in calls.columns]
    return calls.select(*unit).distinct().join(claims.where("claim_type = 'effect'").select(*unit), unit, "left_anti")
