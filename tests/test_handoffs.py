import json

from callatlas.operators import handoffs as H
from pyspark.sql import functions as F

CLAIM = {"claim_id": "c001", "claim_type": "effect", "tier1_field": "observable_effects", "unit_id": "u1", "interpretation": "reads the device id", "source_unit_ids": ["u1"], "resolved_by": "jadx", "confidence": 0.5}
STRUCTURE = {"seed_id": "s", "api_calls": [], "extraction_coverage": "partial", "extraction_confidence": 1}
SHORT = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}, "b": {"type": "array", "items": {"type": "array", "items": {"type": "string", "minLength": 2}}, "minItems": 1}, "c": {"type": "null"}, "d": {}}}


def errors(spark, rows, schemas=None):
    body = [(k, kind, x if isinstance(x, str) or x is None else json.dumps(x)) for k, (kind, x) in enumerate(rows)]
    frame = spark.createDataFrame(body, "id int, kind string, body string")
    got = {r["id"]: (r["ok"], r["errors"]) for r in H.validated(frame, F.col("kind"), schemas=schemas).collect()}
    assert all(ok == (not e) for ok, e in got.values())
    return [got[k][1] for k in range(len(rows))]


def test_hand_offs_of_all_kinds(spark):
    fact, lookup = {"statement": "it does", "confidence": 0}, {"unit_id": "u", "tool_used": "read_cfg_units", "success": True}
    good = [("claim", CLAIM), ("structure", STRUCTURE), ("fact", fact), ("lookup", lookup), ("behaviour", {"seed_id": "s", "claims": [CLAIM], "source_lookups": [lookup]}), ("other", {"x": 1})]
    bad = [
        ("claim", CLAIM | {"claim_id": "c1", "confidence": 1.5, "interpretation": "short"}), ("claim", {k: v for k, v in CLAIM.items() if k not in ("unit_id", "confidence")}), ("claim", CLAIM | {"source_unit_ids": [], "claim_type": "other"}),
        ("structure", STRUCTURE | {"extraction_confidence": "high", "api_calls": [1, {}], "ambiguous_units": ["a", 2]}), ("fact", fact | {"confidence": -0.1, "statement": None}), ("lookup", lookup | {"tool_used": "other", "success": 1}),
        ("behaviour", {"seed_id": "s", "claims": [CLAIM, CLAIM | {"confidence": 2}, 5]}), ("claim", "no json"), ("claim", None), ("claim", [1])]
    got = errors(spark, good + bad)
    assert got[:6] == [[]] * 6
    assert got[6] == ["claim_id: 'c1' does not match '^c[0-9]{3}$'", "interpretation: 'short' is too short", "confidence: 1.5 is greater than the maximum of 1"]
    assert got[7] == ["'unit_id' is a required property", "'confidence' is a required property"]
    assert got[8] == ["claim_type: 'other' is not one of ['effect', 'constraint', 'input']", "source_unit_ids: [] is too short"]
    assert got[9] == ["api_calls.0: 1 is not of type 'object'", "ambiguous_units.1: 2 is not of type 'string'", "extraction_confidence: 'high' is not of type 'number'"]
    assert got[10] == ["statement: null is not of type 'string'", "confidence: -0.1 is less than the minimum of 0"]
    assert got[11] == ["tool_used: 'other' is not one of ['read_java_source', 'read_cfg_units', 'search_java_source']", "success: 1 is not of type 'boolean'"]
    assert got[12] == ["claims.1.confidence: 2 is greater than the maximum of 1", "claims.2: 5 is not of type 'object'"]
    assert got[13:] == [["no JSON"], ["no JSON"], ["[1] is not of type 'object'"]]


def test_nesting_and_types(spark):
    rows = [{"a": 2, "b": [["xx"], []], "c": None, "d": [1]}, {"a": 1.5}, {"a": 1}, {"a": 2, "b": []}, {"a": 2, "b": [["xx", "y"], 3, [True]]}, {"a": 2, "c": 0}, {"b": [["y"]]}]
    got = errors(spark, [("t", r) for r in rows], {"t": SHORT})
    assert got == [[], ["a: 1.5 is not of type 'integer'"], ["a: 1 is less than the minimum of 2"], ["b: [] is too short"], ["b.0.1: 'y' is too short", "b.1: 3 is not of type 'array'", "b.2.0: true is not of type 'string'"], ["c: 0 is not of type 'null'"], ["'a' is a required property", "b.0.0: 'y' is too short"]]


def test_each_level_of_a_document_is_read_once(spark):
    """Keys are read by one cast a level, not one by one, and no level is bound by get(transform(..)), which works its type out anew for
    every row."""
    frame = spark.createDataFrame([], "id int, kind string, body string")
    plan = H.validated(frame, F.col("kind"))._jdf.queryExecution().analyzed().toString()
    assert "get(transform(" not in plan and plan.count("try_variant_get(") < 150


def test_names_that_differ_by_case_and_faults_of_one_value(spark):
    bounds = {"t": {"minimum": 3, "maximum": 1}}
    assert errors(spark, [("t", 2)], bounds) == [["2 is less than the minimum of 3", "2 is greater than the maximum of 1"]]
    schema = {"t": {"type": "object", "required": ["a", "A"], "properties": {"a": {"type": "string", "minLength": 3, "enum": ["it's", "xyz"], "pattern": "^[\\\\a-z']+$"}, "A": {"type": "object"}, "b`c": {"type": "array"}}}}
    got = errors(spark, [("t", r) for r in ({"a": "it's", "A": {}}, {"a": "1"}, {"A": 5, "b`c": {}}, {"a": None, "A": None})], schema)
    assert got == [[], ["'A' is a required property", "a: '1' is not one of [\"it's\", 'xyz']", "a: '1' does not match '^[\\\\a-z']+$'", "a: '1' is too short"],
                   ["'a' is a required property", "A: 5 is not of type 'object'", "b`c: {} is not of type 'array'"], ["a: null is not of type 'string'", "A: null is not of type 'object'"]]


def coverage(spark, calls, claims, ambiguous=(), lookups=(), unresolved=()):
    u = lambda rows: spark.createDataFrame([tuple(r.split(":")) for r in rows], "seed_id string, unit_id string")
    c = spark.createDataFrame([tuple(r.split(":")) for r in claims], "seed_id string, unit_id string, claim_type string")
    got = H.claim_coverage(u(calls), c, u(ambiguous), u(lookups), u(unresolved)).collect()
    gone = {(r["seed_id"], r["unit_id"]) for r in H.unclaimed(u(calls), c).collect()}
    return {r["seed_id"]: tuple(r)[1:] for r in got}, gone


def test_claims_cover_calls(spark):
    calls = ["ok:u1", "ok:u2", "part:u1", "part:u2", "half:u1", "half:u2", "fail:u1", "fail:u2", "fail:u3", "twice:u1", "twice:u1", "open:u1", "much:u1", "kind:u1"]
    claims = ["ok:u1:effect", "ok:u1:effect", "ok:u2:effect", "ok:u9:effect", "part:u1:effect", "part:u2:input", "half:u2:effect", "fail:u1:effect", "twice:u1:effect", "open:u1:effect", "much:u1:effect", "kind:u1:constraint", "none:u1:effect"]
    ambiguous = ["open:a", "open:b", "open:c", "open:d", "much:a", "only:a", "only:b"]
    got, gone = coverage(spark, calls, claims, ambiguous, ["open:a", "open:b", "open:z", "only:a"], ["open:c", "much:a", "only:a", "only:b"])
    assert {k: v[-1] for k, v in got.items()} == {"ok": "ok", "part": "partial", "half": "partial", "fail": "failed", "twice": "ok", "open": "partial", "much": "failed", "kind": "failed", "only": "ok"}
    assert got["fail"][:3] == (3, 1, 1 / 3) and got["open"][3:6] == (4, 2, 0.25) and got["twice"][:3] == (2, 1, 1.0) and got["only"][:6] == (0, 0, 1.0, 2, 1, 1.0)
    assert gone == {("part", "u2"), ("half", "u1"), ("fail", "u2"), ("fail", "u3"), ("kind", "u1")}


def test_empty(spark):
    assert coverage(spark, ["a:b"], ["a:b:effect"])[0]["a"][-1] == "ok"
    frame = spark.createDataFrame([], "id int, kind string, body string")
    assert H.validated(frame, F.col("kind")).collect() == []
