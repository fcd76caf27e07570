import random
import re

import pytest
from callatlas.functions.constants import CONSTANT_ALIASES, METHOD_ALIASES
from callatlas.operators import grounding as G

URL, IP, DOMAIN = re.compile(r"https?://[^\s\"'<>]+", re.I), re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), re.compile(r"\b[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b")


def frames(spark, facts, units, strings):
    return (spark.createDataFrame(facts, "seed_id string, idx int, fact string, support_unit_ids array<string>"), spark.createDataFrame(units, "seed_id string, unit_id string, stmt string"),
            spark.createDataFrame([(s, k, t) for k, (s, t) in enumerate(strings)], "seed_id string, ord int, text string"))


def brute(facts, units, strings, least, strict):
    """A fact at a time, over all of its seed."""
    out = []
    for seed, idx, fact, ids in facts:
        text = fact or ""
        known = {u: s or "" for a, u, s in units if a == seed}
        near = {t for a, t in strings if a == seed}
        out += [(seed, idx, -1, "error", f"missing unit {u}", None) for u in sorted({u for u in ids or [] if u not in known})]
        said = " ".join(known.get(u, "") for u in ids or [])
        low = said.lower()
        names = set()
        numbers = set(re.findall(r"\((\d+)\)", said)) | set(re.findall(r"=\s*(\d+)\s*[;,\)]", said)) | {"-" + n for n in re.findall(r"\(-(\d+)\)", said)}
        for n in numbers:
            names |= set(CONSTANT_ALIASES.get(n, ()))
        for m, other in METHOD_ALIASES.items():
            names |= set(other) if m in low else set()
        words = [w for w in re.findall(r"[a-zA-Z0-9_.$]+", text.lower()) if len(w) > 2]
        if words and said:
            vocabulary = set(low.split()) | names
            met = sum(w in low or any(w in v or v in w for v in vocabulary) for w in words)
            ratio = met / len(words)
            if strict and not any(w in low for w in words):
                out.append((seed, idx, 0, "error", "No token overlap with supporting statements", None))
            elif not strict and ratio < least:
                out.append((seed, idx, 0, "warning", f"Low token overlap ({ratio:.1%} < {least:.0%})", ratio))
            elif not strict and ratio < 0.5:
                out.append((seed, idx, 0, "info", f"Moderate token overlap ({ratio:.1%})", ratio))
        for place, (label, pattern) in enumerate((("url", URL), ("ip", IP), ("domain", DOMAIN)), 1):
            for m in pattern.findall(text):
                part = {"url": None, "ip": ".".join(m.split(".")[:2]), "domain": ".".join(m.split(".")[-2:])}[label]
                if m in near or m in said or (part and (any(part in s for s in near) or part in said)):
                    continue
                out.append((seed, idx, place, "error" if strict else "warning", f"{label} '{m}' not {'' if strict else 'directly '}present in slice or strings", None))
    return sorted(out, key=str)


def some(seed):
    rng = random.Random(seed)
    stmts = ["$r = virtualinvoke $m.<android.telephony.TelephonyManager: java.lang.String getDeviceId()>()", "virtualinvoke $x.<android.media.MediaRecorder: void setAudioSource(int)>(1)", "$i = 2038;", "$p = (-3)", "id = 268435456 ;", 'url = "http://evil.example.com/a"', "call 10.1.2.3", "", "x  y\tz", "imei"]
    claims = ["Calls getDeviceId", "reads the imei and device_id", "uses microphone with audiosource.mic", "shows type_application_overlay windows", "sends to http://evil.example.com/a now", "contacts 10.1.9.9 and 192.168.0.1", "talks to cdn.example.com or other.net", "", "no", "translucent overlay new_task", "HTTPS://Up.Per/x?y=1", "nothing at all like it here $r", "abc $p xyz the end of it"]
    texts = ["http://evil.example.com/a", "see example.com", "192.168.1.1", "other", "10.1"]
    units = [(f"s{k}", f"u{j}", rng.choice(stmts)) for k in range(12) for j in range(rng.randint(0, 5))]
    facts = [(f"s{k}", i, rng.choice([*claims, None]) if rng.random() < 0.8 else " ".join(rng.sample(claims, 3)), rng.choice([None, [], [f"u{rng.randint(0, 6)}" for _ in range(rng.randint(1, 4))]])) for k in range(13) for i in range(9)]
    return facts, units, [(f"s{k}", rng.choice(texts)) for k in range(8) for _ in range(2)]


@pytest.mark.parametrize("strict, least", [(False, 0.2), (True, 0.2), (False, 0.45)])
def test_faults_match_brute_force(spark, strict, least):
    facts, units, strings = some(7)
    got = G.grounding_faults(*frames(spark, facts, units, strings), least, strict)
    assert sorted(map(tuple, got.collect()), key=str) == brute(facts, units, strings, least, strict)


def verdict(spark, facts, units, strings=(), **mode):
    f, u, s = frames(spark, facts, units, list(strings) or [("other", "x")])
    return {r["seed_id"]: r.asDict() for r in G.grounding(f, G.grounding_faults(f, u, s, **mode)).collect()}


def test_supported_and_missing_units(spark):
    units = [("s", "u1", "r0 = virtualinvoke r1.getDeviceId()"), ("t", "u1", "r0 = virtualinvoke r1.getDeviceId()")]
    got = verdict(spark, [("s", 0, "Calls getDeviceId", ["u1"]), ("t", 0, "Calls getDeviceId", ["u2", "u2", "u0"]), ("v", 0, "Says a.b.com", None)], units)
    assert got["s"]["ok"] and got["s"]["repair_hint"] == "" and got["s"]["missing_unit_ids"] == []
    assert not got["t"]["ok"] and got["t"]["missing_unit_ids"] == ["u0", "u2"] and got["t"]["repair_hint"] == G.REPAIR
    assert got["v"]["ok"] and got["v"]["n_warnings"] == 1  # an address that nothing has is a warning
    strict = verdict(spark, [("v", 0, "Says a.b.com", None)], units, strict=True)
    assert not strict["v"]["ok"] and strict["v"]["n_mismatched"] == 1


def test_names_of_constants_and_methods_count(spark):
    units = [("s", "u", "virtualinvoke $x.<android.media.MediaRecorder: void setAudioSource(int)>(1)")]
    assert verdict(spark, [("s", 0, "microphone", ["u"])], units)["s"]["n_warnings"] == 0
    assert verdict(spark, [("s", 0, "camcorder", ["u"])], units)["s"]["n_warnings"] == 1


def test_analyses_are_apart_and_empty(spark):
    f, u, s = frames(spark, [("s", 0, "Calls getDeviceId", ["u1"])], [("s", "u1", "getDeviceId")], [("s", "x")])
    two = [d.selectExpr("explode(array('a', 'b')) as analysis_id", "*") for d in (f, u, s)]
    two[1] = two[1].where("analysis_id = 'a'")
    got = G.grounding(two[0], G.grounding_faults(*two))
    assert {r["analysis_id"]: r["ok"] for r in got.collect()} == {"a": True, "b": False}
    assert G.grounding(f.limit(0), G.grounding_faults(f.limit(0), u, s)).collect() == []
