import copy
import datetime
import json
import re

import pytest

from tablewright.operators.contracts import MANIFEST, contract_errors

H = "sha256:" + "0a" * 32
GOOD = {
    "manifestVersion": "1.0", "requestId": "r", "schemaVersion": "1", "engineVersion": "e", "createdAt": "2024-02-29T10:00:00.5Z", "hashes": {"inputBundleHash": H, "compressedBundleHash": H},
    "summary": {"itemsIn": 1, "itemsOut": 1.0, "fieldsCanonicalized": 0, "conflictsResolved": 0, "fieldsDroppedLowConfidence": 0, "avgLossScore": 0.5},
    "items": [
        {
            "itemId": "i",
            "fieldChanges": [
                {"field": "price", "decision": "dedupe", "beforeCandidates": [{"value": None, "confidence": 1, "source": "s", "evidenceId": "e"}, {"value": {"a": [1]}, "confidence": 0, "source": "s", "evidenceId": "e"}],
                 "afterCanonical": {"value": [], "confidence": 0.25, "source": "s"}, "loss": {"score": 0.01, "type": "t", "notes": ""}, "rationale": "why"}
            ],
            "evidenceAnchors": [{"evidenceId": "e", "source": "s", "origin": {"url": "u", "fetchedAt": "2024-01-01T00:00:00+02:00"}, "locator": {"type": "css", "css": "a"}, "snippetHash": H, "confidenceContribution": 1}],
            "lossTotals": {"fieldLossScoreSum": 3.5, "fieldCount": 2, "avgFieldLoss": 0},
        },
        {"itemId": "j", "fieldChanges": [], "evidenceAnchors": [], "lossTotals": {"fieldLossScoreSum": 0, "fieldCount": 0, "avgFieldLoss": 0}},
    ],
    "ops": [{"op": "o", "at": "2024-01-01t23:59:60z", "stats": {}, "ruleId": "", "notes": "n"}],
}


def plain(x, s, path="$"):
    """The same by a walk over Python values."""
    out = []
    if s is True or s == {}:
        return out
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    is_a = {"object": isinstance(x, dict), "array": isinstance(x, list), "string": isinstance(x, str), "boolean": isinstance(x, bool), "null": x is None, "number": number, "integer": number and x == int(x)}
    if "type" in s and not any(is_a[t] for t in (s["type"] if isinstance(s["type"], list) else [s["type"]])):
        out.append(f"{path}: type")
    if "enum" in s and x not in s["enum"]:
        out.append(f"{path}: enum")
    if isinstance(x, str):
        if "pattern" in s and not re.search(s["pattern"].replace("$", r"\Z"), x):
            out.append(f"{path}: pattern")
        if len(x) < s.get("minLength", 0):
            out.append(f"{path}: minLength")
        if "format" in s:
            m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[Tt](\d\d):(\d\d):(\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)", x, re.A)
            try:
                ok = bool(m) and bool(datetime.date.fromisoformat(m[1])) and int(m[2]) < 24 and int(m[3]) < 60 and int(m[4]) < 61
            except ValueError:
                ok = False
            out += [] if ok else [f"{path}: format"]
    if number:
        out += [f"{path}: minimum"] if x < s.get("minimum", x) else []
        out += [f"{path}: maximum"] if x > s.get("maximum", x) else []
    if isinstance(x, dict):
        known = s.get("properties", {})
        out += [f"{path}.{k}: required" for k in s.get("required", []) if k not in x]
        if s.get("additionalProperties") is False:
            out += [f"{path}.{k}: additionalProperties" for k in x if k not in known]
        for k, sub in known.items():
            if k in x:
                out += plain(x[k], sub, f"{path}.{k}")
    if isinstance(x, list) and "items" in s:
        for i, y in enumerate(x):
            out += plain(y, s["items"], f"{path}[{i}]")
    return out


def mutations(x, path=()):
    """Documents that differ from GOOD in one place: every value replaced by each of several, every key gone, and a key too many."""
    if isinstance(x, dict):
        yield path, ("add", "extra")
        for k, y in x.items():
            yield path, ("drop", k)
            yield from mutations(y, (*path, k))
    elif isinstance(x, list):
        for i, y in enumerate(x):
            yield from mutations(y, (*path, i))
    for new in (None, "", "x", 7, -1, 0.5, 1.5, True, [], {}, "2023-02-29T00:00:00Z", "2024-01-01T25:00:00Z", "2024-01-01", "1.0\n", H + "\n", H.upper()):
        yield path, ("set", new)


def mutated():
    out = []
    for path, (how, what) in mutations(GOOD):
        doc = copy.deepcopy(GOOD)
        if how == "set" and not path:
            out.append(what)
            continue
        at = doc
        for p in path if how != "set" else path[:-1]:
            at = at[p]
        if how == "add":
            at[what] = 1
        elif how == "drop":
            del at[what]
        else:
            at[path[-1]] = what
        out.append(doc)
    return out


def test_every_mutation_of_a_manifest(spark):
    docs = [GOOD, *mutated()]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").repartition(16)
    got = {r.i: sorted(r.e) for r in rows.select("i", contract_errors("j", MANIFEST).alias("e")).collect()}
    want = {i: sorted(plain(d, MANIFEST)) for i, d in enumerate(docs)}
    assert got == want
    assert want[0] == [] and len(docs) > 900
    words = {e.split(": ")[1] for w in want.values() for e in w}
    assert words == {"type", "required", "additionalProperties", "pattern", "minLength", "format", "minimum", "maximum", "enum"}


def test_other_keywords_and_bad_documents(spark):
    schema = {
        "type": ["object", "array"], "minProperties": 1, "maxProperties": 2, "properties": {"a": {"anyOf": [{"type": "null"}, {"const": 1}]}, "b": {"not": {"type": "string"}, "maxLength": 1}},
        "additionalProperties": {"exclusiveMinimum": 0, "exclusiveMaximum": 5}, "items": {"allOf": [{"minimum": 2}, {"type": "integer"}]}, "minItems": 1, "maxItems": 2,
    }
    cases = {
        None: ["$: json"], "": ["$: json"], "{'a'": ["$: json"], '{"a":1} x': ["$: json"], '{"a":1},{}': ["$: json"], '"a":1}': ["$: json"], "null": ["$: type"], "{}": ["$: minProperties"], '{"a":null,"b":2}': [], '{"a":1.5}': ["$.a: anyOf"], '{"b":"xy"}': ["$.b: not", "$.b: maxLength"],
        '{"c":0,"d":5,"e":1}': ["$.c: exclusiveMinimum", "$.d: exclusiveMaximum", "$: maxProperties"], "[]": ["$: minItems"], "[1,2.5,3]": ["$: maxItems", "$[0]: minimum", "$[1]: type"],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "j string")
    got = {r.j: sorted(r.e) for r in rows.select("j", contract_errors("j", schema).alias("e")).collect()}
    assert got == {k: sorted(v) for k, v in cases.items()}
    with pytest.raises(ValueError):
        contract_errors("'{}'", {"oneOff": []})
    with pytest.raises(ValueError):
        contract_errors("'{}'", {"format": "email"})
