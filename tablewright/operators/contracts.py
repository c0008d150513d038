"""JSON Schema compiled to Columns over variants, and the manifest's contract."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT = {"type": "string", "minLength": 1}
ANY_TEXT = {"type": "string"}
SHARE = {"type": "number", "minimum": 0, "maximum": 1}
COUNT = {"type": "integer", "minimum": 0}
TIME = {"type": "string", "format": "date-time"}
HASH = {"type": "string", "pattern": "^sha256:[0-9a-f]{64}$"}


def closed(optional: dict | None = None, **required: dict) -> dict:
    """An object with these properties and no others."""
    return {"type": "object", "additionalProperties": False, "required": list(required), "properties": {**required, **(optional or {})}}


def listed(items: dict) -> dict:
    """An array of such items."""
    return {"type": "array", "items": items}


# The contract of a compression manifest.
MANIFEST = closed(
    {"ops": listed(closed({"ruleId": ANY_TEXT, "notes": ANY_TEXT}, op=TEXT, at=TIME, stats={"type": "object"}))},
    manifestVersion={"type": "string", "pattern": r"^1\.0$"}, requestId=TEXT, schemaVersion=TEXT, engineVersion=TEXT, createdAt=TIME,
    hashes=closed(inputBundleHash=HASH, compressedBundleHash=HASH),
    summary=closed(itemsIn=COUNT, itemsOut=COUNT, fieldsCanonicalized=COUNT, conflictsResolved=COUNT, fieldsDroppedLowConfidence=COUNT, avgLossScore=SHARE),
    items=listed(closed(
        itemId=TEXT,
        fieldChanges=listed(closed(
            field=TEXT, decision={"type": "string", "enum": ["canonicalize", "dedupe", "conflict_resolve", "drop_low_confidence", "pass_through"]},
            beforeCandidates=listed(closed(value={}, confidence=SHARE, source=TEXT, evidenceId=TEXT)), afterCanonical=closed(value={}, confidence=SHARE, source=TEXT),
            loss=closed({"notes": ANY_TEXT}, score=SHARE, type=TEXT), rationale=TEXT,
        )),
        evidenceAnchors=listed(closed(
            evidenceId=TEXT, source=TEXT, origin=closed(url=TEXT, fetchedAt=TIME), locator=closed({k: ANY_TEXT for k in ("key", "xpath", "css", "jsonPath", "regexId")}, type=TEXT),
            snippetHash=HASH, confidenceContribution=SHARE,
        )),
        lossTotals=closed(fieldLossScoreSum={"type": "number", "minimum": 0}, fieldCount=COUNT, avgFieldLoss=SHARE),
    )),
)

#: Keywords that say nothing about a document.
SILENT = {"$schema", "$id", "title", "description", "default", "examples", "$comment"}
BOUNDS = {"minimum": "<", "maximum": ">", "exclusiveMinimum": "<=", "exclusiveMaximum": ">="}
MEMBERS = ("properties", "required", "additionalProperties", "minProperties", "maxProperties")
ENTRIES = ("items", "minItems", "maxItems")
NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")
END = "tablewright: end of document"
DATE_TIME = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt]([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)(\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"


#: No errors.
NONE = "cast(array() AS array<string>)"


def _text(value: object) -> str:
    """A string literal of SQL."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _joined(checks: list[str]) -> str:
    return f"concat({', '.join(checks)})" if len(checks) > 1 else checks[0] if checks else NONE


def _when(bad: str, path: str, word: str) -> str:
    return f"if(coalesce({bad}, true), array(concat({path}, {_text(': ' + word)})), {NONE})"


def _pattern(text: str) -> str:
    """The pattern with its $ at the end of the text only, not before a last line break."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\$$", r"\1\\z", text)


def _is(v: str, name: str) -> str:
    kind, size = f"schema_of_variant({v})", f"try_variant_get({v}, '$', 'double')"
    number = f"({kind} IN ({', '.join(map(_text, NUMBERS))}) OR startswith({kind}, 'DECIMAL'))"
    return {
        "object": f"startswith({kind}, 'OBJECT<')", "array": f"startswith({kind}, 'ARRAY<')", "string": f"{kind} = 'STRING'", "boolean": f"{kind} = 'BOOLEAN'", "null": f"{kind} = 'VOID'",
        "number": number, "integer": f"({number} AND {size} = floor({size}))",
    }[name]


class _Compiler:
    """Schemas to SQL. One text is parsed at once; built call by call, a contract of this size would take the driver many seconds."""

    def __init__(self) -> None:
        self.names = count()

    def bound(self, value: str, use: Callable[[str], str]) -> str:
        """use(name) where name stands for value, which is worked out once."""
        name = f"v{next(self.names)}"
        return f"get(transform(array({value}), {name} -> {use(name)}), 0)"

    def each(self, values: str, use: Callable[[str, str], str]) -> str:
        """The errors of all values of an array; use gets an entry's name and its place's."""
        x, i = f"v{next(self.names)}", f"i{next(self.names)}"
        return f"flatten(transform({values}, ({x}, {i}) -> {use(x, i)}))"

    def check(self, v: str, schema: dict | bool, path: str) -> str:
        """The errors of a value that is there (null is a value)."""
        if schema is True or schema == {}:
            return NONE
        if schema is False:
            return f"array(concat({path}, ': not allowed'))"
        out: list[str] = []
        text, number = f"try_variant_get({v}, '$', 'string')", f"try_variant_get({v}, '$', 'double')"
        for word, want in schema.items():
            if word in SILENT or word in MEMBERS or word in ENTRIES:
                continue
            if word == "type":
                fits = " OR ".join(_is(v, name) for name in (want if isinstance(want, list) else [want]))
                out.append(_when(f"NOT ({fits})", path, "type"))
            elif word in ("enum", "const"):
                known = [_text(json.dumps(x, separators=(",", ":"), ensure_ascii=False)) for x in (want if word == "enum" else [want])]
                out.append(_when(f"coalesce(to_json({v}), 'null') NOT IN ({', '.join(known)})", path, word))
            elif word in ("pattern", "format", "minLength", "maxLength"):
                if word == "pattern":
                    bad = f"NOT rlike({text}, {_text(_pattern(want))})"
                elif word == "format":
                    if want != "date-time":
                        raise ValueError(f"unknown format {want!r}")
                    bad = f"(NOT rlike({text}, {_text(DATE_TIME)}) OR try_cast(substring({text}, 1, 10) AS date) IS NULL)"
                else:
                    bad = f"length({text}) {'<' if word == 'minLength' else '>'} {int(want)}"
                out.append(_when(f"{_is(v, 'string')} AND {bad}", path, word))
            elif word in BOUNDS:
                out.append(_when(f"{_is(v, 'number')} AND {number} {BOUNDS[word]} {float(want)!r}D", path, word))
            elif word == "allOf":
                out += [self.check(v, s, path) for s in want]
            elif word == "anyOf":
                fits = " OR ".join(f"size({self.check(v, s, path)}) = 0" for s in want)
                out.append(_when(f"NOT ({fits})", path, word))
            elif word == "not":
                out.append(_when(f"size({self.check(v, want, path)}) = 0", path, word))
            else:
                raise ValueError(f"unknown keyword {word!r}")
        if any(k in schema for k in MEMBERS):
            asked = f"if({_is(v, 'object')}, try_variant_get({v}, '$', 'map<string,variant>'), NULL)"
            out.append(self.bound(asked, lambda m: f"if({m} IS NULL, {NONE}, {self.members(m, schema, path)})"))
        if any(k in schema for k in ENTRIES):
            asked = f"if({_is(v, 'array')}, try_variant_get({v}, '$', 'array<variant>'), NULL)"
            out.append(self.bound(asked, lambda a: f"if({a} IS NULL, {NONE}, {self.entries(a, schema, path)})"))
        return _joined(out)

    def members(self, m: str, schema: dict, path: str) -> str:
        """The errors of an object's map of members."""
        under = lambda name: f"concat({path}, {_text('.' + name)})"
        known, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        out = [_when(f"NOT map_contains_key({m}, {_text(name)})", under(name), "required") for name in schema.get("required", [])]
        others = f"array_sort(array_except(map_keys({m}), cast(array({', '.join(map(_text, known))}) AS array<string>)))"
        if rest is False:
            out.append(self.each(others, lambda k, _: f"array(concat({path}, '.', {k}, ': additionalProperties'))"))
        elif rest is not True and rest != {}:
            out.append(self.each(others, lambda k, _: self.bound(f"{m}[{k}]", lambda x: self.check(x, rest, f"concat({path}, '.', {k})"))))
        for word, sign in (("minProperties", "<"), ("maxProperties", ">")):
            if word in schema:
                out.append(_when(f"size({m}) {sign} {int(schema[word])}", path, word))
        for name, s in known.items():
            if s not in ({}, True):
                inner = self.bound(f"{m}[{_text(name)}]", lambda x, s=s, name=name: self.check(x, s, under(name)))
                out.append(f"if(map_contains_key({m}, {_text(name)}), {inner}, {NONE})")
        return _joined(out)

    def entries(self, a: str, schema: dict, path: str) -> str:
        """The errors of an array's entries and of their number."""
        out = [_when(f"size({a}) {sign} {int(schema[word])}", path, word) for word, sign in (("minItems", "<"), ("maxItems", ">")) if word in schema]
        if "items" in schema:
            out.append(self.each(a, lambda x, i: self.check(x, schema["items"], f"concat({path}, '[', {i}, ']')")))
        return _joined(out)


def contract_errors(document: str, schema: dict) -> Column:
    """array<string>: `path: keyword` for everything in a JSON document that a schema does not allow; empty if it is valid.

    document: a column's name or a SQL expression. Keywords: type, enum, const, pattern, format date-time, minLength, maxLength, minimum, maximum and their exclusive
    forms, properties, required, additionalProperties, minProperties, maxProperties, items (one schema), minItems, maxItems, allOf, anyOf, not; any other is a ValueError when
    compiled. Null text and text that is no JSON have the error `$: json`. Paths are `$.a[0].b`. Everything runs on the JVM.
    """
    compiler = _Compiler()
    # The parser does not look behind the first value; here that is a list, which must end as it should.
    text = f"concat('[', coalesce({document}, ''), {_text(',"' + END + '"]')})"
    whole = lambda p: f"if(size({p}) = 2 AND try_variant_get(get({p}, 1), '$', 'string') = {_text(END)}, get({p}, 0), NULL)"
    checked = lambda v: f"if({v} IS NULL, array('$: json'), {compiler.check(v, schema, _text('$'))})"
    return F.expr(compiler.bound(f"try_variant_get(try_parse_json({text}), '$', 'array<variant>')", lambda p: compiler.bound(whole(p), checked)))
