"""Operator 13: secrets in texts, and weak candidates that an interval join links with their complements."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import written

#: The kinds in the order that breaks ties. The first three are secrets by themselves; the others are weak.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
ASSIGN, ACCESS, HEX, ID, KEY, ENDPOINT = range(6)
#: What a part is in a credential.
IDENTIFIER, SECRET, PLACE = range(3)
ROLE = {ASSIGN: SECRET, ACCESS: IDENTIFIER, HEX: SECRET, ID: IDENTIFIER, KEY: SECRET, ENDPOINT: PLACE}
#: The other parts that must lie near a weak one.
NEEDS = {ID: (SECRET,), KEY: (IDENTIFIER,), ENDPOINT: (IDENTIFIER, SECRET)}
#: Near: at most so many code points between two parts of one scope. A scope ends at a blank line.
REACH = 300
SCOPE_END = r"\n[\x20\t\r]*\n"
LEAST_VALUE, LEAST_RUN = 6, 32


def either_case(words: str) -> str:
    """The pattern with each ASCII letter in either case."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


def named(words: str, value: str) -> str:
    """A word, a separator and a value in group 2."""
    return f"({either_case(words)})" + r"""["']?\x20*[:=]\x20*["']?""" + f"({value})"


VALUE = "[A-Za-z0-9+/_.=-]+"
#: By place in the order of precedence: (kind, pattern, first letters of its words).
PATTERNS = (
    (ASSIGN, named("password|passwd|secret|token|api_?key", VALUE), "psta"),
    (ACCESS, "AKIA[A-Z0-9]+", ""),
    (HEX, "[0-9a-f]+", ""),
    (ENDPOINT, r"(?:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp|jdbc:[a-z]+)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", ""),
    (ID, named("user_?name|user_?id|user|login|client_?id|account_?id|access_?key_?id", "[A-Za-z0-9+/_.=@-]+"), "ulca"),
    (KEY, named("pass|pwd|passphrase|auth|credentials?|secret_?access_?key|secret_?key|private_?key", VALUE), "pacs"),
    (KEY, "[A-Za-z0-9+/]+", ""),
)
#: The same matches by patterns that skip faster what cannot match: a run that must have some length has it in its pattern.
_FAST = {"AKIA[A-Z0-9]+": "AKIA[A-Z0-9]{16,}", "[0-9a-f]+": "[0-9a-f]{24,}", "[A-Za-z0-9+/]+": f"[A-Za-z0-9+/]{{{LEAST_RUN},}}"}
_COMPILED = [re.compile((f"(?=[{first}{first.upper()}])" if first else "") + _FAST.get(p, p)) for _, p, first in PATTERNS]
_SCOPE_END = re.compile(SCOPE_END)
_MIXED = [re.compile(c) for c in ("[a-z]", "[A-Z]", "[0-9]")]


def _found(place: int, text: str) -> list[tuple[int, int]]:
    """The spans of one pattern that are long enough, in order."""
    kind, hits = PATTERNS[place][0], _COMPILED[place].finditer(text)
    if _COMPILED[place].groups == 2:
        return [m.span() for m in hits if kind == ID or len(m[2]) >= LEAST_VALUE]
    if kind == KEY:
        return [m.span() for m in hits if all(c.search(m[0]) for c in _MIXED)]
    return [m.span() for m in hits]


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the sorted spans that overlap none of the sorted, taken ones. A taken span may hold others."""
    out, i, reach = [], 0, -1
    for a, b in spans:
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            out.append((a, b))
    return out


def parts_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the secrets of a text, and of the weak candidates if it has an identifier at all."""
    base = sorted((a, PATTERNS[p][0], b) for p in range(3) for a, b in _found(p, text))
    ids = _found(4, text)
    # Without an identifier nothing weak can be reported.
    if not ids and not any(kind == ACCESS for _, kind, _ in base):
        return base, []
    taken, weak = sorted((a, b) for a, _, b in base), []
    for place in range(3, len(PATTERNS)):
        spans = ids if place == 4 else _found(place, text)
        weak += [(a, PATTERNS[place][0], b) for a, b in _free(spans, taken)]
        taken = sorted([*taken, *spans])
    return base, sorted(weak)


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind."""
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    parts_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("scope", pa.int64())]))
    for batch in batches:
        rows, counts, digests, texts, parts = [], [[], [], []], [], [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            text = text or ""
            base, weak = parts_of(text)
            kinds = [kind for _, kind, _ in base]
            for k in range(3):
                counts[k].append(kinds.count(k))
            texts.append(joined(base))
            digests.append(hashlib.sha256(texts[-1].encode()).hexdigest())
            some, scope = [], 0
            if weak:
                ends = [m.start() for m in _SCOPE_END.finditer(text)]
                for a, kind, b in sorted([*base, *weak]):
                    while scope < len(ends) and ends[scope] < a:
                        scope += 1
                    some.append({"start": a, "kind": kind, "end": b, "scope": scope})
            parts.append(some)
            rows.append((part << 33) + number)
            number += 1
        doc = batch.column(batch.schema.get_field_index("doc_id"))
        numbers = [pa.array(c, pa.int64()) for c in counts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), doc, *numbers, pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(parts, parts_type)],
            ["row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "parts"],
        )


def _role(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair]), kind)


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts whose complements lie near: row, start, kind, end.

    parts has row, scope, start, kind and end; parts of one row do not overlap a weak one. This is an interval join by bins as wide as the reach: the ends and starts
    of a bin's parts are first reduced to their least and largest by role, so that a part asks at most two bins before it and two behind it for one row each,
    and no pairs are made however many parts lie together.
    """
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("end").alias("at")),
        F.struct(F.lit(1).alias("side"), F.col("start").alias("at")),
    )
    marks = parts.select("row", "scope", _role(F.col("kind")).alias("role"), F.explode(sides).alias("m"))
    marks = marks.groupBy("row", "scope", "role", F.col("m.side").alias("side"), F.floor(F.col("m.at") / reach).alias("bin")).agg(F.min("m.at").alias("least"), F.max("m.at").alias("most"))
    needs = F.element_at(F.create_map(*[x for k, roles in NEEDS.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in roles]))]), F.col("kind"))
    weak = parts.filter(F.col("kind") > HEX).withColumn("needs", needs)
    # Before it: ends from start - reach to start. Behind it: starts from end to end + reach.
    ask = lambda side, at, low, high, shift: F.struct(F.lit(side).alias("side"), (F.floor(F.col(at) / reach) + shift).alias("bin"), low.alias("low"), high.alias("high"))
    before, behind = (F.col("start") - reach, F.col("start")), (F.col("end"), F.col("end") + reach)
    asked = F.array(*[ask(0, "start", *before, s) for s in (-1, 0)], *[ask(1, "end", *behind, s) for s in (0, 1)])
    asks = weak.withColumns({"of": F.size("needs"), "asked": asked}).withColumn("role", F.explode("needs")).withColumn("q", F.explode("asked"))
    asks = asks.select("row", "scope", "start", "kind", "end", "of", "role", "q.*")
    met = asks.join(marks, ["row", "scope", "role", "side", "bin"]).filter("least <= high AND most >= low")
    keys = ["row", "start", "kind", "end", "of"]
    roles = met.select(*keys, "role").distinct().groupBy(*keys).agg(F.count("*").alias("roles"))
    return roles.filter("roles = of").select("row", "start", "kind", "end")


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of docs.

    docs has doc_id and text; other columns are ignored. Null texts are empty. Secrets are assigned values, access identifiers and long hex numbers; spans also has
    weak parts where a credential's other parts are near, in the same scope (no blank line between) and at most `reach` code points away: a name or identifier (id)
    near any secret, a further key or mixed run (key) near any identifier, an address (endpoint) near both. A weak match that overlaps a secret or a match of an earlier pattern
    is no candidate. Spans count code points, by start and then kind. Rows that repeat a doc_id, a null one too, are rows of their own; an empty table gives an empty result.

    Texts are read once; only documents with weak candidates take part in the join, by a number that the written scan gives each row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"row long, doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, parts array<struct<start: long, kind: int, end: long, scope: long>>"
    scanned = written(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scanned, ddl), "secrets")
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    some = scanned.filter("size(parts) > 0")
    parts = some.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    found = linked(parts, reach).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))
    base = F.transform(F.filter("parts", lambda p: p["kind"] <= HEX), lambda p: F.struct(p["start"], p["kind"], p["end"]))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda p: F.concat_ws(":", F.get(names, p["kind"]), p["start"].cast("string"), p["end"].cast("string"))
    every = F.array_sort(F.concat(base, F.coalesce("found", F.array().cast("array<struct<start: long, kind: int, end: long>>"))))
    more = some.join(found, "row", "left").withColumn("spans", F.array_join(F.transform(every, said), ","))
    return scanned.filter("size(parts) = 0").select(*columns).unionByName(more.select(*columns))
