"""Selectors with structure: lists of compounds joined by combinators, and positions in what they find."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"[\w\u0080-\U0010ffff-]+"
_SIMPLE = re.compile(
    rf"""(?P<tag>{_NAME}|\*)|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})
    |\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[*^$~|!]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]*))\s*(?P<fold>[iI])?\s*)?\]
    |:(?P<pseudo>[a-z-]+)""",
    re.X,
)
_POSITIONS = ("first", "last", "eq")


@dataclass(frozen=True)
class Chain:
    """Compounds from the outermost to the one that is found; `joins[i]` stands before compounds[i + 1]."""

    compounds: tuple[tuple, ...]
    joins: tuple[str, ...]
    #: (name, n) of a position in what the whole chain finds on a page.
    pick: tuple[str, int] | None = None


def _argument(text: str, at: int) -> tuple[str, int]:
    """The text in the brackets that open at `at`, without its quotes, and the place behind them."""
    if at >= len(text) or text[at] != "(":
        raise ValueError(f"no argument in selector {text!r}")
    depth, quote, i = 0, "", at
    while i < len(text):
        ch = text[i]
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "()":
            depth += 1 if ch == "(" else -1
            if not depth:
                inside = text[at + 1 : i].strip()
                return (inside[1:-1] if inside[:1] in ("'", '"') and inside[:1] == inside[-1:] and len(inside) > 1 else inside), i + 1
        i += 1
    raise ValueError(f"open bracket in selector {text!r}")


def _chain(text: str, at: int) -> tuple[Chain, int]:
    compounds, joins, pick, now, join = [], [], None, [], None
    while at < len(text) and text[at] != ",":
        gap = re.compile(r"\s*([>+~])\s*|\s+").match(text, at)
        if gap:
            at = gap.end()
            if at < len(text) and text[at] != ",":
                if now:
                    compounds.append(tuple(now))
                    join, now = gap[1] or " ", []
                elif gap[1]:
                    raise ValueError(f"combinator without a left side in selector {text!r}")
            elif gap[1]:
                raise ValueError(f"combinator without a right side in selector {text!r}")
            continue
        m = _SIMPLE.match(text, at)
        if not m or pick:
            raise ValueError(f"cannot read selector {text!r} at {at}")
        at = m.end()
        if not now and compounds:
            joins.append(join)
        if m["tag"]:
            now.append(("tag", m["tag"].lower()))
        elif m["cls"]:
            now.append(("class", m["cls"]))
        elif m["id"]:
            now.append(("id", m["id"]))
        elif m["attr"]:
            value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), "")
            now.append(("attr", m["attr"].lower(), m["op"] or "", value, bool(m["fold"])))
        elif m["pseudo"] in ("contains", "not", "eq"):
            inside, at = _argument(text, at)
            if m["pseudo"] == "eq":
                pick = ("eq", int(inside))
            else:
                now.append((m["pseudo"], inside))
        elif m["pseudo"] in _POSITIONS:
            pick = (m["pseudo"], 0)
        elif m["pseudo"] == "first-child":
            now.append(("first-child",))
        else:
            raise ValueError(f"unknown :{m['pseudo']} in selector {text!r}")
        if not now and pick:
            now.append(("tag", "*"))
    if not now:
        raise ValueError(f"empty part in selector {text!r}")
    return Chain((*compounds, tuple(now)), tuple(joins), pick), at


def parse(selector: str) -> list[Chain]:
    """The chains of a selector list.

    Compounds: tag, *, .class, #id, [a], [a=v] and ^= $= *= ~= |= != (values quoted or not, `i` folds case), :not(list of compounds),
    :contains(text), :first-child. Combinators: blank, >, +, ~. :first, :last and :eq(n) end a chain and pick from what it finds on a page.
    Anything else is a ValueError.
    """
    out, at = [], 0
    while True:
        at += len(selector[at:]) - len(selector[at:].lstrip())
        chain, at = _chain(selector, at)
        out.append(chain)
        if at >= len(selector):
            return out
        at += 1


def _attribute(name: str, op: str, value: str, fold: bool) -> Column:
    at = F.col("attrs")[name]
    at, value = (F.lower(at), value.lower()) if fold else (at, value)
    if op == "!=":
        return at.isNull() | (at != value)
    if value == "" and op in ("*=", "^=", "$="):
        return F.lit(False)
    test = {
        "": lambda: at.isNotNull(), "=": lambda: at == value, "*=": lambda: F.contains(at, F.lit(value)), "^=": lambda: at.startswith(value), "$=": lambda: at.endswith(value),
        "~=": lambda: F.array_contains(F.split(at, r"\s+"), value), "|=": lambda: (at == value) | at.startswith(value + "-"),
    }
    return test[op]()


def classes() -> Column:
    """The class words of a node row."""
    return F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+")


def condition(compound: tuple, words: Column | None = None) -> Column:
    """A compound as a condition on a node row, never null. words: the column that has its classes already."""
    ok, words = F.lit(True), classes() if words is None else words
    for kind, *rest in compound:
        if kind == "tag":
            ok = ok if rest[0] == "*" else ok & (F.col("tag") == rest[0])
        elif kind == "class":
            ok = ok & F.array_contains(words, rest[0])
        elif kind == "id":
            ok = ok & (F.col("attrs")["id"] == rest[0])
        elif kind == "attr":
            ok = ok & _attribute(*rest)
        elif kind == "contains":
            ok = ok & F.contains(F.coalesce("text", F.lit("")), F.lit(rest[0]))
        elif kind == "first-child":
            ok = ok & (F.col("node") == F.col("parent") + 1)
        else:
            ok = ok & ~selects(rest[0], words)
    return F.coalesce(ok, F.lit(False))


def selects(selector: str, words: Column | None = None) -> Column:
    """A list of compounds as a condition on a node row; structure and positions are a ValueError."""
    out = F.lit(False)
    for chain in parse(selector):
        if chain.joins or chain.pick:
            raise ValueError(f"{selector!r} has structure; it takes operators.twig")
        out = out | condition(chain.compounds[0], words)
    return out
