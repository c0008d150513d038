"""JSON texts: canonical form, redaction, paths, translation hook. These run in Arrow batches where Spark has no expression."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys whose values are not to be logged, and limits of logged texts.
SECRET_KEYS = ("password", "passwort", "token", "secret", "authorization", "cookie", "apikey", "api_key")
MAX_DEPTH, MAX_ITEMS, MAX_TEXT = 6, 50, 500


def number_text(x: float) -> str:
    """A number as JSON of the web writes it: the shortest digits of its double, an exponent from 1e21 and below 1e-6."""
    if isinstance(x, bool):
        return "true" if x else "false"
    try:
        x = float(x)
    except OverflowError:
        return "null"
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent
    if 0 < point <= 21:
        body = text + "0" * (point - len(text)) if len(text) <= point else f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + text
    else:
        body = text[0] + (f".{text[1:]}" if len(text) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + body


def canonical(x: object) -> str:
    """JSON text with keys sorted by their UTF-16 units and no spaces."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(x[k])}" for k in sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(canonical, x)) + "]"
    if isinstance(x, (int, float)):
        return number_text(x)
    return json.dumps(x, ensure_ascii=False)


def redacted(x: object, depth: int = 0) -> object:
    """A value with secret keys masked, and depth, list lengths and texts cut."""
    if depth > MAX_DEPTH:
        return "[depth]"
    if isinstance(x, dict):
        return {k: "[redacted]" if k.lower() in SECRET_KEYS else redacted(v, depth + 1) for k, v in x.items()}
    if isinstance(x, list):
        return [redacted(v, depth + 1) for v in x[:MAX_ITEMS]] + ([f"[{len(x) - MAX_ITEMS} more]"] if len(x) > MAX_ITEMS else [])
    if isinstance(x, str) and len(x) > MAX_TEXT:
        return x[:MAX_TEXT] + "..."
    return x


def _mapped(c: Column, fn: Callable[[object], object]) -> Column:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(s: str | None) -> str | None:
            try:
                return None if s is None else canonical(fn(json.loads(s)))
            except ValueError:
                return None

        return pd.Series([one(s) for s in texts], dtype=object)

    return run(c)


def canonical_json(c: Column) -> Column:
    """Canonical form of a JSON text; null for what is none."""
    return _mapped(c, lambda x: x)


def redact_json(c: Column) -> Column:
    """Canonical form of a redacted JSON text."""
    return _mapped(c, redacted)


def bundle_hash(c: Column) -> Column:
    """'sha256:' and the digest of the canonical form."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(c), 256))


def path_value(c: Column, path: str) -> Column:
    """Value at $.a.b as text; null for a path through arrays, and for what is missing."""
    return F.lit(None).cast("string") if "[" in path else F.get_json_object(c, path)


def translated(c: Column, translate: Callable[[list[str]], list[str]] | None = None) -> Column:
    """c through a batch translator; as it is without one, or where that fails."""
    if translate is None:
        return c

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(translate(texts.fillna("").tolist()), dtype=object)
        except Exception:
            return texts

    return run(c)
