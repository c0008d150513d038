"""Keyword matching of catalogue rows, and the bundles that matching hands on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablewright.functions.prices import price_numeric
from tablewright.functions.text import blank, pick_first, tokenize

EVIDENCE_CONFIDENCE, DROP_BELOW, PRICE_LOSS = 0.7, 0.15, 0.01


def query_tokens(keyword: Column, url: Column, document: Column, tags: Column) -> Column:
    """Tokens of keyword, url and document text, then the lower-cased tags as they are."""
    return F.concat(tokenize(keyword), tokenize(url), tokenize(document), F.transform(tags, F.lower))


def match_score(tokens: Column, name: Column, description: Column, params_json: Column, url: Column) -> Column:
    """0 to 100: exact hits, hits within the joined text, and hits in the name; 2 more for a row with a url."""
    joined = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(params_json, F.lit("{}")))
    own, in_name, n = tokenize(joined), tokenize(name), F.size(tokens)
    whole = F.array_join(own, " ")
    exact = F.size(F.filter(tokens, lambda t: F.array_contains(own, t)))
    part = F.size(F.filter(tokens, lambda t: ~F.array_contains(own, t) & F.contains(whole, t)))
    named = F.size(F.filter(tokens, lambda t: F.array_contains(in_name, t)))
    raw = (exact + part + 2 * exact + part + 3 * named) / (n * 6)
    score = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)) * 100 + F.when(F.coalesce(url, F.lit("")) != "", 2).otherwise(0)
    return F.when(n == 0, 0).otherwise(F.floor(F.least(score, F.lit(100.0)) + 0.5)).cast("int")


def ranked(items: DataFrame, tokens: Column, pos: str = "pos", within: list[str] | None = None, limit: int = 1000) -> DataFrame:
    """The best `limit` items with score and rank, by score falling, then input order; of each group if any are named.

    Without groups the best rows are taken by a distributed top-k before they are numbered.
    """
    scored = items.withColumn("score", match_score(tokens, F.col("name"), F.col("description"), F.col("params_json"), F.col("url")))
    order = [F.desc("score"), F.col(pos)]
    some = scored if within else scored.orderBy(*order).limit(limit)
    return some.withColumn("rank", F.row_number().over(W.partitionBy(*(within or [])).orderBy(*order))).filter(F.col("rank") <= limit)


def bundle_items(items: DataFrame) -> DataFrame:
    """items with item_id, sku, price and currency as a bundle holds them.

    item_id: id, url, name or position; sku: its own or of params; price: its own or of params, in EUR.
    """
    param = lambda *names: F.coalesce(*[blank(F.get_json_object("params_json", f"$.{n}")) for n in names])
    price = F.coalesce(blank(F.col("price").cast("string")), param("price", "unitPrice"))
    return items.withColumns(
        {
            "item_id": pick_first(F.col("id").cast("string"), F.col("url"), F.col("name"), F.col("pos").cast("string")),
            "sku": F.coalesce(blank(F.trim("sku")), param("sku", "SKU")),
            "price": price,
            "currency": F.when(price.isNotNull(), "EUR"),
        }
    )


def candidates(explicit: Column, evidence: Column, normalized: Column) -> Column:
    """Values of a field by falling confidence: given ones, then evidence, then the normalized value; weak ones go.

    explicit and evidence: arrays of struct<value string, confidence double, source string>. A normalized
    value that is empty or 0 is none.
    """
    own = F.struct(normalized.alias("value"), F.lit(EVIDENCE_CONFIDENCE).alias("confidence"), F.lit("normalized").alias("source"))
    kind = "array<struct<value:string,confidence:double,source:string>>"
    given = normalized.isNotNull() & ~normalized.isin("", "0", "0.0")
    everything = F.concat(
        F.coalesce(explicit, F.array().cast(kind)), F.coalesce(evidence, F.array().cast(kind)), F.when(given, F.array(own)).otherwise(F.array().cast(kind))
    )
    placed = F.transform(
        F.filter(everything, lambda x: x["confidence"] >= DROP_BELOW),
        lambda x, i: F.struct((-x["confidence"]).alias("order"), i.alias("i"), x.alias("c")),
    )
    return F.transform(F.array_sort(placed), lambda x: x["c"])


def decision(found: Column) -> Column:
    """pass_through, canonicalize or conflict_resolve by the best two candidates."""
    apart = F.get(found, F.lit(0))["value"] != F.get(found, F.lit(1))["value"]
    return (
        F.when(F.size(found) == 0, "pass_through").when(F.size(found) == 1, "canonicalize").when(apart, "conflict_resolve").otherwise("canonicalize")
    )


def compress(items: DataFrame) -> DataFrame:
    """Items with canonical price and sku, and changes array<struct<field, decision, loss>>.

    items: price, sku, price_explicit, price_evidence, sku_explicit, sku_evidence as in candidates. Every item
    has a change of its price; of its sku only where there is one.
    """
    amount = price_numeric(F.col("price"))
    price_found = candidates(F.col("price_explicit"), F.col("price_evidence"), F.col("price"))
    sku_found = candidates(F.col("sku_explicit"), F.col("sku_evidence"), F.col("sku"))
    change = lambda field, d, loss: F.struct(F.lit(field).alias("field"), d.alias("decision"), F.lit(loss).alias("loss"))
    has_sku = (F.size(sku_found) > 0) | (F.coalesce(F.trim("sku"), F.lit("")) != "")
    changes = F.array_compact(
        F.array(change("price.amount", decision(price_found), PRICE_LOSS), F.when(has_sku, change("sku", decision(sku_found), 0.0)))
    )
    return items.withColumns({"amount": amount, "sku": F.trim("sku"), "changes": changes})


def loss_totals(items: DataFrame) -> DataFrame:
    """Items with loss_sum, loss_count and avg_field_loss (6 decimals) of their changes."""
    total = F.aggregate("changes", F.lit(0.0), lambda a, x: a + x["loss"])
    return items.withColumns(
        {"loss_sum": total, "loss_count": F.size("changes"), "avg_field_loss": F.when(F.size("changes") == 0, 0.0).otherwise(F.round(total / F.size("changes"), 6))}
    )


def manifest_summary(items: DataFrame, request: str = "request_id") -> DataFrame:
    """By request: items, counts of decisions, and the average loss over fields (not items)."""
    flat = items.select(request, "item_id", F.explode_outer("changes").alias("x"))
    counted = lambda d: F.count_if(F.col("x.decision") == d)
    return flat.groupBy(request).agg(
        F.count_distinct("item_id").alias("items_in"),
        counted("canonicalize").alias("fields_canonicalized"),
        counted("conflict_resolve").alias("conflicts_resolved"),
        counted("drop_low_confidence").alias("fields_dropped"),
        F.round(F.coalesce(F.avg("x.loss"), F.lit(0.0)), 6).alias("avg_loss_score"),
    )


def schema_errors(items: DataFrame) -> DataFrame:
    """Items with errors array<string>: what a bundle's contract does not allow."""
    check = lambda bad, what: F.when(F.coalesce(bad, F.lit(True)), what)
    return items.withColumn(
        "errors",
        F.array_compact(
            F.array(
                check(F.coalesce("item_id", F.lit("")) == "", "item_id: required"),
                check(~F.coalesce("url", F.lit("")).rlike(r"^https?://"), "url: pattern"),
                F.when(F.col("currency").isNotNull() & ~F.col("currency").rlike("^[A-Z]{3}$"), "currency: pattern"),
                F.when(F.col("amount") < 0, "amount: minimum"),
                F.when(F.exists("changes", lambda x: ~x["decision"].isin("pass_through", "canonicalize", "conflict_resolve", "drop_low_confidence")), "decision: enum"),
                F.when(F.exists("changes", lambda x: ~x["loss"].between(0, 1)), "loss: range"),
            )
        ),
    )


def by_position(df: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """key, pos, and the entries of two arrays that stand at the same place."""
    zipped = df.select(key, F.posexplode(F.arrays_zip(one, two)).alias("pos", "z"))
    return zipped.select(key, "pos", F.col("z")[one].alias(one), F.col("z")[two].alias(two))


def evidence_of(evidence: Column, field: str, value: str) -> Column:
    """The value of the first entry of an array that names the field; null if none does."""
    return F.get(F.filter(evidence, lambda e: e["field"] == field), F.lit(0))[value]


def require(what: str, **values: object) -> None:
    """Raise ValueError for the first value that is missing."""
    for name, value in values.items():
        if value is None or value == "":
            raise ValueError(f"{what}: {name} required")


def compression_manifest(items: DataFrame | None, request_id: str, schema_version: str, engine_version: str) -> DataFrame:
    """The summary of one request's compressed items with the versions that made it; all four must be given."""
    require("manifest", request_id=request_id, schema_version=schema_version, engine_version=engine_version)
    if items is None:
        raise ValueError("manifest: items required")
    own = manifest_summary(items.withColumn("request_id", F.lit(request_id)))
    return own.withColumns({"schema_version": F.lit(schema_version), "engine_version": F.lit(engine_version)})
