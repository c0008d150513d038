"""Candidate rules: frequent sets of conditions, scored by what they say of a target and how steadily over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.session import written


def _subsets(items: Column, size: int) -> Column:
    """All subsets of an ordered array with so many entries, each in order."""
    if size == 1:
        return F.transform(items, lambda x: F.array(x))
    rest = lambda i: F.slice(items, i + 2, F.size(items))
    return F.flatten(F.transform(items, lambda x, i: F.transform(_subsets(rest(i), size - 1), lambda s: F.concat(F.array(x), s))))


def candidate_rules(records: DataFrame, conditions: dict[str, Column], target: Column, fold: Column, least: int, most_conditions: int = 3) -> DataFrame:
    """rule_id, conditions, support, precision, lift, stability_score, status: every set of up to most_conditions conditions that `least` records or more meet.

    precision is the share of them that meet the target, lift that by the share of all records, and stability_score 1 less the mean distance of the folds' precision from it,
    weighted by their records. A condition or target that is null does not hold; records with a null fold are a fold of their own. status is proposed. Without records there are no rules.

    Records are first counted by the set of conditions they meet, so that subsets are made of distinct sets and not of records; a level only
    extends with conditions that are frequent by themselves, and a set goes on only if all its parts one smaller are frequent.
    """
    names = sorted(conditions)
    met = F.array_compact(F.array(*[F.when(F.coalesce(conditions[n], F.lit(False)), F.lit(n)) for n in names]))
    rows = records.select(met.alias("items"), F.coalesce(target, F.lit(False)).cast("long").alias("hit"), fold.cast("string").alias("fold"))
    sets = written(rows.groupBy("items", "fold").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")), "condition-sets")
    base = sets.agg((F.sum("hits") / F.sum("n")).alias("base"))
    found, frequent = None, None
    for size in range(1, min(most_conditions, len(names)) + 1):
        subsets = _subsets(F.col("items"), size)
        if frequent is not None:
            # At most as many as sets of conditions have so many members; conditions are a stated, small list.
            known = F.array(*[F.array(*map(F.lit, f)) for f in frequent]) if frequent else F.array().cast("array<array<string>>")
            subsets = F.filter(subsets, lambda s: F.forall(_subsets(s, size - 1), lambda p: F.array_contains(known, p)))
        level = sets.select(F.explode(subsets).alias("conditions"), "fold", "n", "hits").groupBy("conditions", "fold").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
        total = level.groupBy("conditions").agg(
            F.sum("n").alias("support"), F.sum("hits").alias("all_hits"), F.collect_list(F.struct("n", "hits")).alias("folds")
        ).filter(F.col("support") >= least)
        total = written(total, f"rules-{size}")
        frequent = [r["conditions"] for r in total.select("conditions").collect()]
        found = total if found is None else found.unionByName(total)
        if not frequent:
            break
    precision = F.col("all_hits") / F.col("support")
    apart = F.aggregate("folds", F.lit(0.0), lambda a, f: a + f["n"] * F.abs(f["hits"] / f["n"] - precision)) / F.col("support")
    # One row.
    return found.join(F.broadcast(base), how="cross").select(
        F.concat(F.lit("rule_"), F.substring(F.sha2(F.array_join("conditions", "&"), 256), 1, 12)).alias("rule_id"), "conditions", "support", precision.alias("precision"),
        F.when(F.col("base") > 0, precision / F.col("base")).otherwise(0.0).alias("lift"), (1 - apart).alias("stability_score"), F.lit("proposed").alias("status"),
    )
