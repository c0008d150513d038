import itertools
import random

from pyspark.sql import functions as F

from tablewright.operators import mining


def brute(rows, least, most):
    names, out = "abcd", {}
    base = sum(bool(r[4]) for r in rows) / len(rows)
    for k in range(1, most + 1):
        for some in itertools.combinations(range(4), k):
            mine = [r for r in rows if all(r[i] for i in some)]
            if len(mine) < least or not mine:
                continue
            p = sum(bool(r[4]) for r in mine) / len(mine)
            apart = 0.0
            for fold in {r[5] for r in mine}:
                own = [bool(r[4]) for r in mine if r[5] == fold]
                apart += len(own) * abs(sum(own) / len(own) - p)
            out[tuple(names[i] for i in some)] = (len(mine), round(p, 9), round(p / base, 9), round(1 - apart / len(mine), 9))
    return out


def test_rules_equal_counts(spark):
    pick = random.Random(5)
    coin = lambda p: pick.choice([True] * p + [False] * (9 - p) + [None])
    rows = [(coin(5), coin(3), coin(1), coin(7), coin(4), pick.choice([1, 2, 3, None])) for _ in range(600)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d boolean, t boolean, f int")
    for least, most in ((1, 4), (60, 3), (100_000, 2)):
        got = mining.candidate_rules(df, {n: F.col(n) for n in "abcd"}, F.col("t"), F.col("f"), least, most).collect()
        mine = {tuple(r.conditions): (r.support, round(r.precision, 9), round(r.lift, 9), round(r.stability_score, 9)) for r in got}
        assert mine == brute(rows, least, most) and len({r.rule_id for r in got}) == len(got)
    assert mining.candidate_rules(df.limit(0), {"a": F.col("a")}, F.col("t"), F.col("f"), 1).count() == 0
