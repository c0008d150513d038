import random

import pytest

from tablewright.functions.text import selector_tokens  # noqa: F401
from tablewright.operators import classify

SAMPLE, FAMILY = "sample_id long, selector string, fields array<string>", "pos int, family_id string, selector string, fields array<string>"


def tokens(text):
    import re

    return {t for t in re.split(r"[^a-z0-9_-]+", (text or "").lower()) if t}


def brute(samples, families):
    out = {}
    for i, s, f in samples:
        best = (0.0, 0, "UNKNOWN")
        for pos, name, fs, ff in families:
            jac = lambda a, b: len(a & b) / max(1, len(a | b))
            score = 0.6 * jac(tokens(s), tokens(fs)) + 0.4 * jac(set(f or []), set(ff or []))
            if score > 0 and (score, -pos) > best[:2]:
                best = (score, -pos, name)
        out[i] = (best[2], round(best[0], 3))
    return out


def make(n, k, seed):
    pick = random.Random(seed)
    words = [f"w{int(pick.paretovariate(0.7)) % 60}" for _ in range(400)]
    selector = lambda: " > ".join(pick.choice(["div", "ul", "li"]) + "." + pick.choice(words) for _ in range(pick.randint(1, 4)))
    fields = lambda: pick.sample(["title", "price", "sku", "img", "url", "desc"], pick.randint(0, 3))
    samples = [(i, selector(), fields()) for i in range(n)] + [(n, None, None), (n + 1, "zzz", []), (n + 2, "", ["nothing"])]
    return samples, [(i, f"f{i}", selector(), fields()) for i in range(k)]


@pytest.mark.parametrize("seed", [1, 2])
def test_families_equal_all_pairs(spark, seed):
    samples, families = make(150, 120, seed)
    got = {r.sample_id: (r.family_id, r.score) for r in classify.predict_family(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(families, FAMILY)).collect()}
    want = brute(samples, families)
    assert got.keys() == want.keys()
    assert all(abs(got[i][1] - want[i][1]) < 1e-6 for i in want)
    # Sums of shares may differ in their last bit; then either of two equal families is right.
    assert sum(got[i][0] == want[i][0] for i in want) >= len(want) - 1


def test_many_families(spark):
    n = 40_000
    families = spark.range(n).selectExpr("CAST(id AS INT) AS pos", "concat('f', id) AS family_id", "concat('div.a', id % 20000, ' span.b', id % 700) AS selector", "array('title', concat('x', id % 900)) AS fields")
    samples = spark.range(300).selectExpr("id AS sample_id", "concat('div.a', id * 7, ' span.b', (id * 7) % 700) AS selector", "array('title', concat('x', (id * 7) % 900)) AS fields")
    got = {r.sample_id: (r.family_id, r.score) for r in classify.predict_family(samples, families).collect()}
    assert got == {i: (f"f{7 * i}", 1.0) for i in range(300)}
    assert classify.predict_family(samples.limit(0), families).count() == 0
    assert {r.family_id for r in classify.predict_family(samples, families.limit(0)).collect()} == {"UNKNOWN"}
