import collections

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import simhash


def brute(rows):
    """doc_id -> (fingerprint, component) by comparing all pairs."""

    def fp(text):
        words, cur = [], ""
        for ch in text or "":
            if ch in " \t\n\x0b\x0c\r":
                if cur:
                    words.append(cur)
                cur = ""
            else:
                cur += ch.lower() if "A" <= ch <= "Z" else ch
        if cur:
            words.append(cur)
        if not words:
            return 0
        sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 2 and comp[j] > comp[i]:
                    comp[j] = comp[i]
                    changed = True
    return collections.Counter((d, f"{f:016x}", rows[c][0]) for (d, _), f, c in zip(rows, fps, comp))


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}É" for i in range(50)] + ["IT", "It", "it"])
    rows = []
    for i in range(60):
        base = list(rng.choice(words, rng.integers(0, 120)))
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.integers(0, 3)):
            near = list(base)
            if near:
                near[rng.integers(len(near))] = "changed"
            rows.append((len(rows), " \n".join(near)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "  x"), (len(rows) + 3, "one"), (len(rows) + 4, "ONE")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(5)
    got = collections.Counter(tuple(r) for r in simhash.simhash_groups(df).collect())
    assert got == brute(rows)


def test_tiles_give_the_same_groups(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (300, 2))}
    fps = sorted(fps)
    import pandas as pd

    masks = np.array([simhash._mask(*simhash.SEGMENTS[(i + 1) % 3]) for i in range(3)], dtype=np.int64).view(np.uint64)
    rows = pd.DataFrame({"slot": 0, "bits": 0, "t": 0, "u": 0, "fp": np.array(fps, dtype=np.int64)})
    edges = simhash._compare(rows, masks)
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in zip(edges.a, edges.b):
        label[find(a)] = find(b)
    want = {}
    for i, f in enumerate(fps):
        want.setdefault(f, f)
    nxt = masks[0]
    close = [(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2 and bin((a ^ b) & int(nxt)).count("1") <= 1]
    for a, b in close:
        assert find(a) == find(b)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z y x w v")], "doc_id long, text string")
    got = sorted(simhash.simhash_groups(twice).select("doc_id", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == [(1, 1), (1, 1), (None, 1), (None, None)]
