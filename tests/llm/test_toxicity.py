import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import toxicity as t

DATA = "/root/testdata/sf0.01"


def test_index_equals_brute_force():
    rng = np.random.default_rng(1)
    size, vectors = 40, []
    for _ in range(500):
        at = np.sort(rng.choice(size, rng.integers(1, 6), replace=False))
        w = rng.random(len(at)) + 0.1
        vectors.append((at, w / np.sqrt((w**2).sum())))
    sizes = np.array([len(a) for a, _ in vectors])
    index = t.BlockMaxIndex(rng.integers(0, 2, 500), sizes, *(np.concatenate(x) for x in zip(*vectors, strict=True)), size)
    dense = np.zeros((500, size))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for i in range(100):
        rows, cosines = index.nearest(*vectors[i], 16)
        rows = index.example[rows]
        all_cosines = np.round(dense @ dense[i], 12)
        order = [j for j in np.lexsort((np.arange(500), -all_cosines))[:16] if all_cosines[j] > 0]
        assert np.allclose(cosines, all_cosines[order], atol=1e-9)
        assert sorted(np.round(all_cosines[rows], 9)) == sorted(np.round(all_cosines[order], 9))
        left_out, _ = index.nearest(*vectors[i], 16, int(index.place[i]))
        assert i not in index.example[left_out] and len(left_out) == 16


def test_frequent_terms_cost_no_postings(monkeypatch):
    # Fifty words in all of 2,000 examples, and three of 3,000 rare ones in each.
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(2000):
        at = np.append(np.arange(50), np.sort(rng.choice(np.arange(50, 3050), 3, replace=False)))
        w = rng.random(53) + 0.1
        vectors.append((at, w / np.sqrt((w**2).sum())))
    index = t.BlockMaxIndex(rng.integers(0, 2, 2000), np.full(2000, 53), *(np.concatenate(x) for x in zip(*vectors, strict=True)), 3050)
    read, ranges = [], t._ranges
    monkeypatch.setattr(t, "_ranges", lambda start, size: read.append(int(size.sum())) or ranges(start, size))
    dense = np.zeros((2000, 3050))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for i in range(40):
        places, cosines = index.nearest(*vectors[i], 16)
        want = np.sort(np.round(dense @ dense[i], 12))[::-1][:16]
        assert np.allclose(cosines, want, atol=1e-11) and np.allclose(dense[index.example[places]] @ dense[i], want, atol=1e-11)
    # The postings of the fifty would be 100,000 a search.
    assert sum(read) < 40 * 200


def test_search_does_not_depend_on_other_queries(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(700):
        at = np.sort(rng.choice(2000, rng.integers(0, 300), replace=False))
        at = np.unique(np.append(at, rng.integers(0, 40, 10))) if len(at) else at
        w = rng.random(len(at)) + 0.1
        vectors.append((at, w / np.sqrt((w**2).sum())))
    index = t.BlockMaxIndex(rng.integers(0, 2, 700), np.array([len(a) for a, _ in vectors]), *(np.concatenate(x) for x in zip(*vectors, strict=True)), 2000)
    assert 0 < index.columns.shape[1] < 2000
    alone = [index.nearest(*v, 16) for v in vectors]
    for batch, work in ((64, 500_000), (7, 500_000), (64, 3_000)):
        monkeypatch.setattr(t, "BATCH", batch)
        monkeypatch.setattr(t, "WORK", work)
        for (p, c), (q, d) in zip(alone, index.nearest_of(iter(vectors), 16), strict=True):
            assert np.array_equal(p, q) and np.array_equal(c, d)
    left_out = list(index.nearest_of(iter(vectors), 16, index.place))
    assert all(i not in index.example[p] and (len(p) == 16 or not len(v[0])) for i, ((p, _), v) in enumerate(zip(left_out, vectors, strict=True)))


def test_words_are_those_of_the_pattern():
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x3100)] + [f"x{chr(c)}y" for c in range(0xD000, 0x20000, 7)]
    texts += ["", "it's 3rd_party \u2014 \u00bd caf\u00e9\u0301 \u0130", "".join(map(chr, range(0x2000, 0x2400)))]
    assert all(t._words(x) == [w.encode() for w in t._WORD.findall(x)] for x in texts)


def test_isotonic_does_not_fall():
    rng = np.random.default_rng(2)
    x = rng.random(200)
    at, value = t.isotonic(x, (rng.random(200) < x).astype(float))
    assert (np.diff(at) >= 0).all() and (np.diff(value) >= 0).all()


def brute(docs, labels):
    """Scores and evidence by plain loops over dictionaries."""
    known = {d: y for d, y in labels if zlib.crc32(str(d).encode()) % 5}
    words = {d: Counter(re.findall(r"[^\W\d_]+", (x or "").lower())) for d, x in docs}
    ids = sorted(d for d in words if d in known)
    bad, clean = Counter(), Counter()
    for d in ids:
        (bad if known[d] else clean).update(words[d].keys())
    n, toxic = len(ids), sum(known[d] for d in ids)

    def weight(w):
        a, b = bad[w], clean[w]
        e = (a + b) * toxic / n
        g = 0.0
        if a > e:
            g = 2 * (a * math.log(a / e) + (b * math.log(b / (a + b - e)) if b else 0.0))
        return math.log((2 + n) / (1 + a + b)) * (1 + math.sqrt(max(0.0, g)))

    def vector(c):
        v = {w: (1 + math.log(k)) * weight(w) for w, k in c.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / length for w, x in v.items()}

    vectors = {d: vector(c) for d, c in words.items()}
    base = (toxic + t.PRIOR_RATE) / (n + 1)

    def near(d):
        v = vectors[d]
        found = [(-round(sum(x * vectors[e].get(w, 0.0) for w, x in v.items()), 12), e) for e in ids]
        return sorted(x for x in found if x[0] < 0)

    def vote(found):
        return (sum(-c * known[e] for c, e in found) + t.PRIOR * base) / (sum(-c for c, _ in found) + t.PRIOR)

    left_out = np.array([vote([x for x in near(d) if x[1] != d][: t.NEIGHBOURS]) for d in ids])
    knots, values = t.isotonic(np.array([0.0, *left_out, 1.0]), np.array([0.0, *(known[d] for d in ids), 1.0]))
    nearest = {d: near(d)[: t.NEIGHBOURS] for d in words}
    return {d: (float(np.interp(vote(f), knots, values)), [-c for c, _ in f]) for d, f in nearest.items()}


def test_whole_query_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in labels.select("doc_id", "toxic").collect()])
    got = t.toxicity(docs, labels).collect()
    assert len(got) == len(want) == docs.count()
    for r in got:
        score, cosines = want[r.doc_id]
        assert abs(r.score - score) < 1e-6 and r.predicted == int(r.score >= 0.5)
        assert np.allclose([e.cosine for e in r.evidence], cosines, atol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_query_is_the_operator(spark):
    from tablewright.llm import q10

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    by = lambda df: sorted((r.doc_id, r.held_out, r.score, r.predicted, [tuple(e) for e in r.evidence]) for r in df.collect())
    assert by(q10.op10_toxicity(spark, "/root/testdata/sf0.001")) == by(t.toxicity(docs, labels))


def test_model_is_bounded_by_postings(spark, monkeypatch):
    rows = [(i, " ".join(f"{w}{chr(97 + i % 26)}" for w in ("aa", "bb", "cc")), i % 2) for i in range(200)] + [(500, " ".join("x" * k for k in range(1, 400)), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(t, "POSTINGS", 90)
    model = t.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))()
    # Thirty short texts fit, the long one does not.
    assert len(model.ids) == 30 and 500 not in model.ids
    out = t.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    assert len(out) == 201 and {e.doc_id for r in out for e in r.evidence} <= set(model.ids)


def test_equal_scores_at_the_threshold():
    # A probability of exactly a half counts as toxic.
    model = t.Model([1, 2], np.array([1.0, 0.0]), np.array([1, 1]), np.array([5, 5]), np.array([1, 1]))
    model.calibrate(np.array([0.4, 0.6]), np.array([1.0, 0.0]))
    assert np.interp(0.5, model.knots, model.values) == 0.5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = t.toxicity(docs, labels)
    rows = out.join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").select("toxic", "predicted", "score").collect()
    bad = [r for r in rows if r.toxic == 1]
    good = [r for r in rows if r.toxic == 0]
    print("held out", sum(r.predicted for r in bad), len(bad), sum(r.predicted for r in good), len(good))
    assert sum(r.predicted for r in bad) >= 91 and len(bad) == 97
    assert sum(r.predicted for r in good) <= 4
    assert all(0 <= r.score <= 1 for r in rows)


def test_rare_terms_of_many_examples(spark):
    word = lambda k: hashlib.md5(str(k).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))
    # Each toxic word is in 9 of 1,350 toxic rows.
    rows = [(i, f"plain words here {word(i % 150)}", 1) for i in range(1350)] + [(i, f"plain words here {word(i)}", 0) for i in range(2000, 12000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = t.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).join(df, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in out}
    assert share[1] > 0.8 and share[0] < 0.02


def test_rows_that_share_an_id_with_different_texts(spark):
    rows = [(i, f"good day {i}", 0) for i in range(40)] + [(100 + i, f"vile day {i}", 1) for i in range(40)]
    df = spark.createDataFrame(rows + [(5, "vile day", 0), (5, "vile day", 0)], "doc_id long, text string, toxic int")
    out = t.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic").distinct()).join(df, "doc_id").collect()
    same = [r.score for r in out if r.doc_id == 5 and r.predicted]
    assert len(set(same)) <= 1 and all(r.predicted == r.toxic for r in out if r.doc_id != 5)
    # Evidence for any text that shares a word.
    assert t.toxicity(spark.createDataFrame([(7, "day")], "doc_id long, text string"), df.select("doc_id", "toxic").limit(0)).first().evidence == []


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.toxicity(none, no_labels).count() == 0
    docs = spark.createDataFrame([(1, None), (1, None), (None, "x"), (3, "y " * 9000)], "doc_id long, text string").withColumn("score", F.lit(9))
    rows = t.toxicity(docs, spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 0)], "doc_id long, toxic int")).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    bare = t.toxicity(docs, no_labels).collect()
    assert all(r.score == t.PRIOR_RATE and r.predicted == 0 for r in bare)
    assert t.keep_clean(docs, no_labels).count() == 4
