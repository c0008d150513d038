import numpy as np

import corpus_pipeline as p
from tablewright.llm import packing
from tablewright.llm.q1 import tokenizer_path
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute as simhash_brute
from tests.llm.test_suffix_dedup import brute as suffix_brute


def test_stages_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(400)])
    texts = [" ".join(rng.choice(words, rng.integers(1, 200))) for _ in range(60)]
    texts += ["idiot scum " + " ".join(rng.choice(words, 30)) for _ in range(20)]
    texts += texts[:10] + [texts[3][:200] + " tail", None, "", "é" * 80 + texts[0][:90], "è" * 80]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 0, int(60 <= i < 80)) for i in range(80)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = p.clean_stage(spark, docs, sf)
    assert clean.columns == docs.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert not set(left) & set(range(60, 80)) and set(range(60)) <= set(left)
    single = p.simhash_stage(spark, clean, sf)
    kept = {r.doc_id: r.text for r in single.collect()}
    groups = simhash_brute(sorted(left.items()))
    assert set(kept) == {c for _, _, c in groups} and single.columns == docs.columns
    cut = p.suffix_stage(spark, single, sf)
    rest = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and set(rest) == set(kept)
    assert all(r.n_chars == len(r.text) for r in rest.values())
    for d, n_bytes, removed, _, _ in suffix_brute(sorted(kept.items())):
        assert n_bytes - removed - 6 <= len(rest[d].text.encode()) <= n_bytes - removed
    out = p.run(spark, sf).collect()
    check(out, sorted((d, r.text) for d, r in rest.items()), packing.WordIds(tokenizer_path()).tokenizer)


def test_odd_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, body string, fp long, spans int, carried string"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    rows = [(1, None, None, None, None, "b", 1, 1, "c"), (None, "lost and found", None, "s", 3, None, None, None, None), (2, "a b c", "en", "s", 5, "x", 2, 2, "y"), (2, "a b c", "en", "s", 5, "x", 2, 2, "y")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, kind)
        for name, stage in p.STAGES[:-1]:
            docs = p.written(stage(spark, docs, sf), f"odd-{name}")
            assert docs.columns == spark.createDataFrame([], kind).columns
        left = docs.collect()
        assert sorted((r.doc_id, r.text) for r in left if r.doc_id is not None) == ([(1, ""), (2, "a b c"), (2, "a b c")] if data else [])
        assert all(r.body == "x" and r.carried == "y" for r in left if r.doc_id == 2)
        packed = p.STAGES[-1][1](spark, docs, sf).collect()
        assert len(packed) == len(left)
