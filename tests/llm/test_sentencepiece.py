import hashlib
import time
import zlib

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from tablewright.llm import sentencepiece_codec as s
from tablewright.llm.q1 import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


def texts():
    rng = np.random.default_rng(8)
    pool = list("abcdeionrst  ▁éß\n\tΣ名前😀Ａ\x00`#=") + ["ing", "tion", " the", "    ", "ther"]
    out = ["", " ", "  ", " " * 40, "a  b", " tail ", "aaaaaaaaaaaaa", "ababababab" * 9, "▁x▁y", "x" * 300, "nnnnnnnnnnnnnnnnnn sssss lllll"]
    out += ["".join(rng.choice(pool, rng.integers(1, 120))) for _ in range(1500)]
    out += ["".join(rng.choice(list("ab"), rng.integers(1, 60))) for _ in range(300)]
    return out


def test_ids_and_texts_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own = s.codec(PATH)
    some = texts()
    made = own.encode(some)
    for t, ids in zip(some, made):
        assert ids.tolist() == sp.encode(t), t
        assert own.decode(ids) == sp.decode(ids.tolist()), t


def test_documents_and_round_trip(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    df = df.unionByName(spark.createDataFrame([(None, "x"), (5, None), (5, None)], df.schema)).withColumn("ids", F.lit("clash"))
    rows = {(r.doc_id, r.text): r for r in df.collect()}
    got = s.digests(df, PATH).collect()
    want = []
    for d, t in [(r.doc_id, r.text) for r in df.collect()]:
        ids, back = sp.encode(t or ""), (t or "").replace("▁", " ")
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(back), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(rows) > 900
    plain = s.decode(s.encode(df.limit(50), PATH), PATH).collect()
    assert all((r.doc_id, r.text) in rows for r in plain)
    assert s.encode(df.limit(0), PATH).count() == 0


def long_words():
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    out = ["".join(rng.choice(letters, 9000)), "a" * 7001, "ab" * 3000 + "c" + "ba" * 3000, "".join(rng.choice(list("ea"), 12_000)), "=" * 6000 + "é名😀" * 900]
    return out + ["x " + out[0] + " y\n" + out[1], "".join(rng.choice(["tion", "ing", "the", "名", "9"], 4000))]


def test_long_words_equal_the_library(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own = s.codec(PATH)
    for run in (1024, 2):
        monkeypatch.setattr(s, "RUN", run)
        own.known.clear()
        for t, ids in zip(long_words(), own.encode(long_words()), strict=True):
            assert ids.tolist() == sp.encode(t), t[:40]
            assert own.decode(ids) == t


def test_a_word_of_five_million_characters():
    own, sp = s.codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    letters = np.array(list("etaoinshrdlu"))[np.random.default_rng(12).integers(0, 12, 5_000_000)]
    word = "".join(letters)
    begin = time.monotonic()
    ids = own.encode([word])[0]
    assert time.monotonic() - begin < 180
    assert own.decode(ids) == word
    # Far from its end, a prefix has the library's ids.
    want = sp.encode(word[:20_000])
    assert ids[: len(want) - 20].tolist() == want[:-20]
