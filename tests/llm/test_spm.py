import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from fraudloom.llm import spm


@pytest.fixture(scope="module")
def pieces():
    return spm.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)


def ids(x):
    return np.frombuffer(x, np.int32).tolist()


def test_equals_the_library(pieces, library):
    r = random.Random(2)
    bits = ["the", "ing", " ", "  ", "é", "日本", "\n", "\t", "😀", "a", "zz", ",", "'s", "▁", "Über", "0", "\x00", "ﬁ"]
    texts = ["", " ", "   lead", "trail  ", "a" * 300, " " * 40 + "x", "▁▁", "\n\n"] + ["".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(1500)]
    enc, dec = spm.Encoder(pieces), spm.Decoder(pieces)
    for t, e in zip(texts, enc(texts)):
        assert ids(e) == library.encode(t), t
        assert dec(ids(e)) == library.decode(library.encode(t)) == t.replace("▁", " ")


def test_unigram_is_the_best_sum():
    r = random.Random(4)
    voc = {c: (k, -5.0 - k) for k, c in enumerate("abc" + spm.MARK)}
    for n, s in enumerate(["ab", "bc", "abc", spm.MARK + "a", "cab", "bb", "caba"]):
        voc[s] = (10 + n, -r.random() * 9)
    p = spm.Pieces(voc, [], 99, "unigram")

    def best(w):
        if not w:
            return 0.0
        return max(voc[w[:k]][1] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in voc)

    words = [spm.MARK + "".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(200)]
    for w, parts in spm.Encoder(p).walk(words).items():
        assert "".join(parts) == w and abs(sum(voc[x][1] for x in parts) - best(w)) < 1e-9


def test_shared_prefixes_do_not_leak(pieces):
    words = [spm.MARK + w for w in ("a", "an", "ant", "anthem", "b", "antler", "ante", "the", "theme", "then")]
    together = spm.Encoder(pieces).walk(words)
    assert all(spm.Encoder(pieces).walk([w])[w] == parts for w, parts in together.items())


def test_table_and_round_trip(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = spm.query(spark, sf_dir).collect()
    assert len(got) == len(texts) and all(r.round_trip for r in got)
    for r in got[:60]:
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)
    back = {r.doc_id: r.text for r in spm.decode(spm.encode(docs)).collect()}
    assert back == texts


def test_edge_rows(spark, library):
    rows = [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "word " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((str(r.doc_id), r.n_tokens) for r in spm.encode(df).collect())
    assert got == sorted([("1", 0), ("2", 0), ("2", 0), ("None", len(library.encode("x y"))), ("3", len(library.encode("word " * 20_000)))])
    assert spm.encode(df.limit(0)).count() == 0
    assert [r.text for r in spm.decode(spark.createDataFrame([(1, None), (2, [1, 2])], "doc_id long, ids array<int>")).collect()] == ["", ""]
