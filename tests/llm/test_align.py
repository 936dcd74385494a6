import hashlib
from collections import Counter, defaultdict

import pytest

from fraudloom.llm import align


@pytest.fixture(scope="module")
def vocabularies():
    return align.load()


def slow(texts, v):
    """Rows by the definition: every A and B occurrence compared by their byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(align.A_FILE)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=align.B_FILE)
    docs = []
    for t in texts:
        a = ta.encode(" " + t, add_special_tokens=False).ids if t else []
        b = tb.encode(t) if t else []
        raw = (" " + (t or "")).encode()
        if not t or b"".join(v.a[x] for x in a) != raw or b"".join(v.b[x] or b"" for x in b) != raw:
            docs.append(None)
            continue

        def ranges(ids, table):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(table[x]), x))
                at += len(table[x])
            return out

        ra, rb = ranges(a, v.a), ranges(b, v.b)
        links = [(x, y) for s, e, x in ra for p, q, y in rb if s < q and p < e]
        cuts = sorted({e for _, e, _ in ra} & {e for _, e, _ in rb})
        groups, low = [], 0
        for c in cuts:
            groups.append([[x for s, e, x in r if low <= s and e <= c] for r in (ra, rb)])
            low = c
        docs.append((len(a), len(b), groups, links))
    held = Counter(p for d in docs if d for p in set(d[3]))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2])
        out.append((d[0], d[1], len(d[2]), len(d[3]), sum(held[p] == top[p[0]] for p in d[3]), sum(held[p] for p in d[3]), hashlib.sha256(said.encode()).hexdigest()))
    return out


TEXTS = [
    None, "", " ", "a", "Hello world", "Hello world", "  two  blanks \n\n\tand tabs\r\n", "x" * 700, "naïve café – 東京 🙂🙂 and \u0000 nul",
    "a literal ▁ mark", "<|endoftext|> and <s> and </s> <unk> <0x41> stay plain", "l'été d'Übergrößenträger's we'll 12345678", "aaa aaaa aaaaa aa a" * 9, "\n", "é", "\U00010348​",
    "the quick brown fox " * 12,
]


def columns(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


@pytest.mark.parametrize("limit", [1, 300, align.CHUNK])
def test_equals_brute_force(spark, vocabularies, limit):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "Hello world"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = align.align(docs, vocabularies, limit).collect()
    want = slow([t for _, t in rows], vocabularies)
    assert Counter(zip([r.doc_id for r in got], columns(got))) == Counter(zip([d for d, _ in rows], want))


def test_texts_of_a_table(spark, sf_dir, vocabularies):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 1500")
    rows = docs.orderBy("doc_id").collect()
    got = align.align(docs, vocabularies).orderBy("doc_id").collect()
    assert columns(got) == slow([r.text for r in rows], vocabularies)


def test_chunks_do_not_matter(spark, sf_dir, vocabularies):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (Counter(map(tuple, align.align(docs.repartition(n), vocabularies, limit).collect())) for n, limit in ((1, align.CHUNK), (7, 20_000)))
    assert a == b and len(a) > 150


def test_correspondence(spark, vocabularies):
    from fraudloom.llm import common

    s = common.Scratch(spark, "test")
    table = align.chunks(s, spark.createDataFrame([(1, "Hello world"), (2, "Hello there"), (3, None)], "doc_id long, text string"), vocabularies)
    rows = align.correspondence(table, vocabularies).collect()
    said = {(vocabularies.a[r.a], vocabularies.b[r.b]): (r.documents, r.best) for r in rows}
    assert said[b" Hello", b" Hello"] == (2, True) and said[b" world", b" world"] == (1, True)


def test_empty_and_odd_tables(spark, vocabularies):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), vocabularies).collect() == []
    d = spark.createDataFrame([(1, "a b", "x", 5)], ["doc_id", "text", "n.a", "chunk"])
    assert align.align(d, vocabularies).first().n_a == 2
    nothing = align.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), vocabularies).collect()
    assert sorted(columns(nothing)) == [(0, 0, 0, 0, 0, 0, "")] * 2


@pytest.mark.parametrize("text", [" " * 600_000 + "x", "\n" * 600_000, "ab" * 300_000, "a b" * 100_000])
def test_very_long_texts(spark, vocabularies, text):
    r = align.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), vocabularies).first()
    assert r.n_links > 0 and len(r.groups_sha256) == 64


def test_a_task_holds_one_chunk_at_a_time(spark, vocabularies):
    import pyarrow.parquet as pq

    from fraudloom.llm import common

    docs = spark.createDataFrame([(k, f"text {k}, naïve café " * 9) for k in range(60)], "doc_id long, text string").coalesce(2)
    table = align.chunks(common.Scratch(spark, "test"), docs, vocabularies, 200)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert groups == [1] * table.count() and len(groups) > 50  # the reader decodes a group's rows at once
    out = align.align(docs, vocabularies, 200)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 60
