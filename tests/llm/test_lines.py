import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fraudloom.llm import lines


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutate(r, s, n):
    b = list(s)
    for _ in range(n):
        k = r.randrange(3)
        if k == 0 and b:
            b.pop(r.randrange(len(b)))
        elif k == 1:
            b.insert(r.randrange(len(b) + 1), r.choice("abé"))
        elif b:
            b[r.randrange(len(b))] = r.choice("abé")
    return "".join(b)


def test_edit_distance_and_segments():
    r = random.Random(1)
    for t in (1, 2, 3):
        a = ["".join(r.choice("abé") for _ in range(r.randrange(30))) for _ in range(500)]
        b = [mutate(r, x, r.randrange(t + 3)) for x in a]
        want = [edits(x, y) <= t for x, y in zip(a, b)]
        assert lines.edits_within(a, b, t).tolist() == want
        for x, y, w in zip(a, b, want):
            x, y = sorted((x, y), key=len)
            if w and len(x) > t:
                assert set(lines.keys(x, t)[0]) & set(sum(lines.keys(y, t), []))


def brute(docs, t=2, least=20):
    occ = sorted((d, k, s.strip(" ")) for d, text in docs for k, s in enumerate((text or "").split("\n")) if len(s.strip(" ")) >= least)
    texts = sorted({s for *_, s in occ})
    root = {s: s for s in texts}
    linked = set()
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if abs(len(a) - len(b)) <= t and edits(a, b) <= t:
                linked |= {a, b}
                ra, rb = root[a], root[b]
                root = {k: ra if v == rb else v for k, v in root.items()}
    seen, out = set(), {}
    gone = set()
    for d, k, s in occ:
        if root[s] in seen:
            gone.add((d, k))
        seen.add(root[s])
    for d, text in docs:
        parts = (text or "").split("\n")
        out[d] = ("\n".join(x for k, x in enumerate(parts) if (d, k) not in gone), sum((d, k) in gone for k in range(len(parts))), sum(x.strip(" ") in linked for x in parts))
    return out


def test_dedup_against_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdefé ") for _ in range(r.randrange(15, 60))).strip() or "x" for _ in range(40)]
    docs = [(d, "\n".join(mutate(r, r.choice(base), r.choice([0, 0, 1, 2, 5])) for _ in range(r.randrange(1, 8)))) for d in range(60)]
    docs += [(100, ""), (101, "short\nshort\n\nshort"), (102, " \t\n")]
    got = {x.doc_id: (x.text, x.n_removed, x.n_linked) for x in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_hot_units_are_split(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 8)
    r = random.Random(4)
    head = "the very same beginning of all these lines, "
    docs = [(d, head + "".join(r.choice("ab") for _ in range(12))) for d in range(90)]
    got = {x.doc_id: (x.text, x.n_removed, x.n_linked) for x in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_edge_rows(spark):
    line = "a line that is long enough to count"
    df = spark.createDataFrame([(2, line), (2, line), (None, line), (3, None), (4, line + "\nkept")], "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("line", F.lit(1))
    got = sorted(((r.doc_id or -1), r.text or "", r.n_removed) for r in lines.dedup(df).collect())
    assert got == [(-1, line, 0), (2, "", 1), (2, "", 1), (3, "", 0), (4, "kept", 1)]
    assert sorted((r.doc_id or -1) for r in lines.clean(df.drop("n_lines")).collect()) == [-1, 3, 4]
    assert lines.dedup(df.limit(0)).count() == 0


def test_columns_of_any_name_come_back(spark):
    line = "a line that is long enough to count"
    names = ["_key", "_gone", "_id", "_dk", "_copy", "row", "lines", "gone", "key", "id", "dk", "n_lines"]
    df = spark.createDataFrame([(k, line if k < 3 else None) for k in range(5)], "doc_id long, text string").select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for out in (lines.dedup(df), lines.clean(df)):
        rows = out.collect()
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names if n != "n_lines") and {r.doc_id: r.text for r in rows if r.text} == {0: line}
    assert out.columns == df.columns and all(r.n_lines == f"n_lines{r.doc_id}" for r in rows) and len(rows) == 3


def test_a_hot_line_is_posted_once_a_task(monkeypatch):
    monkeypatch.setattr(lines, "SEEN", 50)
    hot = "a hot line that keeps coming back"
    batches = [pa.RecordBatch.from_arrays([pa.array(["\n".join([hot, f"another line of its own {k} {b}"]) for k in range(100)])], ["text"]) for b in range(9)]
    posts, probes = lines.keys(hot, 2)
    n = sum(b.column("key").to_pylist().count(k) for b in lines._post(2, 20)(iter(batches)) for k in [int(np.uint64(posts[0]).view(np.int64))])
    assert n == 1


def test_a_long_text_loses_its_lines_in_linear_time(spark):
    text = "\n".join(f"line number {k // 2} of a long text that repeats" + "abcdefghijklmnop"[k // 2 % 16] * 8 for k in range(40_000))
    out = lines.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string"), threshold=0).first()
    assert out.n_removed == 20_000 and out.text.split("\n") == text.split("\n")[::2]


def test_many_repeats_of_one_line_hide_no_other():
    post = -(1 << 63)

    def meet(v):
        rows = [(7, x) for x in v] + [(8, post | 1)]
        k, v = np.array(rows, np.int64).T
        batches = [pa.RecordBatch.from_arrays([pa.array(k[i : i + 10_000]), pa.array(v[i : i + 10_000])], ["key", "v"]) for i in range(0, len(k), 10_000)]
        return {x for b in lines._meet(batches) for x in zip(b.column("key").to_pylist(), b.column("line").to_pylist())}

    assert meet([post | 5] * 70_000 + [post | 6]) == {(7, 5), (7, 6)}
    assert meet([post | 5] * 150_000 + [4, 5]) == {(7, 4), (7, 5)}
    assert meet([post | 5] * 70_000 + [5] * 70_000) == set()
    assert meet([5] * 70_000 + [6]) == set()
    assert meet([post | x for x in range(70_000)]) == {(7, x) for x in range(70_000)}
