import random
import re

from pyspark.sql import functions as F

from fraudloom.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, limits):
    """rows (doc_id, text, source), each a document of its own."""
    base, freq = [], {}
    for d, text, host in rows:
        t = text or ""
        w = W.findall(t)
        marked = set()
        win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for k, x in enumerate(win):
            if win.count(x) > 1:
                marked |= set(range(k, k + 5))
        lines = [x for x in t.split("\n") if W.search(x)]
        norm = {}
        for x in lines:
            y = re.sub("[0-9]+", "0", " ".join(W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x))))
            norm[y] = norm.get(y, 0) + len(W.findall(x))
        for y in norm:
            freq[(host, y)] = freq.get((host, y), 0) + 1
        base.append((d, host, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:k] for k, x in enumerate(lines)), len(marked), norm))
    out = []
    for d, host, n, chars, sym, dup, rep, norm in base:
        lost = sum(c for y, c in norm.items() if freq[(host, y)] > limits.max_docs)
        failed = n < 10 or 100 * rep > 20 * n
        out.append((str(d), n, chars, sym, dup, rep, failed, not failed and n - lost >= limits.min_words and n - lost >= limits.min_left * n, lost))
    return sorted(out)


def run(df, limits):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate"]
    return sorted((str(r[0]), *r[1:]) for r in quality.judge(df, limits=limits).select(*cols).collect())


def test_against_brute_force(spark):
    r = random.Random(7)
    words = ["alpha", "Beta", "γάμμα", "d#1", "e|2", "f3", "x" * 40, "<b>"]
    boiler = ["Share 12 this page with your many friends today please", "Terms of use apply to all"]
    rows = []
    for d in range(150):
        lines = [r.choice(["", " "]).join([" ".join(r.choice(words) + str(r.randrange(r.choice([3, 900]))) for _ in range(r.randrange(1, 14)))]) for _ in range(r.randrange(0, 6))]
        if r.random() < 0.4:
            lines.insert(0, r.choice(boiler).replace("12", str(d)))
        if r.random() < 0.2 and lines:
            lines += lines[:2]
        rows.append((d, r.choice(["\n", "\n\n", "\t\n"]).join(lines), r.choice(["h1", "h1", "h2", None])))
    rows += [(900, None, "h1"), (901, "", "h2"), (902, "one\x0btwo\x0cthree\rfour five", "h1"), (None, "a b c d e f g h i j k", "h1"), (902, "one\x0btwo\x0cthree\rfour five", "h1"), (903, "w " * 60, "h9"), (904, " ".join(f"u{k}" for k in range(4000)), "h9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_words", F.lit("clash")).withColumn("line", F.lit(0))
    for limits in (quality.Limits(3, 0.5), quality.Limits(20, 0.3)):
        assert run(df, limits) == brute(rows, limits)
    assert quality.judge(df.limit(0)).count() == 0


def test_boilerplate_documents_go_and_others_stay(spark):
    rows = [(d, "the very same line that all of these documents hold, every one", "h") for d in range(40)] + [(100 + d, " ".join("".join(chr(97 + int(c)) for c in str(d * 100 + k)) for k in range(30)), "h") for d in range(40)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[d] for d in range(40)) and all(got[100 + d] for d in range(40))


def test_lines_above_the_limit_go_and_no_others(spark):
    r = random.Random(3)
    own = lambda d: [" ".join(f"{chr(97 + r.randrange(26))}{d}{chr(97 + r.randrange(26))}" for _ in range(12)) for _ in range(3)]
    many, some = "Visit  page 7 of our site today", "A line that only twenty documents of the host hold"
    rows = []
    for d in range(200):  # a hot host: the limit doesn't grow with it
        lines = own(d)
        lines[1:1] = [many.replace("7", str(d)).upper() if d % 2 else many] if d < 21 else []
        lines += ["", some] if 30 <= d < 50 else []
        rows.append((d, "\n".join(lines), "hot"))
    rows += [(500 + d, many + "\n" + own(d)[0], "small") for d in range(5)] + [(600, None, "small"), (None, "x " * 20 + own(7)[0], None), (501, rows[0][1], "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_text", F.lit("clash")).withColumn("rid", F.lit(9)).withColumn("host", F.lit("h")).withColumn("row", F.lit("r"))
    out = quality.clean(df)
    got = sorted(((str(x.doc_id), x.text) for x in out.collect()))
    want = sorted((str(d), "\n".join(x for x in t.split("\n") if not x.lower().startswith("visit  page") or h != "hot")) for d, t, h in rows if t and not t.startswith("x x"))
    assert got == want and out.columns == df.columns and {(x._text, x.rid, x.host, x.row) for x in out.collect()} == {("clash", 9, "h", "r")}
    assert quality.clean(df.limit(0)).count() == 0


def test_a_document_counts_once_for_a_line(spark):
    text = "One line that the host repeats here\nand another one with some more words in it"
    schema = "doc_id long, text string, source string"
    often = lambda rows: {r.n_boilerplate for r in quality.judge(spark.createDataFrame(rows, schema)).collect()}
    assert often([(7, text, "h")] * 30) == {0}
    assert often([(7, text, "h")] * 30 + [(k, text, "h") for k in range(100, 119)]) == {0}  # 20 documents
    assert often([(7, text, "h")] * 30 + [(k, text, "h") for k in range(100, 120)]) == {16}
    assert often([(None, text, "h")] * 21) == {16} and often([(None, text, "h")] * 20) == {0}
    assert quality.clean(spark.createDataFrame([(7, text, "h")] * 30, schema)).count() == 30
    assert quality.clean(spark.createDataFrame([(None, text, "h")] * 30, schema)).count() == 0
