import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fraudloom.llm import common, warc

TRICKY = ["WARC/1.1\r\nWARC-Type: response\r\n\r\n", "\r\n\r\n", "a\n\nb\r\n", "x" * 50_000, "é😀\x00\n", "\n", "Content-Length: 5"]


def brute(rows):
    pay = [(p, (h or "").encode()) for p, _, h in rows]
    first = {}
    for p, b in pay:
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    seen, out = set(), []
    for p, b in sorted(pay, key=lambda x: (x[0] is None, x[0] or 0)):
        rev = len(b) >= 100 and b in first and not (p == first[b] and b not in seen)
        seen.add(b)
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if rev else "response", first[b] if rev else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    same = "the same page " * 20
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate(TRICKY)] + [(50, "u", same), (40, "u\r\nX: y", same), (60, None, same), (41, "u", same), (70, "u", "short"), (71, "u", "short"), (80, "u", None), (81, "u", "")]
    rows += [(k, "hot", "hot page " * 30) for k in range(100, 160)] + [(40, "u\r\nX: y", same), (None, "u", same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted((tuple(r) for r in warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == brute(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archive_bytes_and_nested_rows(spark):
    rows = [(k, f"http://h/{k}", t) for k, t in enumerate(TRICKY)]
    path = common.Scratch(spark, "warc-test").path("a")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), path)
    files = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    raw = b"".join(gzip.open(f.removeprefix("file:")).read() for f in files)
    at = n = 0
    while at < len(raw):  # an independent reader by the standard's grammar
        head, _, rest = raw[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[size : size + 4] == b"\r\n\r\n"
        at += len(head) + 4 + size + 4
        n += 1
    assert n == 3 * len(rows)
    t = {r.metadata["page-id"]: r for r in warc.transactions(warc.read(spark, path)).collect()}
    for k, url, text in rows:
        r = t[str(k)]
        assert bytes(r.main.payload) == text.encode() and r.main.url == url and r.request.head.startswith(f"GET {url} ") and r.metadata["payload-bytes"] == str(len(text.encode()))


def test_damaged_archive_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nabc"))
    with pytest.raises(Exception, match="inside a record|shorter"):
        warc.read(spark, str(tmp_path)).count()
