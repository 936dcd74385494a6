"""WARC archives (operator 8): writing captures, reading them back, assembling transactions.

Every capture is written as three records: the response (or the revisit of an
equal payload seen before), the request and the metadata; the latter two name
the first by WARC-Concurrent-To. A record ends in CR LF CR LF, so Spark's text
writer with that line separator writes valid archives, gzip-compressed and in
the shared folder, with an atomic commit for each task. Reading streams the
decompressed lines of a file through a parser that trusts Content-Length only,
so neither a file nor a payload's look matters, and one record at a time is
held. Transactions are joined by the identifiers into one nested row a capture.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 100
SALTS = 32
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n\r\n"


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\x00", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _headers(*pairs: tuple[str, Column]) -> Column:
    """Header block; a pair whose value is null is left out."""
    return F.concat(F.lit(VERSION), *(F.coalesce(F.concat(F.lit(f"\r\n{k}: "), v.cast("string")), F.lit("")) for k, v in pairs))


def _clean(c: Column) -> Column:
    """A header value may not hold line ends."""
    return F.regexp_replace(c, r"[\r\n]+", " ")


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages (page_id, url, html) -> (value): the text of three WARC records a row, their last separator left to the writer.

    Equal payloads of min_revisit bytes or more: the smallest page_id is the
    response, the others revisit it. The first row is found by an aggregate;
    only digests with two rows or more come back, over a salted join, so a
    payload that a third of all rows share is spread over SALTS tasks.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    p = p.repartition("digest", "salt")  # serves the window and the join, so payloads are dealt once
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("digest", "salt", "page_id").orderBy("url")))
    same = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
            .filter(F.octet_length("html") >= min_revisit).groupBy(F.sha2("html", 256).alias("digest"))
            .agg(F.count("*").alias("copies"), F.min("page_id").alias("first_id")).filter("copies > 1")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("digest", "salt", "first_id", "copies"))
    p = p.join(same, ["digest", "salt"], "left")
    revisit = F.col("copies").isNotNull() & F.col("first_id").isNotNull() & ~F.coalesce((F.col("page_id") == F.col("first_id")) & (F.col("n") == 1), F.lit(False))
    ident = lambda page, n: _uuid(F.coalesce(page.cast("string"), F.lit("null")), F.col("digest"), n.cast("string"))
    rid = ident(F.col("page_id"), F.col("n"))
    first = F.when(revisit, ident(F.col("first_id"), F.lit(1)))
    url = _clean(F.coalesce("url", F.lit("about:blank")))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    kind = F.when(revisit, "revisit").otherwise("response")
    size = F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    main = F.concat(_headers(("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url),
                             ("WARC-Payload-Digest", digest), ("WARC-Refers-To", first), ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
                             ("Content-Type", F.lit("text/html")), ("Content-Length", size)), F.lit(_END), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    def side(kind: str, media: str, body: Column) -> Column:
        return F.concat(_headers(("WARC-Type", F.lit(kind)), ("WARC-Record-ID", _uuid(rid, F.lit(kind))), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", url),
                                 ("WARC-Concurrent-To", rid), ("Content-Type", F.lit(media)), ("Content-Length", F.octet_length(body))), F.lit(_END), body)
    request = side("request", "application/http; msgtype=request", F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\n\r\n")))
    note = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")), F.lit("payload-bytes: "), F.col("bytes").cast("string"), F.lit("\r\n"),
                    F.when(F.col("url").isNull(), F.lit("null-url: 1\r\n")).otherwise(F.lit("")))
    return p.select(F.concat(main, F.lit(_END), request, F.lit(_END), side("metadata", "application/warc-fields", note)).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Writes .txt.gz archives into a new folder at path."""
    records(pages).write.option("lineSep", _END).option("compression", "gzip").text(path)


class _Parser:
    """Takes a file's lines without their LF, gives (headers, body)."""

    def __init__(self):
        self.state, self.head, self.body, self.left = "between", [], [], 0

    def line(self, x: bytes):
        if self.state == "body":
            if len(x) + 1 <= self.left:
                self.body += [x, b"\n"]
                self.left -= len(x) + 1
                return None
            if len(x) < self.left:
                raise ValueError("a record is shorter than its Content-Length")
            self.body.append(x[: self.left])
            rest, self.state = x[self.left :], "between"
            if rest.strip(b"\r"):
                raise ValueError("a record is longer than its Content-Length")
            return dict(self.head), b"".join(self.body)
        x = x.removesuffix(b"\r")
        if self.state == "between":
            if x:
                if x != VERSION.encode():
                    raise ValueError(f"no WARC record: {x[:60]!r}")
                self.state, self.head = "head", []
            return None
        if x:
            k, _, v = x.partition(b":")
            self.head.append((k.strip().lower().decode(), v.strip().decode("utf-8", "replace")))
            return None
        self.left, self.body, self.state = int(dict(self.head)["content-length"]), [], "body"
        return None


_RECORD = "id string, type string, concurrent_to string, refers_to string, url string, payload_digest string, body binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, out, held = _Parser(), [], 0
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())], names)

    for b in batches:
        for x in b.column("value").to_pylist():
            if got := p.line(x):
                h, body = got
                out.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None, body))
                held += len(body)
                if len(out) >= 500 or held > 4_000_000:
                    yield batch()
                    out, held = [], 0
    if p.state != "between":
        raise ValueError("an archive ends inside a record")
    if out:
        yield batch()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Archives -> a row for each record. Compressed files aren't split, so each is read in order by one task."""
    common.prepare(spark)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(_parse, _RECORD)


def transactions(rec: DataFrame, payload: bool = True) -> DataFrame:
    """Records -> one nested row a capture: response or revisit with its request and metadata.

    Keys are record identifiers, one capture has a handful of records, so no
    group is large. A capture without request or metadata has null there; a
    request or metadata record whose capture is missing has a null main.
    Without payload the bodies of responses stay out of the shuffle.
    """
    key = F.coalesce("concurrent_to", "id")
    body = lambda t: F.max(F.when(F.col("type") == t, F.col("body")))
    is_main = F.col("type").isin("response", "revisit")
    main = lambda c: F.max(F.when(is_main, F.col(c)))
    r = rec.withColumn("payload_sha256", F.when(is_main, F.sha2("body", 256))).withColumn("body_bytes", F.when(is_main, F.octet_length("body").cast("long")))
    g = r.groupBy(key.alias("capture")).agg(
        main("type").alias("record_type"), main("url").alias("url"), main("refers_to").alias("refers_to_record"), main("payload_digest").alias("payload_digest"),
        main("payload_sha256").alias("payload_sha256"), main("body_bytes").alias("body_bytes"), *([main("body").alias("payload")] if payload else []), body("request").alias("request"), body("metadata").alias("metadata"))
    return g.select("capture", F.struct("record_type", "url", "refers_to_record", "payload_digest", "payload_sha256", "body_bytes", *(["payload"] if payload else [])).alias("main"),
                    F.struct(F.col("request").cast("string").alias("head")).alias("request"),
                    F.expr("str_to_map(trim(both '\\r\\n' from cast(metadata as string)), '\\r\\n', ': ')").alias("metadata"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Reads archives back into a row for each page; a payload that doesn't match its digest is an error.

    A revisit's page is that of the response its WARC-Refers-To names. Only
    responses that are named come to that join, spread over SALTS, so one that
    very many revisits name is no hot spot.
    """
    t = transactions(read(spark, path), payload=False).filter("main.record_type is not null")
    sound = (F.col("main.record_type") == "revisit") | (F.col("main.payload_sha256") == F.col("main.payload_digest"))
    t = t.select(
        F.col("capture"), F.col("main.refers_to_record").alias("refers_to_record"), F.pmod(F.xxhash64("capture"), F.lit(SALTS)).cast("int").alias("salt"),
        F.col("metadata")["page-id"].cast("long").alias("page_id"),
        F.coalesce(F.when(F.col("main.record_type") == "response", F.col("main.body_bytes")), F.col("metadata")["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.when(sound, F.col("main.payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload digest of "), F.col("capture")))).alias("payload_digest"),
        F.col("main.record_type").alias("record_type"))
    t = common.Scratch(spark, "captures").table(t, "captures")
    wanted = t.filter("record_type = 'revisit'").select(F.col("refers_to_record").alias("capture")).distinct()
    named = t.filter("record_type = 'response'").join(wanted, "capture", "left_semi").select(F.col("capture").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return t.join(named, ["refers_to_record", "salt"], "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back, a row each.

    Null html is an empty payload, a null url is written as about:blank, a
    null page_id stays null (it never is the response that others revisit
    unless all its copies are null; then each is a response). Rows repeated
    with one page_id are captures of their own; of equal payloads the first is
    the response. An empty table gives no rows; further columns are ignored.
    """
    spark = pages.sparkSession
    path = common.Scratch(spark, "warc").path("archive")
    write(pages, path)
    return captures(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
  CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
