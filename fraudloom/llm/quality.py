"""Quality rules (operator 3): per-text rules and cross-document line frequency.

One Python pass over the texts measures the per-text rules and hashes the
normalised lines; after it only numbers move. A line's frequency is the number
of documents of a host that hold it: a map-side combined count over
(host, line hash). Lines above the limit are taken out, and a document that
keeps too little is rejected as depleted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_STRIP_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
_SPACE = re.compile(rb"[\x20\x09-\x0d]+")
_DIGITS = re.compile(rb"[0-9]+")
_BLANK = " \t\n\x0b\x0c\r"
SALTS = 16


@dataclass(frozen=True)
class Limits:
    """max_docs: documents of one host that may hold a line before it counts as boilerplate, whatever the host's size.
    min_left: share of its words a document must keep; min_words: and how many."""

    max_docs: int = 20
    min_left: float = 0.3
    min_words: int = MIN_WORDS


def normal_line(line: bytes) -> bytes:
    """A-Z lower-cased, digit runs to 0, ASCII white space to one blank, trimmed."""
    return _DIGITS.sub(b"0", b" ".join(line.lower().split()))


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside a `width`-word window that occurs twice or more in the text, the first one included."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    code = [ids.setdefault(w, len(ids)) for w in words]
    if len(ids) == n:
        return 0
    seen: dict[tuple, int] = {}
    windows = list(zip(*(code[k:] for k in range(width))))
    where = [seen.setdefault(w, k) for k, w in enumerate(windows)]
    if len(seen) == len(windows):
        return 0
    at = np.array(where)
    later = at != np.arange(len(at))
    mark = np.zeros(n + 1, np.int64)
    for s in (np.flatnonzero(later), np.unique(at[later])):
        np.add.at(mark, s, 1)
        np.add.at(mark, s + width, -1)
    return int((np.cumsum(mark[:n]) > 0).sum())


def measure(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, words of each line)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    sizes: dict[int, int] = {}
    for x in lines:
        h = xxhash.xxh64_intdigest(normal_line(x))
        sizes[h] = sizes.get(h, 0) + len(x.split())
    solid = b"".join(words)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "surrogatepass"))
    return (len(words), chars, len(raw.translate(None, _STRIP_SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
            np.array(list(sizes), np.uint64).view(np.int64), np.array(list(sizes.values()), np.int32))


_MEASURED = "doc_id long, host string, rid long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line array<long>, size array<int>"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(t) for t in b.column("text").to_pylist()]
        cols = [b.column("doc_id"), b.column("host"), b.column("rid")]
        cols += [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
        cols += [pa.array([r[5] for r in rows], pa.list_(pa.int64())), pa.array([r[6] for r in rows], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _MEASURED.split(", ")])


def _often(base: DataFrame, s: common.Scratch, limits: Limits) -> DataFrame:
    """(host, line, salt) of the lines in more than the limit's distinct documents; a host's lines are spread over SALTS.

    A row is a document unless its doc_id comes again (null ones never do), so
    only rows of such doc_ids are told apart before the lines are counted.
    """
    again = s.table(base.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    lines = base.join(again, "doc_id", "left_anti").select("host", F.explode("line").alias("line"))
    lines = lines.unionByName(base.join(again, "doc_id", "left_semi").select("doc_id", "host", F.explode("line").alias("line")).distinct().drop("doc_id"))
    often = s.table(lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > limits.max_docs).select("host", "line"), "often")
    return often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _judged(base: DataFrame, often: DataFrame, limits: Limits) -> DataFrame:
    held = (base.select("rid", "host", F.explode(F.arrays_zip("line", "size")).alias("x"))
            .select("rid", "host", F.col("x.line").alias("line"), F.col("x.size").alias("size"), F.pmod("rid", F.lit(SALTS)).cast("int").alias("salt")))
    lost = held.join(often, ["host", "line", "salt"]).groupBy("rid").agg(F.sum("size").cast("long").alias("n_boilerplate"), F.collect_list("line").alias("gone"))
    out = base.drop("line", "size").join(lost, "rid", "left").withColumn("n_boilerplate", F.coalesce("n_boilerplate", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_boilerplate")
    fine = (left >= limits.min_words) & (left >= limits.min_left * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def _measured(docs: DataFrame, host: str, s: common.Scratch, rid: str | None = None) -> DataFrame:
    common.prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("\x00null")).alias("host"),
                       (F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), F.col("text").cast("string").alias("text"))
    return s.table(slim.mapInArrow(_measure, _MEASURED), "measured")


def judge(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """docs (doc_id, text, <host>) -> a row each: measures, base_failed, n_boilerplate (words in lines above the limit), kept.

    A null text counts as empty and fails the base rules. Null hosts form one
    host. Each row is judged by itself; rows of one doc_id are one document
    where a line's documents are counted, rows without one each their own.
    Texts of any length are measured whole. An empty table gives no rows. Further columns are ignored, whatever their names.
    """
    s = common.Scratch(docs.sparkSession, "quality")
    base = _measured(docs, host, s)
    return _judged(base, _often(base, s, limits), limits).drop("gone")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, gone in zip(b.column("_text").to_pylist(), b.column("_gone").to_pylist()):
            if gone and text:
                lines, out_of = text.split("\n"), set(gone)
                keep = [x for x in lines if not x.strip(_BLANK) or int(np.uint64(xxhash.xxh64_intdigest(normal_line(x.encode("utf-8", "surrogatepass")))).view(np.int64)) not in out_of]
                text = "\n".join(keep)
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "_text" else b.column(n) for n in b.schema.names if n != "_gone"], [n for n in b.schema.names if n != "_gone"])


def clean(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """docs -> its columns, for the documents that judge() keeps, their texts without the lines above the limit.

    Each row is judged and cleaned by itself, repeated ones too; null texts
    are not kept. Columns come back as they are, whatever their names.
    """
    s = common.Scratch(docs.sparkSession, "quality")
    given = s.table(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(f"`{host}`").cast("string").alias("host")), "given")
    base = _measured(given, "host", s, "rid")
    kept = _judged(base, _often(base, s, limits), limits).filter("kept").select("rid", F.col("gone").alias("_gone"))
    both = given.join(kept, "rid").select("row", F.col("text").alias("_text"), "_gone")
    cut = both.mapInArrow(_cut, T.StructType([both.schema["row"], T.StructField("_text", T.StringType())]))
    return cut.select(*[F.col("_text").cast(docs.schema[c].dataType).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate")


#: DuckDB: the same rules over lists; a line is hashed there by its normalised text itself.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT rid, unnest(range(1, len(words) - 3)) AS p FROM w WHERE len(words) >= 5),
win AS (SELECT pos.rid, p, list_slice(words, p, p + 4) AS k FROM pos JOIN w USING (rid)),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
nrep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM rep) GROUP BY rid),
l AS (
  SELECT rid, who, host, line, sum(n) AS n FROM (
    SELECT rid, who, host, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
      regexp_replace(trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS line
    FROM (SELECT rid, coalesce('d' || doc_id, 'r' || rid) AS who, host, unnest(lines) AS x FROM w)) GROUP BY rid, who, host, line),
often AS (
  SELECT host, line FROM l GROUP BY host, line HAVING count(DISTINCT who) > 20),
lost AS (SELECT rid, sum(n) AS n FROM l JOIN often USING (host, line) GROUP BY rid),
m AS (
  SELECT doc_id, len(words) AS n_words, list_sum(list_transform(words, lambda x: length(x))) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(nrep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_boilerplate
  FROM w LEFT JOIN nrep USING (rid) LEFT JOIN lost USING (rid)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_boilerplate >= 10 AND n_words - n_boilerplate >= 0.3 * n_words AS kept, CAST(n_boilerplate AS BIGINT) AS n_boilerplate
FROM v
"""
