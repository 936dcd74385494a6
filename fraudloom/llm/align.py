"""Cross-tokenizer alignment (operator 11): which tokens of two tokenizers cover the same bytes.

A text is encoded by A, a byte-level BPE that sees a space before it, and by B,
a SentencePiece model that adds that space itself. Where tokens of both end the
bytes are cut into groups. Between two neighbouring ends, of whichever side,
exactly one A and one B token overlap, so the links of a text are its distinct
ends.

Fast path: an array gives each A id the B id with the same bytes. Links between
such ids, in particular all plain one-to-one groups, are counted in a vector
as long as A's vocabulary, one a task. Only what is left are pairs. A chunk of
texts keeps its distinct pairs once, and its texts point at them; only a
chunk's distinct pairs enter the shuffle, already counted by document. A chunk
is a row of long arrays, so each is a row group of its own (Spark's reader
decodes a group's rows at once), and the second pass has one chunk at a time
with the counts of its pairs, whatever the number of chunks a task has.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: UTF-8 bytes of text in a chunk; a longer text is a chunk alone.
CHUNK = 4 << 20
# Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space of this length go to the other library: tiktoken's expression engine fails from some 500,000 on.
LONG_BLANK = re.compile(r"\s{50000}")

CHUNKS = ("chunk long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, groups_sha256 array<string>, "
          "pair array<long>, held array<int>, n_pairs array<int>, pair_at array<int>, times array<int>, n_same array<int>, same array<int>, same_times array<int>, vector array<long>")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Vocabularies:
    """Both tokenizers' files and, by id, the bytes of each token (None: a special token)."""

    a_json: str
    b_model: bytes
    a: list[bytes | None]
    b: list[bytes | None]
    same: np.ndarray = field(init=False)

    def __post_init__(self):
        """same: of each A id the B id with the same bytes, a piece rather than a byte token, -1 if there is none."""
        ids = {}
        for k, x in enumerate(self.b):
            if x:
                ids[x] = k  # byte tokens come before pieces
        self.same = np.array([ids.get(x, -1) if x else -1 for x in self.a], np.int64)


def load(a_file: str = A_FILE, b_file: str = B_FILE) -> Vocabularies:
    """A: a tokenizers file of byte-level BPE whose ids follow the merges. B: a SentencePiece model that adds a space in front."""
    import sentencepiece

    with open(a_file, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_file, "rb") as f:
        b_model = f.read()
    spec = json.loads(a_json)
    special = {t["id"] for t in spec.get("added_tokens", [])}
    letters, vocab = _byte_letters(), spec["model"]["vocab"]
    a: list[bytes | None] = [None] * (max(max(vocab.values()), *special, 0) + 1)
    for s, k in vocab.items():
        if k not in special:
            a[k] = bytes(letters[c] for c in s)
    m = sentencepiece.SentencePieceProcessor(model_proto=b_model)
    b: list[bytes | None] = []
    for k in range(m.get_piece_size()):
        s = m.id_to_piece(k)
        b.append(bytes([int(s[1:-1], 16)]) if m.is_byte(k) else None if m.is_control(k) or m.is_unknown(k) else s.replace("▁", " ").encode())
    return Vocabularies(a_json, b_model, a, b)


class Aligner:
    """The worker's side: both encoders and tables by id."""

    def __init__(self, v: Vocabularies):
        import sentencepiece
        import tiktoken

        self.v = v
        ranks = {x: k for k, x in enumerate(v.a) if x}
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=v.b_model)
        self.other = None
        self.a_bytes, self.b_bytes = ([x or b"" for x in side] for side in (v.a, v.b))
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        na, nb = len(v.a), len(v.b)
        # A token in the middle and at the end of its group's side, the same of B.
        self.said = np.array([b"%d%s" % (k, s) for n, s in ((na, b","), (na, b"|"), (nb, b","), (nb, b";")) for k in range(n)], object)

    def ids_a(self, text: str) -> list[int]:
        if not LONG_BLANK.search(text):
            return self.a.encode_ordinary(text)
        if self.other is None:
            from tokenizers import Tokenizer

            self.other = Tokenizer.from_str(self.v.a_json)
            self.other.encode_special_tokens = True  # their strings in a text are plain text
        return self.other.encode(text, add_special_tokens=False).ids

    def chunk(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Everything that a chunk's row holds but its documents' ids; identity counts by A id in `vector`."""
        ids_a, ids_b, sizes, at = [], [], [], []
        for k, t in enumerate(texts):
            if not t:
                continue
            raw, a, b = b" " + t.encode("utf-8", "surrogatepass"), self.ids_a(" " + t), self.b.encode(t)
            if b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)):
                ids_a.append(np.array(a, np.int64))
                ids_b.append(np.array(b, np.int64))
                sizes.append(len(raw))
                at.append(k)
        n, m, va = len(texts), len(at), len(self.v.a)
        out = {c: np.zeros(n, np.int32) for c in ("n_a", "n_b", "n_groups", "n_links", "n_pairs", "n_same")} | {"groups_sha256": [""] * n}
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        a, b = join(ids_a), join(ids_b)
        end_a, end_b, stop = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(np.array(sizes, np.int64))
        # Texts end on both sides, so no group and no link reaches over into the next text.
        cut, ends = np.intersect1d(end_a, end_b, assume_unique=True), np.union1d(end_a, end_b)
        link_a, link_b, doc = a[np.searchsorted(end_a, ends)], b[np.searchsorted(end_b, ends)], np.searchsorted(stop, ends)
        count = lambda x: np.bincount(np.searchsorted(stop, x), minlength=m)
        for c, x in (("n_a", end_a), ("n_b", end_b), ("n_groups", cut), ("n_links", ends)):
            out[c][at] = count(x)

        same = self.v.same[link_a] == link_b
        got, times = np.unique(doc[same] * va + link_a[same], return_counts=True)
        out["n_same"][at] = np.bincount(got // va, minlength=m)
        out |= {"same": (got % va).astype(np.int32), "same_times": times.astype(np.int32), "vector": np.bincount(got % va, minlength=va)}
        pair, where = np.unique(link_a[~same] << 32 | link_b[~same], return_inverse=True)
        got, times = np.unique(doc[~same] * max(1, len(pair)) + where, return_counts=True)
        where = got % max(1, len(pair))
        out["n_pairs"][at] = np.bincount(got // max(1, len(pair)), minlength=m)
        out |= {"pair": pair, "held": np.bincount(where, minlength=len(pair)).astype(np.int32), "pair_at": where.astype(np.int32), "times": times.astype(np.int32)}

        group_a, group_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        last_a, last_b = np.isin(end_a, cut, assume_unique=True), np.isin(end_b, cut, assume_unique=True)
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + va * last_a
        code[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * va + b + len(self.v.b) * last_b
        said, where = self.said[code], [0, *np.cumsum([len(x) + len(y) for x, y in zip(ids_a, ids_b)]).tolist()]
        for k, d in enumerate(at):
            out["groups_sha256"][d] = hashlib.sha256(b"".join(said[where[k] : where[k + 1]])[:-1]).hexdigest()
        return out


_WORKER: dict[str, Aligner] = {}


def _aligner(v: Vocabularies) -> Aligner:
    """The worker's aligner outlives a task."""
    have = _WORKER.get("aligner")
    if have is None or have.v.a_json != v.a_json or have.v.b_model != v.b_model:
        have = _WORKER["aligner"] = Aligner(v)
    return have


def _cuts(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and size + n > limit:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def chunks(scratch: common.Scratch, docs: DataFrame, vocabularies: Vocabularies | None = None, limit: int = CHUNK) -> DataFrame:
    """docs (doc_id, text) -> a written table with a row a chunk of texts, and one a task with its vector (chunk negative)."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(vocabularies or load())  # two vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fraudloom.llm import align

        work = align._aligner(shared.value)
        task, n, total = TaskContext.get().partitionId(), 0, np.zeros(len(work.v.a), np.int64)
        schema = [f.split()[0] for f in CHUNKS.split(", ")]

        def row(chunk: int, got: dict) -> pa.RecordBatch:
            kind = {"chunk": pa.int64(), "groups_sha256": pa.list_(pa.string())} | {c: pa.list_(pa.int64()) for c in ("doc_id", "pair", "vector")}
            return pa.RecordBatch.from_arrays([pa.array([chunk if c == "chunk" else got.get(c)], kind.get(c, pa.list_(pa.int32()))) for c in schema], schema)

        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for i, j in align._cuts(texts, limit):
                got = work.chunk(texts[i:j])
                total += got.pop("vector")
                yield row(task << 32 | n, got | {"doc_id": ids[i:j]})
                n += 1
        if n:
            yield row(-1 - task, {"vector": total})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.table(slim.mapInArrow(run, CHUNKS), "chunks", **{"parquet.block.row.count.limit": 1})


def same_counts(table: DataFrame) -> DataFrame:
    """chunks -> (a, documents): documents that hold a link between an A id and the B id with the same bytes."""
    each = table.filter("chunk < 0").select(F.posexplode("vector").alias("a", "n")).filter("n > 0")
    return each.groupBy("a").agg(F.sum("n").alias("documents"))


def pair_counts(table: DataFrame) -> DataFrame:
    """chunks -> (pair: A id * 2^32 + B id, documents) of all other links."""
    each = table.filter("chunk >= 0").select(F.explode(F.arrays_zip("pair", "held")).alias("x"))
    return each.groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.held").alias("documents"))


def correspondence(table: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """chunks -> every linked pair (a, b, documents, best): the lexicon between the two vocabularies."""
    same = table.sparkSession.createDataFrame([(k, int(b)) for k, b in enumerate(vocabularies.same) if b >= 0], "a int, b int")
    both = same_counts(table).join(same, "a").select("a", "b", "documents")
    both = both.unionByName(pair_counts(table).select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "documents"))
    top = both.groupBy("a").agg(F.max("documents").alias("top"))
    return both.join(top, "a").select("a", "b", "documents", (F.col("documents") == F.col("top")).alias("best"))


def align(docs: DataFrame, vocabularies: Vocabularies | None = None, limit: int = CHUNK) -> DataFrame:
    """docs (doc_id, text) -> a row each: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Counts of pairs go over all rows; each row is a document, also where it
    repeats another or its doc_id, and null doc_ids come back as they are.
    Null and empty texts, and those whose tokens don't give back their bytes
    (a text with U+2581), have zeros and an empty groups_sha256. A text of any
    length is encoded whole. An empty table gives no rows; further columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    s = common.Scratch(spark, "align")
    table = chunks(s, docs, vocabularies, limit)
    counts = s.table(pair_counts(table), "pairs")
    # Both lists are as long as A's vocabulary at most.
    same = {r.a: r.documents for r in same_counts(table).collect()}
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("documents").alias("n")).collect()
    size = max([*same, *(r.a for r in most)], default=-1) + 1
    vector, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    vector[list(same)] = list(same.values())
    best[[r.a for r in most]] = [r.n for r in most]
    shared = spark.sparkContext.broadcast((vector, np.maximum(vector, best)))

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        """A chunk's row and the counts of its pairs, in any order, each with its place in the chunk."""
        vector, best = shared.value

        def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            stop = np.cumsum(sizes)
            return total[stop] - total[stop - sizes]

        b = rows.to_batches()[0]
        col = lambda c: b.column(c)[0].values
        num = lambda c: col(c).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.zeros(len(col("pair")), np.int64)
        of[found["at"].to_numpy()] = found["documents"].to_numpy()
        pair_n, pair_a = of[num("pair_at")], (num("pair") >> 32)[num("pair_at")]
        same, times, same_times = num("same"), num("times"), num("same_times")
        total = summed(pair_n * times, num("n_pairs")) + summed(vector[same] * same_times, num("n_same"))
        top = summed((pair_n == best[pair_a]) * times, num("n_pairs")) + summed((vector[same] == best[same]) * same_times, num("n_same"))
        cols = [col("doc_id"), *[pa.array(num(c)) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(top), pa.array(total), col("groups_sha256")]
        return pa.Table.from_arrays(cols, [c.split()[0] for c in RESULT.split(", ")])

    held = table.filter("chunk >= 0")
    found = held.select("chunk", F.posexplode("pair").alias("at", "pair")).join(counts, "pair").select(F.col("chunk").alias("of"), "at", "documents")
    return held.drop("held", "vector").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"))
