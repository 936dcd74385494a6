"""SentencePiece encoding and decoding (operator 7): shared-prefix forward search.

A text becomes marked words (blanks turn into the mark U+2581, one is put in
front). The distinct words of a batch are sorted, so that equal prefixes are
neighbours, and walked as a trie depth-first: the forward states of the common
prefix are kept, only the rest of the word is computed.

The forward state of a prefix depends on the model's kind. Unigram: the best
score and the piece that ends it (Viterbi). BPE: the piece that ends the
prefix's own encoding; it is the one piece p ending there for which the state
before it, q, gives encode(q + p) == [q, p]. Byte-pair merging keeps encodings
of prefixes whole, so this finds exactly what merging would; a highest-sum
Viterbi over BPE ranks would not, see README. Words that start with a run of
marks are merged directly.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 300_000

@dataclass
class Pieces:
    """Piece -> (id, score); ids of the 256 byte pieces (empty without byte fallback); the unknown id; kind bpe or unigram."""

    piece: dict[str, tuple[int, float]]
    byte: list[int]
    unknown: int
    kind: str = "bpe"
    cuts: str = ""
    reach: dict[str, int] = field(init=False)

    def __post_init__(self):
        """reach: of the last three characters of a longer piece, the longest such piece."""
        self.reach = {}
        for s in self.piece:
            if len(s) > 2:
                self.reach[s[-3:]] = max(len(s), self.reach.get(s[-3:], 0))


def load(path: str = MODEL) -> Pieces:
    """Reads a model file with the sentencepiece library; only models with the identity normaliser, a dummy prefix and kept blanks."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only identity-normalised models with a dummy prefix and kept blanks")
    m = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    ids = range(m.get_piece_size())
    piece = {m.id_to_piece(i): (i, m.get_score(i)) for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    if any(MARK in p.lstrip(MARK) or p.lstrip(MARK) != p and len(p) - len(p.lstrip(MARK)) > 1 and p.lstrip(MARK) for p in piece):
        raise ValueError("a piece reaches over a word's start")
    byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if proto.trainer_spec.byte_fallback else []
    kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
    longer = {c for p in piece if len(p) > 1 for c in p}
    return Pieces(piece, byte, m.unk_id(), kind, "".join(c for c in "\n\r\t" if c not in longer))


def merge(word: str, piece: dict[str, tuple[int, float]]) -> list[str]:
    """Byte-pair merging: the neighbours whose joint piece has the highest score first, ties from the left."""
    sym = list(word)
    n = len(sym)
    prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int, str]] = []

    def push(a: int, b: int) -> None:
        if a >= 0 and b >= 0 and (got := piece.get(sym[a] + sym[b])):
            heapq.heappush(heap, (-got[1], a, b, sym[a] + sym[b]))

    for k in range(n - 1):
        push(k, k + 1)
    while heap:
        _, a, b, s = heapq.heappop(heap)
        if not sym[a] or not sym[b] or nxt[a] != b or sym[a] + sym[b] != s:
            continue
        sym[a], sym[b] = s, ""
        nxt[a] = nxt[b]
        if nxt[b] >= 0:
            prev[nxt[b]] = a
        push(prev[a], a)
        push(a, nxt[a])
    return [s for s in sym if s]


class Encoder:
    """Encodes words; keeps a cache of words in two generations and one of piece pairs."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pair: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        # Words are cut before marks and around characters that are in no longer piece.
        c = re.escape(pieces.cuts)
        self.words = re.compile(f"{MARK}*[^{MARK}{c}]+|{MARK}+" + (f"|[{c}]" if c else "")).findall

    def ids(self, parts: list[str]) -> bytes:
        out = []
        for s in parts:
            got = self.p.piece.get(s)
            if got:
                out.append(got[0])
            elif self.p.byte:
                out += [self.p.byte[b] for b in s.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.p.unknown:
                out.append(self.p.unknown)
        return array("i", out).tobytes()

    def fits(self, q: str, s: str) -> bool:
        """Whether pieces q and s stay apart when their text is merged."""
        if len(self.pair) > CACHE:
            self.pair.clear()
        got = self.pair[(q, s)] = merge(q + s, self.p.piece) == [q, s]
        return got

    def whole(self, s: str) -> bool:
        got = self.alone.get(s)
        if got is None:
            got = self.alone[s] = merge(s, self.p.piece) == [s]
        return got

    def walk(self, words: list[str]) -> dict[str, list[str]]:
        """Pieces of distinct words: sorted, depth-first, states of the shared prefix reused."""
        piece, reach = self.p.piece, self.p.reach.get
        pair = self.pair.get
        bpe = self.p.kind == "bpe"
        out: dict[str, list[str]] = {}
        end: list[str] = [""]  # the piece that ends each prefix
        best: list[float] = [0.0]
        low = min((v for _, v in piece.values()), default=0.0) - 10
        before = ""
        for w in sorted(words):
            if bpe and w[:2] == MARK * 2:
                out[w] = merge(w, piece)
                continue
            n, same = len(w), 0
            top = min(n, len(before))
            while same < top and w[same] == before[same]:
                same += 1
            del end[same + 1 :]
            del best[same + 1 :]
            before = w
            for i in range(same + 1, n + 1):
                first = i - reach(w[i - 3 : i], 2) if i > 2 else 0
                if first < 0:
                    first = 0
                if bpe:
                    for a in range(first, i):
                        s = w[a:i]
                        if s in piece or a == i - 1:
                            if a:
                                ok = pair((end[a], s))
                                if ok is None:
                                    ok = self.fits(end[a], s)
                            else:
                                ok = self.whole(s)
                            if ok:
                                end.append(s)
                                break
                    else:
                        raise AssertionError(f"no piece ends at {i} of {w!r}")
                else:
                    score, s = max(((best[a] + (piece[s][1] if s in piece else low), s) for a in range(first, i) if (s := w[a:i]) in piece or a == i - 1), key=lambda x: x[0])
                    end.append(s)
                    best.append(score)
            parts, i = [], n
            while i:
                parts.append(end[i])
                i -= len(end[i])
            out[w] = parts[::-1]
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        docs = [[] if not t else self.words(MARK + t.replace(" ", MARK)) for t in texts]
        new, old = self.new, self.old
        unseen: set[str] = set()
        for d in docs:
            unseen.update(set(d).difference(new))
        known = unseen.intersection(old)
        for w in known:
            new[w] = old[w]
        unseen -= known
        for w, parts in self.walk(list(unseen)).items():
            new[w] = self.ids(parts)
        out = [b"".join(map(new.__getitem__, d)) for d in docs]
        if len(new) > CACHE:
            self.old, self.new = new, {}
        return out


class Decoder:
    def __init__(self, pieces: Pieces):
        self.text = {i: s.replace(MARK, " ").encode("utf-8", "surrogatepass") for s, (i, _) in pieces.piece.items()}
        self.text |= {i: bytes([b]) for b, i in enumerate(pieces.byte)}
        self.text.setdefault(pieces.unknown, " ⁇ ".encode())
        self.table = [self.text.get(i, b"") for i in range(max(self.text) + 1)]

    def __call__(self, ids: list[int] | None) -> str:
        """Control ids (of no piece) say nothing; bytes that make no UTF-8 become U+FFFD; the blank of the dummy prefix goes."""
        ids = ids or []
        if None not in ids and 0 <= min(ids, default=0) <= max(ids, default=0) < len(self.table):
            raw = b"".join(map(self.table.__getitem__, ids))
        else:  # ids outside the vocabulary, nulls
            raw = b"".join([self.text.get(i, b"") for i in ids])
        return raw.decode("utf-8", "replace").removeprefix(" ")


def _stable_encoder(pieces: Pieces) -> Encoder:
    """The worker's encoder: its caches outlive a task."""
    have = _WORKER.get("encoder")
    if have is None or have.p.piece != pieces.piece or have.p.byte != pieces.byte:
        have = _WORKER["encoder"] = Encoder(pieces)
    return have


_WORKER: dict[str, Encoder] = {}


def encode(docs: DataFrame, pieces: Pieces | None = None, check: bool = False) -> DataFrame:
    """docs (doc_id, text) -> a row each: doc_id, ids, n_tokens, and with check also round_trip.

    Null and empty texts have no ids. A text that holds the mark itself decodes
    to a blank in its place; round_trip compares with that. Null doc_ids and
    repeated rows come back as they are; an empty table gives no rows; further
    columns are ignored.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(pieces or load())  # a vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fraudloom.llm import spm

        p = shared.value
        enc = spm._stable_encoder(p)
        dec = Decoder(p) if check else None
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = enc(texts)
            n = np.array([len(x) // 4 for x in ids], np.int64)
            values = np.frombuffer(b"".join(ids), np.int32)
            cols = [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values)), pa.array(n)]
            if dec:
                cols.append(pa.array([dec(np.frombuffer(x, np.int32).tolist()) == (t or "").replace(MARK, " ") for x, t in zip(ids, texts)]))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_tokens", "round_trip"][: len(cols)])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long" + ", round_trip boolean" * check)


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """encoded (doc_id, ids) -> (doc_id, text); null ids are no ids, null arrays the empty text."""
    spark = encoded.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(pieces or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([dec(x) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), check=True)
