"""Toxicity (operator 1): character n-gram linear classifier with naive Bayes scaling.

Features: hashed character n-grams (2 to 5 code points, word edges marked) of
a text's distinct words; a feature's value is the number of its
occurrences in them. Values are scaled by the log-count ratio of the n-gram between the two classes, and a logistic
regression is fit on the scaled values. The fit uses a bounded sample of the
labelled rows (SAMPLE a class, by hash order); scoring reads every whole text.

Because values sum over words, a text is scored word by word: each distinct
word's n-grams are looked up once and cached in the worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDERS = (2, 3, 4, 5)
BITS = 18
SAMPLE = 2500
THRESHOLD = 0.7
CACHE = 150_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of the words, edges marked by \\x02 and \\x03."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    who = np.cumsum(c == 2) - 1
    out_w, out_b = [], []
    for n in ORDERS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ c[k : len(c) - n + 1 + k]) * _MUL
            h ^= h >> np.uint64(29)
        ok = who[: len(h)] == who[n - 1 :]
        out_w.append(who[: len(h)][ok])
        out_b.append((h[ok] >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out_w), np.concatenate(out_b)


def words_of(text: str | None) -> list[str]:
    """Distinct lower-cased words in order of first sight; \\x02 and \\x03, which mark edges, become blanks."""
    return list(dict.fromkeys((text or "").lower().replace("\x02", " ").replace("\x03", " ").split()))


def doc_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and how many of the distinct words' n-grams fall into each."""
    b, n = np.unique(word_features(words_of(text))[1], return_counts=True)
    return b.astype(np.int32), n.astype(np.int32)


@dataclass
class Model:
    """weight: of a bucket, per distinct word; bias: of an empty text."""

    weight: np.ndarray
    bias: float


def ratios(p: np.ndarray, q: np.ndarray, n1: int, n0: int, alpha: float = 1.0) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket from the texts of either class that hold it; 0 where it says nothing.

    Buckets in fewer than 5 texts, or whose ratio is within three standard
    errors of none, say nothing.
    """
    p, q = p + alpha, q + alpha
    r = np.log(p / (n1 + 2 * alpha)) - np.log(q / (n0 + 2 * alpha))
    return np.where((p + q >= 5 + 2 * alpha) & (np.abs(r) > 3 * np.sqrt(1 / p + 1 / q)), r, 0.0)


def fit(features: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, r: np.ndarray, prior: float, l2: float = 1e-5, rounds: int = 300) -> Model:
    """Logistic regression on count * r over the buckets with a ratio, by full-batch Adam.

    prior: share of label 1 among all training rows; the sample is balanced,
    so the bias is moved to it.
    """
    size, prior = len(r), min(max(prior, 1e-3), 1 - 1e-3)
    shift = float(np.log(prior / (1 - prior)))
    kept = np.flatnonzero(r)
    if not len(y) or y.min() == y.max() or not len(kept):
        return Model(np.zeros(size), shift)
    place = np.full(size, -1)
    place[kept] = np.arange(len(kept))
    cols, vals, row = [], [], []
    for k, (b, n) in enumerate(features):
        on = place[b] >= 0
        cols.append(place[b[on]])
        vals.append(n[on] * r[b[on]])
        row.append(np.full(int(on.sum()), k))
    cols, vals, row = np.concatenate(cols), np.concatenate(vals), np.concatenate(row)
    w, b0 = np.zeros(len(kept)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for k in range(1, rounds + 1):
        z = np.bincount(row, vals * w[cols], len(y)) + b0
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        gw, gb = np.bincount(cols, vals * g[row], len(kept)) + l2 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**k, 1 - 0.999**k
        w -= 0.02 * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b0 -= 0.02 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    full = np.zeros(size)
    full[kept] = w * r[kept]
    return Model(full, float(b0 + shift))


def train(docs: DataFrame, labels: DataFrame, learn, target: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` rows of each class among the labelled rows where `learn` (a condition on doc_id) holds.

    The rows are the first by hash of doc_id, so reruns agree. Rows whose
    label or doc_id is null, or that have no document, teach nothing; of
    contradicting labels the smaller counts.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.min(F.col(target).cast("int")).alias("y"))
    share = known.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    if not share.n:
        return fit([], np.zeros(0), np.zeros(1 << BITS), 0.5)
    picked = [known.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * sample rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "y"), "doc_id").select("doc_id", "y", "text")
    rows = common.Scratch(spark, "toxicity").table(rows, "sample")
    # Only totals by bucket and the buckets with a ratio come to the driver.
    totals = rows.mapInArrow(_presence, "bucket int, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toArrow()
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = totals["bucket"].to_numpy()
    p[at], q[at] = totals["p"].to_numpy(), totals["q"].to_numpy()
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    r = ratios(p, q, n.get(1, 0), n.get(0, 0))
    got = rows.mapInArrow(_featurise(r != 0), "doc_id long, y int, bucket binary, n binary").collect()
    got.sort(key=lambda x: (x.doc_id, bytes(x.bucket), bytes(x.n)))
    features = [(np.frombuffer(x.bucket, np.int32), np.frombuffer(x.n, np.int32)) for x in got]
    return fit(features, np.array([x.y for x in got], float), r, share.p / share.n)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class that hold a bucket, a task's sums."""
    held = np.zeros((2, 1 << BITS), np.int64)
    for b in batches:
        for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            held[1 if y == 1 else 0][doc_features(t)[0]] += 1
    at = np.flatnonzero(held.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[1][at]), pa.array(held[0][at])], ["bucket", "p", "q"])


def _featurise(use: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [doc_features(t) for t in b.column("text").to_pylist()]
            f = [(x[use[x]], n[use[x]]) for x, n in f]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([x.tobytes() for x, _ in f], pa.binary()), pa.array([n.tobytes() for _, n in f], pa.binary())], ["doc_id", "y", "bucket", "n"])

    return run


class _Scorer:
    """Weight of a word, cached in two generations of at most CACHE words."""

    def __init__(self, model: Model):
        self.model, self.new, self.old = model, {}, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        new, old = self.new, self.old
        unseen: dict[str, None] = {}
        for d in docs:
            for w in d:
                if w not in new:
                    if w in old:
                        new[w] = old[w]
                    else:
                        unseen[w] = None
        fresh = list(unseen)
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            who, bucket = word_features(part)
            new.update(zip(part, np.bincount(who, self.model.weight[bucket], len(part)).tolist()))
        get = new.__getitem__
        z = np.array([sum(map(get, d)) for d in docs], float) + self.model.bias
        if len(new) > CACHE:
            self.old, self.new = new, {}
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs (text, ...) -> the same columns and the score in one more, whose name they must not have; null texts score as empty ones."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast((model.weight.astype(np.float64), model.bias))  # 2^BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(Model(*shared.value))
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scorer(b.column("text").to_pylist()))], [*b.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs -> a row each with doc_id, held_out, score and predicted (1 from the threshold on).

    Learns from rows that are not held out only. Null or empty texts get the
    score of a text without features; a null doc_id counts as the empty
    string for held_out; repeated rows score alike; without usable labels
    every score is the same; an empty table gives no rows.
    """
    model = train(docs, labels, ~held_out())
    out = score(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns whatever their names, whose score is below the threshold."""
    model, name = train(docs, labels, ~held_out()), common.unused(docs.columns, "score")
    return score(docs, model, name).filter(F.col(name) < threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
