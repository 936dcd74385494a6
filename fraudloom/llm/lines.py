"""Line dedup (operator 2): segment-partition edit join of lines.

Lines of MIN_CHARS code points or more are compared, blanks at their ends apart. Two lines
within THRESHOLD edits share one of the THRESHOLD + 1 even segments of the
shorter one, at a place that length and segment number bound. So each distinct
line is posted under (length, segment number, segment) and probes the postings
of equal and shorter lengths with the substrings those bounds allow. Only
lines that meet another in a posting go on, with their texts, to a banded
bit-parallel edit distance. Links make classes (connected components); of each
class the occurrence with the smallest (doc_id, line number) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 2
MIN_CHARS = 20
BLOCK = 512
PAIRS = 4096
CHECK = 16
CELLS = 1_000_000


def cuts(length: int, t: int) -> list[tuple[int, int]]:
    """(start, size) of the t + 1 even segments, the longer ones last."""
    n, size = t + 1, length // (t + 1)
    longer = length - n * size
    out, at = [], 0
    for k in range(n):
        z = size + (k >= n - longer)
        out.append((at, z))
        at += z
    return out


_places: dict[tuple[int, int], list] = {}


def places(length: int, t: int) -> list[tuple[int, int, int, int]]:
    """What a line of this length probes: (posted length, segment, start, size), by the multi-match-aware bounds.

    Its own postings are left out: lines of equal length with an equal segment meet in them anyway.
    """
    got = _places.get((length, t))
    if got is None:
        got = []
        for shorter in range(max(length - t, t + 1), length + 1):
            d = length - shorter
            for i, (p, z) in enumerate(cuts(shorter, t)):
                lo = max(0, p - i, p + d - (t - i))
                hi = min(length - z, p + i, p + d + (t - i))
                got += [(shorter, i, a, z) for a in range(lo, hi + 1) if d or a != p]
        _places[(length, t)] = got
    return got


def keys(line: str, t: int) -> tuple[list[int], list[int]]:
    """Hashes of what a line posts and of what it probes."""
    raw, n, h = line.encode("utf-32-le", "surrogatepass"), len(line), xxhash.xxh64_intdigest
    posts = [h(raw[4 * p : 4 * (p + z)], (n << 4) | i) for i, (p, z) in enumerate(cuts(n, t))]
    probes = [h(raw[4 * a : 4 * (a + z)], (m << 4) | i) for m, i, a, z in places(n, t)]
    return posts, probes


def edits_within(a: list[str], b: list[str], t: int) -> np.ndarray:
    """Whether each pair is within t edits; t at most 31.

    Bit-parallel over a band of 2t + 1 cells along the diagonal: bit k of a
    column's words stands for the row column + k - t. The vertical deltas
    move up one row a column; the score is followed on the band's lowest row
    and led back up to the pair's own row by the last deltas. Every CHECK
    columns pairs whose whole band is over t are given up; a band's least
    value never falls from column to column.
    """
    n = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.zeros(n, bool)
    at = np.flatnonzero(np.abs(la - lb) <= t)
    if not len(at):
        return out
    la, lb = la[at], lb[at]
    width = 2 * t + 1
    # Rows of `a`, t cells of padding before and enough after; padding equals nothing. Columns are stored one after another.
    A = np.full((len(at), int(lb.max()) + 2 * width), 0xFFFFFFFE, np.uint32)
    B = np.full((len(at), int(lb.max())), 0xFFFFFFFF, np.uint32)
    for k, i in enumerate(at.tolist()):
        A[k, t : t + la[k]] = np.frombuffer(a[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        B[k, : lb[k]] = np.frombuffer(b[i].encode("utf-32-le", "surrogatepass"), np.uint32)
    A, B = np.ascontiguousarray(A.T), np.ascontiguousarray(B.T)
    one, full = np.uint64(1), np.uint64((1 << width) - 1)
    low = np.uint64(1 << (width - 1))
    bits = [np.uint64(1 << k) for k in range(width)]
    # Column 0: row r has value r for r >= 0; rows above the table don't count, their deltas are 0.
    vp = np.full(len(at), sum(1 << k for k in range(t + 1, width)), np.uint64)
    vn = np.zeros(len(at), np.uint64)
    score = np.full(len(at), t, np.int64)
    columns, wide = np.sort(np.unique(lb)), len(B)
    ends = set(columns.tolist())

    def at_row(k: int) -> np.ndarray:
        """Values of the band's row k: from the lowest row upwards."""
        v = score.copy()
        for x in bits[k + 1 :]:
            v -= ((vp & x) != 0).astype(np.int64) - ((vn & x) != 0).astype(np.int64)
        return v

    def settle(done: np.ndarray, j: int) -> None:
        for d in range(-t, t + 1):
            mine = done & (la - lb == d)
            if mine.any():
                out[at[mine]] = at_row(t + d)[mine] <= t

    if 0 in ends:
        out[at[lb == 0]] = la[lb == 0] <= t
    for j in range(wide):
        # Column j + 1 covers rows j + 1 - t .. j + 1 + t, characters j - t .. j + t of a, thus A[j : j + width].
        c = B[j]
        x = (A[j] == c).astype(np.uint64)
        for k in range(1, width):
            x |= np.where(A[j + k] == c, bits[k], np.uint64(0))
        # Deltas of column j, in the rows of column j + 1: one row further down; the new lowest row comes in as +1.
        p = (vp >> one) | low
        m = vn >> one
        d0 = ((((x & p) + p) ^ p) | x | m) & full
        hp = m | (~(d0 | p) & full)
        hn = d0 & p
        # On the lowest row the diagonal step costs one unless d0 is set there.
        score += (d0 & low) == 0
        hp1, hn1 = ((hp << one) | one) & full, (hn << one) & full
        vp = hn1 | (~(d0 | hp1) & full)
        vn = hp1 & d0
        stop = j + 1 in ends
        if stop:
            settle(lb == j + 1, j)
        if stop or (j + 1) % CHECK == 0:
            alive = lb > j + 1
            v = score.copy()
            least = v.copy()
            for y in bits[:0:-1]:
                v -= ((vp & y) != 0).astype(np.int64) - ((vn & y) != 0).astype(np.int64)
                np.minimum(least, v, out=least)
            alive &= least <= t
            left = int(alive.sum())
            if not left:
                break
            if left <= 0.8 * len(at):
                at, la, lb, vp, vn, score = at[alive], la[alive], lb[alive], vp[alive], vn[alive], score[alive]
                A, B = np.ascontiguousarray(A[:, alive]), np.ascontiguousarray(B[:, alive])
    return out


def near_pairs(a: list[str], b: list[str], t: int) -> np.ndarray:
    """edits_within in runs of pairs of like length, of at most PAIRS pairs and about CELLS characters."""
    out = np.zeros(len(a), bool)
    size = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    by = np.argsort(size, kind="stable")
    at = 0
    while at < len(by):
        n = min(PAIRS, len(by) - at)
        while n > 1 and n * size[by[at + n - 1]] > CELLS:
            n = max(1, min(n // 2, n - 1))
        run = by[at : at + n].tolist()
        out[run] = edits_within([a[i] for i in run], [b[i] for i in run], t)
        at += n
    return out


SEEN = 100_000  # of each of two generations
_POST, _LOW = 1 << 63, (1 << 63) - 1
BROADCAST_LINES = 100_000
_LINE = np.int64(0x7FFFFFFFFFFFFFFF)


def _post(t: int, least: int):
    """Texts -> (key, v): v the 63 low bits of the line's hash, negative for a posting, so postings come first in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new: set[int] = set()
        old: set[int] = set()
        for b in batches:
            k_out, v_out = [], []
            for text in b.column("text").to_pylist():
                for raw in (text or "").split("\n"):
                    line = raw.strip(" ")
                    if len(line) < least:
                        continue
                    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42) & _LOW
                    if h in new:
                        continue
                    known = h in old
                    new.add(h)
                    if len(new) >= SEEN:  # a line that keeps coming is carried on, so a hot one is posted about once a task
                        new, old = set(), new
                    if known:
                        continue
                    posts, probes = keys(line, t)
                    k_out += posts
                    k_out += probes
                    v_out += [h | _POST] * len(posts)
                    v_out += [h] * len(probes)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(k_out, np.uint64).view(np.int64)), pa.array(np.array(v_out, np.uint64).view(np.int64))], ["key", "v"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, v), postings first -> (key, line) of keys with a posting and two lines or more.

    Holds one batch and the rows of one key; a key with more rows than a batch is passed on as it comes.
    """
    def emit(k: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(line)], ["key", "line"])

    k, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    passing: tuple[int, bool] | None = None
    for b in batches:
        bk, bv = b.column("key").to_numpy(), b.column("v").to_numpy()
        if passing is not None:
            other = bk != passing[0]
            n = int(np.argmax(other)) if other.any() else len(bk)
            if passing[1] and n:
                yield emit(bk[:n], bv[:n] & _LINE)
            bk, bv = bk[n:], bv[n:]
            if not len(bk):
                continue
            passing = None
        k, v = np.concatenate([k, bk]), np.concatenate([v, bv])
        if not len(k):
            continue
        other = (k != k[-1])[::-1]
        last = len(k) - int(np.argmax(other)) if other.any() else 0  # where the last key starts
        if last:
            got = _live(k[:last], v[:last])
            if len(got[0]):
                yield emit(*got)
            k, v = k[last:], v[last:]
        if len(k) > 65_536:
            live = v[0] < 0 and len(np.unique(v & _LINE)) > 1
            if live:
                yield emit(k, v & _LINE)
            if live or v[0] >= 0:
                passing = (int(k[0]), bool(live))
                k, v = k[:0], v[:0]
            else:  # repeats of one line so far; others may follow
                v = np.unique(v)
                k = k[: len(v)]
    if len(k):
        got = _live(k, v)
        if len(got[0]):
            yield emit(*got)


def _live(k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole keys, sorted with postings first: rows of those with a posting and two different lines."""
    line = v & _LINE
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    low, high = np.minimum.reduceat(line, start), np.maximum.reduceat(line, start)
    good = (v[start] < 0) & (low != high)
    rows = np.repeat(good, np.diff(np.concatenate([start, [len(k)]])))
    return k[rows], line[rows]


def _verify(t: int):
    """Units sorted by (key, bi, bj) -> links (u, v) that connect all pairs within t edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        found: list[tuple[int, int]] = []
        todo: list[tuple[list, bool]] = []
        pending = 0

        def flush() -> None:
            nonlocal pending
            small = []
            for rows, one in todo:
                if len(rows) <= 64:
                    small += [(p, q) for i, p in enumerate(rows) for q in rows[i + 1 :] if (one or p[2] != q[2]) and p[0] != q[0] and abs(len(p[1]) - len(q[1])) <= t]
                else:
                    found.extend(_large(rows, one, t))
            ok = near_pairs([p[1] for p, _ in small], [q[1] for _, q in small], t)
            found.extend((p[0], q[0]) for (p, q), x in zip(small, ok) if x)
            todo.clear()
            pending = 0

        def close() -> None:
            nonlocal pending
            if len(rows) > 1:
                todo.append((list(rows), unit[1] == unit[2]))
                pending += len(rows) * len(rows) + sum(len(r[1]) for r in rows) // 64
                if pending > 4 * PAIRS:
                    flush()
            rows.clear()

        for b in batches:
            for key, bi, bj, side, line, text in zip(*(b.column(c).to_pylist() for c in ("key", "bi", "bj", "side", "line", "text"))):
                if (key, bi, bj) != unit:
                    close()
                    unit = (key, bi, bj)
                rows.append((line, text, side))
            if found:
                yield _links(found)
                found.clear()
        close()
        flush()
        if found:
            yield _links(found)

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(sorted(set(found)), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])


def _large(rows: list, one: bool, t: int) -> list[tuple[int, int]]:
    """A large unit: pairs in runs of PAIRS; those whose lines are connected by then aren't compared."""
    rows = sorted(rows, key=lambda r: len(r[1]))
    size, side, line = np.array([len(r[1]) for r in rows]), np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    group = np.arange(len(rows))
    out: list[tuple[int, int]] = []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        apart = group[i] != group[j]
        i, j = i[apart], j[apart]
        ok = near_pairs([rows[x][1] for x in i.tolist()], [rows[x][1] for x in j.tolist()], t)
        for x, y in zip(i[ok].tolist(), j[ok].tolist()):
            if group[x] != group[y]:
                out.append((rows[x][0], rows[y][0]))
                group[group == group[y]] = group[x]

    left, right, held = [], [], 0
    for i in range(len(rows) - 1):
        js = np.arange(i + 1, int(np.searchsorted(size, size[i] + t, "right")))
        js = js[(group[js] != group[i]) & (line[js] != line[i]) & (one | (side[js] != side[i]))]
        left.append(np.full(len(js), i))
        right.append(js)
        held += len(js)
        if held >= PAIRS:
            compare(np.concatenate(left), np.concatenate(right))
            left, right, held = [], [], 0
    if held:
        compare(np.concatenate(left), np.concatenate(right))
    return out


def _occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, dk, pos, line, other, text) of each line long enough; line as in _post, other a second hash."""
    d = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("dk"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "raw"))
    d = d.withColumn("text", F.trim("raw")).filter(F.length("text") >= least)
    return d.select("doc_id", "dk", "pos", F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1).cast("long")).alias("line"), F.xxhash64(F.lit(7), F.col("text")).alias("other"), "text")


def links(docs: DataFrame, scratch: common.Scratch, threshold: int = THRESHOLD, least: int = MIN_CHARS) -> DataFrame:
    """Links (u, v) between different lines within the threshold, enough to connect each class; as a written table."""
    spark = docs.sparkSession
    n = common.tasks(spark)
    posted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_post(threshold, least), "key long, v long")
    met = posted.repartition(n, "key").sortWithinPartitions("key", "v").mapInArrow(_meet, "key long, line long")
    met = scratch.table(met.distinct(), "met")
    wanted = scratch.table(met.select("line").distinct(), "wanted")
    few = wanted.count() <= BROADCAST_LINES
    lines = _occurrences(docs, least).select("line", "text")
    texts = lines.join(F.broadcast(wanted) if few else wanted, "line", "left_semi").groupBy("line").agg(F.min("text").alias("text"))
    units = common.in_blocks(scratch, met, "key", "line", BLOCK).join(texts, "line")
    units = units.select("key", "bi", "bj", "side", "line", "text").repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return scratch.table(units.mapInArrow(_verify(threshold), "u long, v long"), "links")


_COUNTS = ("n_lines", "n_removed", "n_linked")


def _worked(docs: DataFrame, threshold: int, least: int) -> DataFrame:
    """(row: the columns but text, text, n_lines, n_removed, n_linked), see dedup()."""
    spark = docs.sparkSession
    common.prepare(spark)
    s = common.Scratch(spark, "lines")
    comp = s.table(common.connected_components(s, links(docs, s, threshold, least)), "classes")
    occ = _occurrences(docs, least).drop("text")
    classed = occ.join(comp, occ.line == comp.node, "left").select(
        "doc_id", "dk", "pos", F.coalesce("root", "line").alias("class"), F.when(F.col("root").isNull(), F.col("other")).otherwise(F.lit(0).cast("long")).alias("other"), F.col("root").isNotNull().alias("linked"))
    classed = s.table(classed, "classed")
    at = F.struct("doc_id", "dk", "pos")
    first = classed.groupBy("class", "other").agg(F.min(at).alias("first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    first = s.table(first, "first")  # a plain table, so that AQE can split a line that very many documents share
    gone = classed.join(first, ["class", "other"]).filter(~F.col("first").eqNullSafe(at)).select("doc_id", "dk", "pos", F.lit(True).alias("gone"), F.lit(False).alias("linked"))
    linked = classed.filter("linked").select("doc_id", "dk", "pos", F.lit(False).alias("gone"), "linked")
    marks = gone.unionByName(linked).groupBy(F.col("doc_id").alias("id"), F.col("dk").alias("key")).agg(
        F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("pos")))).alias("gone"), F.size(F.collect_set(F.when(F.col("linked"), F.col("pos")))).cast("long").alias("n_linked"))
    text = F.col("text").cast("string")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("dk"), F.split(text, "\n").alias("lines"))
    both = base.join(marks, (F.col("dk") == F.col("key")) & F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    # What stands between the lines that go, so removal is linear however many go.
    cuts = F.zip_with(F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g + 1)), F.concat("gone", F.array(F.size("lines"))), lambda a, b: F.slice("lines", a + 1, b - a))
    kept = F.when(F.size("gone") > 0, F.flatten(cuts)).otherwise(F.col("lines"))
    count = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long").alias
    return both.select("row", F.array_join(kept, "\n").alias("text"), count("lines")("n_lines"), count("gone")("n_removed"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"))


def dedup(docs: DataFrame, threshold: int = THRESHOLD, least: int = MIN_CHARS) -> DataFrame:
    """docs (doc_id, text, ...) -> its columns with the cleaned text, and n_lines, n_removed, n_linked, a row each.

    A line of `least` code points or more goes if its class (equal lines, and
    lines within `threshold` edits, joined transitively) has an occurrence
    with a smaller (doc_id, text hash, line number); null doc_ids come first.
    Shorter lines always stay. n_linked counts lines linked to a different
    text. Null texts stay null. Rows repeated with one doc_id and text count
    as one document and get the same text. An empty table gives no rows.
    Columns of docs named like the three counts are replaced, others keep
    their values whatever their names. Equal lines are told by 127 hash bits,
    links by 63.
    """
    cols = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in _COUNTS]
    return _worked(docs, threshold, least).select(*cols, *_COUNTS)


def clean(docs: DataFrame, threshold: int = THRESHOLD, least: int = MIN_CHARS) -> DataFrame:
    """docs' own columns with the cleaned text, without the documents that lost all their words; n_chars, if there, follows the text."""
    kept = _worked(docs, threshold, least).filter((F.col("n_removed") == 0) | F.coalesce(F.col("text").rlike(common.WORD), F.lit(False)))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return kept.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = common.table(spark, sf_dir, "documents")
    return dedup(d.select("doc_id", "text"))
