"""Conversation structure repair (operator 13): cheapest edits by an auction for shortest paths.

Rows of a conversation, in order, span a lattice of (rows done, role before).
Deleting, inserting, keeping and reroling are arcs with integer costs, and a
repair is a path to an accepting end. The auction keeps a price a node, never
above any arc's cost plus the next node's price, and one path whose arcs are
tight. At the path's end it extends over a tight arc, or else raises the price
to the least of its arcs and contracts. When the end is reached, the origin's
price is its distance. Among the cheapest paths the first in ASCII order is
traced over tight arcs; a node not yet priced exactly is settled by an auction
of its own before its arc is trusted.

Conversations may be of any length: rows are sorted over all tasks and cut into
segments, each solved for the roles it may be entered and left with, and the
few numbers of a segment are put together by conversation. Texts only travel
once, to be written out in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLANKS = " \t\n\x0b\f\r"
# Costs and roles of the contract. States: nothing yet, after system, after user, after assistant.
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP = {(START, "s"): SYSTEM} | {(s, ROLE[t][0]): t for s, t in NEXT.items()}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: (entered, left) that a segment may have at all.
PASSES = [(a, b) for b in range(4) for a in range(4) if b >= USER or a <= b]
SEGMENT = 64


def _or_blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conversations -> (conv_id, turn, role, text) after the contract's damage; null roles and texts are one space."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _or_blank("role").alias("role"), _or_blank("text").alias("text"))
    rows = rows.withColumn("_k", F.crc32(F.concat(_or_blank("conv_id"), F.lit(":"), _or_blank("turn"))) % 20).filter("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_k") == 3, 2).otherwise(1).alias("_n"))
    return out.withColumn("_n", F.explode(F.expr("array_repeat(0, _n)"))).drop("_n")


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds key (text of conv_id, empty for null) and place, what sorts rows inside a turn: role, then SHA-256 of the text."""
    return rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("sha", F.unhex(F.sha2("text", 256)))


def faults(scratch: common.Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (key, turn, role, sha, text) -> (lattice rows without texts: key, turn, role, sha, k, fault, n_rows; gaps by key).

    Equal rows of a turn are one row with a count until they are told apart
    again, so neither they nor a text that comes again and again gather.
    """
    left = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(left == "", BLANK).when(F.substring(left, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    slim = scratch.table(rows.withColumn("fault", fault).groupBy("key", "turn", "role", "sha").agg(F.count("*").alias("n"), F.first("fault").alias("fault")), "slim")
    first = slim.groupBy("key", "role", "sha").agg(F.min(F.struct("turn"))["turn"].alias("first"))  # nulls come first
    turns = slim.groupBy("key", "turn").agg(F.sum("n").alias("n"))
    sizes = turns.groupBy("key").agg(F.sum("n").alias("n_rows"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    sizes = scratch.table(sizes, "sizes")
    new = F.col("turn").eqNullSafe(F.col("first")) & (F.col("k") == 1)
    told = slim.join(first, ["key", "role", "sha"]).join(sizes.select("key", "n_rows"), "key").withColumn("k", F.explode(F.expr("sequence(1L, n)")))
    told = told.withColumn("fault", F.when((F.col("fault") != BLANK) & ~new, DUPLICATE).otherwise(F.col("fault")))
    return scratch.table(told.select("key", "turn", "role", "sha", "k", "fault", "n_rows"), "faults"), sizes.select("key", "gaps")


class Lattice:
    """Rows (role's initial, fault) and the ends that count (state -> cost); prices stay valid for every origin."""

    def __init__(self, rows: list[tuple[str, int]], ends: tuple[int, ...]):
        m = self.m = len(rows)
        self.sink = 4 * (m + 1)
        # What each later row costs however it is treated bounds the distance from below.
        low = [0] * (m + 1)
        for k in range(m - 1, -1, -1):
            f = rows[k][1]
            low[k] = low[k + 1] + (DELETE if f in (BLANK, DUPLICATE) else min(DELETE, CUT_OFF) if f == TRUNCATED else 0)
        self.price = [x for x in low for _ in range(4)] + [0]
        self.arcs: list[list[tuple[str, int, int]]] = []
        for k in range(m + 1):
            for s in range(4):
                out = [("", 0, self.sink)] if k == m and s in ends else []
                if k < m:
                    out.append(("D", DELETE, 4 * (k + 1) + s))
                out.append(("I", INSERT, 4 * k + NEXT[s]))
                if k < m and rows[k][1] in (FINE, TRUNCATED):
                    more = CUT_OFF if rows[k][1] == TRUNCATED else 0
                    if (s, rows[k][0]) in KEEP:
                        out.append(("K", more, 4 * (k + 1) + KEEP[s, rows[k][0]]))
                    out.append(("R", REROLE + more, 4 * (k + 1) + NEXT[s]))
                self.arcs.append(out)
        #: No end that can be reached is further away: all rows deleted but one, two put in.
        self.far = DELETE * m + CUT_OFF + 2 * INSERT

    def auction(self, origin: int) -> bool:
        """Raises prices until the origin's is its distance; False if no end can be reached."""
        price, arcs, path = self.price, self.arcs, [origin]
        while True:
            v = path[-1]
            best, to = min((c + price[t], t) for _, c, t in arcs[v])
            if price[v] < best:
                price[v] = best
                if price[origin] > self.far:
                    return False
                if len(path) > 1:
                    path.pop()
            elif to == self.sink:
                return True
            else:
                path.append(to)

    def solve(self, state: int) -> tuple[int, str] | None:
        """(cost, first cheapest edits in ASCII order) from the first row on, entered with the state."""
        v, said = state, []
        if not self.auction(v):
            return None
        cost = self.price[v]
        while v != self.sink:
            for letter, c, t in self.arcs[v]:  # end, D, I, K, R
                # Prices only rise: an arc that isn't tight won't become so, one that is may only seem so.
                if self.price[v] == c + self.price[t] and (t == self.sink or self.auction(t) and self.price[v] == c + self.price[t]):
                    said.append(letter)
                    v = t
                    break
        return cost, "".join(said)


def _breaks(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


PIECES = "key string, part int, seq long, n_blank long, n_duplicate long, n_truncated long, n_illegal long, head string, tail string, passes array<struct<a:int,b:int,cost:long,audit:string>>"


def _piece(key: str, part: int, seq: int, rows: list[tuple[str, int]], whole: bool) -> tuple:
    """A segment's row: counts, the initials at its ends, and what each pass costs; a whole conversation has one pass, to the end (-1)."""
    if whole:
        passes = [(START, -1, *Lattice(rows, (START, ASSISTANT)).solve(START))]
    else:
        nets = {b: Lattice(rows, (b,)) for b in range(4)}
        passes = [(a, b, *got) for a, b in PASSES if (got := nets[b].solve(a))]
    f, initials = [x for _, x in rows], [x for x, _ in rows]
    counts = (f.count(BLANK), f.count(DUPLICATE), f.count(TRUNCATED), _breaks(initials))
    return (key, part, seq, *counts, initials[0], initials[-1], [dict(zip(("a", "b", "cost", "audit"), p)) for p in passes])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_PIECES = pa.schema([("key", pa.string()), ("part", pa.int32()), *[(c, pa.int64()) for c in ("seq", "n_blank", "n_duplicate", "n_truncated", "n_illegal")], ("head", pa.string()), ("tail", pa.string()),
                     ("passes", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])


def pieces(scratch: common.Scratch, lattice: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Lattice rows -> solved segments; the sort is over all tasks, so a long conversation is many tasks' work."""
    n = common.tasks(lattice.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        key, total, rows, seen = None, 0, [], 0
        for b in batches:
            out = []
            for k, role, fault, size in zip(*(b.column(c).to_pylist() for c in ("key", "role", "fault", "n_rows"))):
                if k != key or len(rows) == segment:
                    if rows:
                        out.append(_piece(key, part, seq, rows, len(rows) == total))
                        seq += 1
                    key, total, rows = k, size, []
                rows.append((role[:1], fault))
            yield _table(out, _PIECES)
        if rows:
            yield _table([_piece(key, part, seq, rows, len(rows) == total)], _PIECES)

    order = ["key", "turn", "role", "sha", "k"]
    d = lattice.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return scratch.table(d.select("key", "role", "fault", "n_rows").mapInArrow(run, PIECES), "pieces")


def _text(chain: tuple | None) -> Iterator[tuple[str, tuple]]:
    while chain:
        yield chain
        chain = chain[1]


def _less(x: tuple | None, y: tuple | None) -> bool:
    """Whether one chain of texts (text, rest) comes before another; shared rests aren't looked at."""
    a, b = "", ""
    while True:
        if not a and not b and x is y:
            return False
        while not a and x:
            a, x = x
        while not b and y:
            b, y = y
        if not a or not b:
            return not a and bool(b)
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            return a[:n] < b[:n]
        a, b = a[n:], b[n:]


_SOLVED = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


def solutions(scratch: common.Scratch, solved: DataFrame) -> DataFrame:
    """Segments -> (key, blank, duplicate, truncated, illegal, cost, audit): from the last segment back, the best way on from each state."""
    ends = {START: (0, None), ASSISTANT: (0, None), -1: (0, None)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best, counts, head = None, {}, [0] * 4, None

        def result() -> tuple:
            cost, chain = best[START]
            return (key, *counts, cost, "".join(s for s, _ in _text(chain)))

        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        out.append(result())
                    key, best, counts, head = r["key"], ends, [0] * 4, None
                new = {}
                for p in r["passes"]:
                    if p["b"] in best:
                        cost, chain = best[p["b"]]
                        got = (p["cost"] + cost, (p["audit"], chain))
                        have = new.get(p["a"])
                        if have is None or got[0] < have[0] or got[0] == have[0] and _less(got[1], have[1]):
                            new[p["a"]] = got
                best = new
                counts = [x + r[c] for x, c in zip(counts, ("n_blank", "n_duplicate", "n_truncated", "n_illegal"))]
                counts[3] += head is not None and _breaks([r["tail"], head])
                head = r["head"]
            yield _table(out, _SOLVED)
        if key is not None:
            yield _table([result()], _SOLVED)

    d = solved.repartition("key").sortWithinPartitions("key", F.desc("part"), F.desc("seq"))
    return scratch.table(d.mapInArrow(run, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "solutions")


_ROWS = pa.schema([("key", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def written(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """rows (key, turn, role, sha, text) and their solutions -> the repaired rows (key, place from 0, edit K, R or I, turn, role, text), in order inside a partition.

    A conversation passes through a task row by row; only its edits are held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, place = "", "", 0, START, 0
        for b in batches:
            out = []

            def put(edit: str, turn: int | None, role: str, text: str) -> None:
                nonlocal state, place
                out.append((key, place, edit, turn, role, text))  # noqa: B023
                state = KEEP[state, role[0]]
                place += 1

            def inserts() -> None:
                nonlocal at
                while audit[at : at + 1] == "I":
                    put("I", None, ROLE[NEXT[state]], "")
                    at += 1

            for k, first, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("key", "first", "turn", "role", "text"))):
                if first is not None:
                    inserts()
                    key, audit, at, state, place = k, first, 0, START, 0
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit != "D":
                    put(edit, turn, role if edit == "K" else ROLE[NEXT[state]], text)
            # What stands at the end of the last conversation's edits comes with its last row.
            if at < len(audit) and not audit[at:].strip("I"):
                inserts()
            yield _table(out, _ROWS)

    head = solved.select("key", F.col("audit").alias("first"))
    both = rows.select("key", "turn", "role", "sha", "text").unionByName(head, allowMissingColumns=True)
    d = both.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("first"), "turn", "role", "sha")
    return d.select("key", "first", "turn", "role", "text").mapInArrow(run, "key string, place long, edit string, turn long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """Repaired rows, in order inside their partition -> (key, repaired_sha256) of 'role:text' joined by line feeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            out = []
            for k, role, text in zip(*(b.column(c).to_pylist() for c in ("key", "role", "text"))):
                said = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if k != key:
                    if key is not None:
                        out.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(said)
                else:
                    h.update(b"\n" + said)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["key", "repaired_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], ["key", "repaired_sha256"])

    return repaired.mapInArrow(run, "key string, repaired_sha256 string")


def repair(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """rows (conv_id, turn, role, text; no null role or text) -> (a row a conversation with its counts, cost and edits; the repaired rows).

    Rows stand by turn, nulls first; inside a turn by role and then by the
    text's SHA-256, equal rows next to each other. A role counts by its first
    character; an empty role fits nowhere. Null conv_ids are one conversation.
    """
    common.prepare(rows.sparkSession)
    s = common.Scratch(rows.sparkSession, "conversations")
    keyed = _keyed(rows)
    lattice, gaps = faults(s, keyed)
    solved = solutions(s, pieces(s, lattice, segment))
    return solved.join(gaps, "key"), written(keyed, solved)


def report(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Damages and repairs; a row for each original conv_id, null included, with gaps, counts, cost, audit and repaired_sha256.

    Conversations of which nothing is left have zeros, no edits and the hash
    of nothing. An empty table gives no rows; further columns are ignored,
    whatever their names.
    """
    summary, rows = repair(damage(conversations), segment)
    all_ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    out = all_ids.join(summary, "key", "left").join(digests(rows), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "conversations"))


#: CRC-32 by table; the repair as a plain table from the last row back: of each state the least (cost, edits, repaired rows).
SQL = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i))),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS k
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, range(2) r(n) WHERE k <> 0 AND (n = 0 OR k = 3)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM damaged),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM ordered),
faulty AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    role[1] AS i, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM told),
counts AS (
  SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
best AS (
  SELECT conv_id, n AS pos, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS v0, {'c': 1000000000, 'a': '', 'r': []::VARCHAR[]} AS v1, {'c': 6, 'a': 'I', 'r': []::VARCHAR[]} AS v2, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS v3 FROM counts
  WHERE false
  UNION ALL
  SELECT conv_id, n, {'c': 0, 'a': '', 'r': []::VARCHAR[]}, {'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}, {'c': 3, 'a': 'I', 'r': ['assistant:']}, {'c': 0, 'a': '', 'r': []::VARCHAR[]} FROM counts
  UNION ALL
  SELECT conv_id, pos - 1, list_min([g0, {'c': g2.c + 3, 'a': 'I' || g2.a, 'r': list_prepend('user:', g2.r)}, {'c': g3.c + 6, 'a': 'II' || g3.a, 'r': list_concat(['user:', 'assistant:'], g3.r)}]),
    list_min([g1, {'c': g2.c + 3, 'a': 'I' || g2.a, 'r': list_prepend('user:', g2.r)}, {'c': g3.c + 6, 'a': 'II' || g3.a, 'r': list_concat(['user:', 'assistant:'], g3.r)}]),
    list_min([g2, {'c': g3.c + 3, 'a': 'I' || g3.a, 'r': list_prepend('assistant:', g3.r)}]), list_min([g3, {'c': g2.c + 3, 'a': 'I' || g2.a, 'r': list_prepend('user:', g2.r)}])
  FROM (
    SELECT conv_id, pos,
      list_min([{'c': v0.c + 4, 'a': 'D' || v0.a, 'r': v0.r}, {'c': v1.c + extra + CASE WHEN i = 's' THEN 0 ELSE 1000000000 END, 'a': 'K' || v1.a, 'r': list_prepend(kept, v1.r)},
        {'c': v2.c + extra + CASE WHEN i = 'u' THEN 0 ELSE 3 END, 'a': CASE WHEN i = 'u' THEN 'K' ELSE 'R' END || v2.a, 'r': list_prepend(CASE WHEN i = 'u' THEN kept ELSE 'user:' || text END, v2.r)}]) AS g0,
      list_min([{'c': v1.c + 4, 'a': 'D' || v1.a, 'r': v1.r}, {'c': v2.c + extra + CASE WHEN i = 'u' THEN 0 ELSE 3 END, 'a': CASE WHEN i = 'u' THEN 'K' ELSE 'R' END || v2.a, 'r': list_prepend(CASE WHEN i = 'u' THEN kept ELSE 'user:' || text END, v2.r)}]) AS g1,
      list_min([{'c': v2.c + 4, 'a': 'D' || v2.a, 'r': v2.r}, {'c': v3.c + extra + CASE WHEN i = 'a' THEN 0 ELSE 3 END, 'a': CASE WHEN i = 'a' THEN 'K' ELSE 'R' END || v3.a, 'r': list_prepend(CASE WHEN i = 'a' THEN kept ELSE 'assistant:' || text END, v3.r)}]) AS g2,
      list_min([{'c': v3.c + 4, 'a': 'D' || v3.a, 'r': v3.r}, {'c': v2.c + extra + CASE WHEN i = 'u' THEN 0 ELSE 3 END, 'a': CASE WHEN i = 'u' THEN 'K' ELSE 'R' END || v2.a, 'r': list_prepend(CASE WHEN i = 'u' THEN kept ELSE 'user:' || text END, v2.r)}]) AS g3
    FROM (SELECT b.*, f.i, f.text, f.role || ':' || f.text AS kept, CASE f.fault WHEN '' THEN 0 WHEN 'truncated' THEN 3 ELSE 1000000000 END AS extra FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos))),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.r, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id AND best.pos = 0
"""
