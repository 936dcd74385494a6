import hashlib
import random
import zlib
from collections import Counter

import pytest

from fraudloom.llm import conversations as C

BLANK = " \t\n\x0b\f\r"


def slow(rows, start="", done=""):
    """(cost, audit, repaired) of (role, text, fault) by a plain search over all edits that cost the least so far."""
    import heapq

    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, start, ())], {}
    best = None
    while heap:
        cost, audit, k, last, out = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if (k, last) in seen and seen[k, last] < cost:
            continue
        seen[k, last] = cost
        if k == len(rows) and last in ("", "a"):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, out)
            continue
        for role in ("user", "assistant"):
            if role[0] in follow[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", k, role[0], (*out, f"{role}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, last, out))
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[0] in follow[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, role[0], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if new[0] in follow[last]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", k + 1, new[0], (*out, f"{new}:{text}")))
    return best


def brute(table):
    """table of (conv_id, turn, role, text) -> the rows of the report."""
    out = []
    for conv in dict.fromkeys(r[0] for r in table):
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if k == 1:
                text = ""
            if k == 2:
                text = text.replace(".", "").replace("!", "").replace("?", "")
            if k == 4:
                role = "user"
            rows += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faulty, seen = [], set()
        for _, role, text in rows:
            t = text.rstrip(BLANK)
            fault = "blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, *_ in rows if t is not None]
        n = Counter(f for *_, f in faulty)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, said = slow(faulty)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def rows_of(df):
    return [(r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()]


def made(seed, conversations=40, most=9):
    rng = random.Random(seed)
    out = []
    for c in range(conversations):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "aide"])
            text = rng.choice(["Yes.", "No!", "So it is.", "cut off", None, "", " \n", "Why? \t", "…", "a.b "])
            out.append((c if c else None, rng.choice([t, t, t, None, 2 * t]), role, text))
    return out + rng.sample(out, 5)


@pytest.mark.parametrize("seed,segment", [(1, 64), (2, 1), (3, 2), (4, 3)])
def test_equals_search(spark, seed, segment):
    table = made(seed)
    got = rows_of(C.report(spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5), segment))
    assert sorted(got, key=str) == sorted(brute(table), key=str)


def test_lattice_alone():
    rng = random.Random(7)
    for _ in range(400):
        rows = [(rng.choice("suaax"), rng.choice([C.FINE, C.FINE, C.TRUNCATED, C.BLANK, C.DUPLICATE])) for _ in range(rng.randint(0, 9))]
        names = {C.FINE: "", C.TRUNCATED: "truncated", C.BLANK: "blank", C.DUPLICATE: "duplicate"}
        for state, last in enumerate(["", "s", "u", "a"]):
            got = C.Lattice(rows, (C.START, C.ASSISTANT)).solve(state)
            if state == C.START:
                assert got == slow([(r, "t", names[f]) for r, f in rows], last)[:2]
            else:
                assert got is not None


def test_segments_agree_on_a_long_conversation(spark):
    rng = random.Random(3)
    table = [(c, t, rng.choice(["user", "assistant", "assistant", "user", "system"]), rng.choice(["Yes.", "No!", f"It is {t}.", f"cut {t}"])) for c in (1, 2) for t in range(700)]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    a, b, c = (sorted(rows_of(C.report(df.repartition(n), s))) for n, s in ((3, 64), (1, 7), (4, 100_000)))
    assert a == b == c and a[0][6] > 500


def test_long_chains_compare_by_their_first_difference():
    end = ("KK", None)
    assert C._less(("K", ("DK", end)), ("KR", end)) and not C._less(("KR", end), ("K", ("DK", end)))
    assert not C._less(("KD", end), ("K", ("D", end))) and C._less(("D", None), ("DI", None)) and not C._less(None, None)


def test_empty_tables_clashing_names_and_long_texts(spark):
    assert C.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    table = [(5, 0, "user", "x" * 2_000_000 + "."), (5, 1, "assistant", " " * 500_000 + "y."), (6, None, None, None)]
    d = spark.createDataFrame([(*r, 1, "z") for r in table], "conv_id long, turn long, role string, text string, key int, `a.b` string")
    assert sorted(rows_of(C.report(d))) == sorted(brute(table))


def test_repaired_rows_alternate(spark, sf_dir):
    summary, rows = C.repair(C.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    by = {}
    for r in rows.collect():
        by.setdefault(r.key, []).append(r)
    for r in summary.collect():
        kept = sorted(by.get(r.key, []), key=lambda x: x.place)
        said = "".join(x.role[0] for x in kept)
        assert said.lstrip("s").replace("ua", "") == "" and len(said) - len(said.lstrip("s")) <= 1
        assert "".join(x.edit for x in kept) == r.audit.replace("D", "")


def test_hot_conversation_of_equal_rows(spark):
    table = [(1, 0, "user", "Same.")] * 3000 + [(1, 9, "assistant", "Other.")]
    r = C.report(spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(8)).first()
    assert (r.duplicate, r.cost, r.audit) == (2999, 4 * 2999 + 3, "K" + "D" * 2999 + "R")  # turn 9 is made a user's
