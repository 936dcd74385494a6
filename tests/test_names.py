import random
import time

import pytest
from pyspark.sql import functions as F

from fraudloom.functions.udfs import jaro_winkler
from fraudloom.operators import names as N
from fraudloom.sources import tables as T


def made(seed, n, letters="abcdeé 東"):
    rng = random.Random(seed)
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    for x in out[: n // 2]:  # near ones
        y = list(x)
        for _ in range(rng.randint(1, 2)):
            if y:
                k = rng.randrange(len(y))
                rng.choice([lambda: y.pop(k), lambda: y.insert(k, rng.choice(letters)), lambda: y.__setitem__(k, rng.choice(letters))])()
        out.append("".join(y))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("seed,threshold", [(1, 0.88), (2, 0.95), (3, 0.7), (4, 0.3)])
def test_trie_loses_nothing(seed, threshold):
    names, listed = made(seed, 120), made(seed + 10, 200)[:250] + made(seed, 120)[:40]
    tries = {}
    for x in dict.fromkeys(listed):
        tries.setdefault(len(x), []).append(x)
    tries = {k: N.NameTrie(v) for k, v in tries.items()}
    for a in names:
        got = {b: s for t in tries.values() for b, s in t.search(a, threshold)[0]}
        want = {b: jaro_winkler(a, b) for b in listed if jaro_winkler(a, b) >= threshold}
        assert got == want


@pytest.mark.parametrize("threshold,unit", [(0.88, 7), (0.88, N.UNIT), (0.5, 50)])
def test_join_equals_all_pairs(spark, threshold, unit):
    names, listed = made(5, 60), made(6, 60) + made(5, 60)[:30]
    frame = lambda rows: spark.createDataFrame([(x,) for x in [*rows, *rows[:4], None]], "name string").repartition(3)
    got = sorted((r.a, r.b, r.name_score) for r in N.similar_names(frame(names), frame(listed), threshold, unit).collect())
    assert got == sorted((a, b, jaro_winkler(a, b)) for a in set(names) for b in set(listed) if jaro_winkler(a, b) >= threshold)
    assert N.similar_names(frame([]), frame(listed), threshold).count() == 0 == N.similar_names(frame(names), frame([]), threshold).count()


def test_length_ratio_is_tight():
    r = N.length_ratio(0.88)
    assert r == pytest.approx(0.4) and N.best_score(4, 4, 10, 4) == pytest.approx(0.88) and N.best_score(39, 39, 100, 4) < 0.88


def person(rng):
    syllables = ["an", "be", "cor", "da", "el", "fin", "gu", "ha", "il", "jo", "ka", "li", "mar", "ne", "os", "pe", "ri", "sa", "to", "vi"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 3))) for _ in range(2))


def test_share_of_scored_pairs_falls_with_size():
    rng = random.Random(1)
    asked, share = [person(rng) for _ in range(60)], []
    for n in (200, 20_000):
        by = {}
        for x in {person(rng) for _ in range(n)}:
            by.setdefault(len(x), []).append(x)
        tries = {k: N.NameTrie(v) for k, v in by.items()}
        t = time.perf_counter()
        scored = sum(tries[k].search(a, 0.88)[1] for a in asked for k in tries if 0.4 <= k / len(a) <= 2.5)
        share.append(scored / (len(asked) * n))
    assert share[1] < share[0] * 1.05 and share[1] < 0.02 and time.perf_counter() - t < 60


def test_work_of_a_table(spark, sf_dir):
    s, w = T.subjects(spark, sf_dir), T.watchlist(spark, sf_dir)
    r = N.work(s.select(F.lower("name")), w.select(F.lower("name")), 0.88).first()
    assert r.names > 0 and 0 < r.scored < r.names * r.listed / 5 and r.share < 0.2
