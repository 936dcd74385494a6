import pytest
from pyspark.sql import functions as F

from fraudloom.functions import strict_json as J
from fraudloom.operators import windows as W
from fraudloom.sources import tables as T
from fraudloom.sources.stores import AppendStore, DuplicateKey, LatestStore


def test_append_store(spark, tmp_path):
    s = AppendStore(spark, str(tmp_path / "a"), "k")
    s.append(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"))
    for rows in ([(2, "z"), (3, "z")], [(4, "a"), (4, "b")]):
        with pytest.raises(DuplicateKey):
            s.append(spark.createDataFrame(rows, "k int, v string"))
    s.append(spark.createDataFrame([(3, "z")], "k int, v string"))
    assert sorted((r.k, r.v) for r in s.read().collect()) == [(1, "x"), (2, "y"), (3, "z")]


def test_latest_store(spark, tmp_path):
    s = LatestStore(spark, str(tmp_path / "l"), "k", "t")
    with pytest.raises(LookupError):
        s.get(spark.createDataFrame([("a",)], "k string"))
    s.put(spark.createDataFrame([("a", 1, 10), ("b", 5, 50)], "k string, t int, v int"), 0)
    s.put(spark.createDataFrame([("a", 2, 20), ("b", 4, 40)], "k string, t int, v int"), 1)
    got = {r.k: (r.v, r.found) for r in s.get(spark.createDataFrame([("a",), ("b",), ("c",)], "k string")).collect()}
    assert got == {"a": (20, True), "b": (50, True), "c": (None, False)}


def test_strict_json(spark, sf_dir):
    d = W.six_windows(T.txn(spark, sf_dir).filter("txn_id < 50"), "card_token").withColumn("m", W.window_map())
    back = d.withColumn("b", J.decode(J.encode(F.col("m")))).select(F.col("m")["7d"].alias("a"), F.col("b")["7d"].alias("b")).collect()
    assert all(tuple(map(int, r.a)) == tuple(map(int, r.b)) for r in back)
    for bad in ('{"5m": {"count": 1}}', '{"5m": null}', "{"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "t string").select(J.decode(F.col("t")).alias("x")).collect()
    assert spark.createDataFrame([(None,)], "t string").select(J.decode(F.col("t")).alias("x")).first().x is None


def test_sar_settings_are_read_whole_or_refused(tmp_path):
    import json
    from dataclasses import asdict

    from fraudloom.config import ConfigError, Sar, load_sar

    given = {k: v + 1 if isinstance(v, int) and not isinstance(v, bool) else v for k, v in asdict(Sar()).items()}
    (tmp_path / "sar.json").write_text(json.dumps(given))
    got = load_sar(str(tmp_path / "sar.json"))
    assert asdict(got) == given != asdict(Sar())
    first = next(iter(given))
    (tmp_path / "less.json").write_text(json.dumps({k: v for k, v in given.items() if k != first}))
    with pytest.raises(ConfigError, match=first):
        load_sar(str(tmp_path / "less.json"))
