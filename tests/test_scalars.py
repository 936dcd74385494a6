import math

import pytest
from pyspark.sql import functions as F

from fraudloom.functions import scalars as S
from fraudloom.functions import udfs


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("major,minor,ccy,want", [(12, 34, "USD", 1234), (-12, 34, "USD", -1234), (5, 100, "USD", None), (100, 0, "JPY", 100), (1, 1, "JPY", None), (2**62, 0, "EUR", None), (1, 1, "CHF", None)])
def test_money(spark, major, minor, ccy, want):
    assert one(spark, S.money(F.lit(major).cast("long"), F.lit(minor).cast("long"), F.lit(ccy))) == want


@pytest.mark.parametrize("minor,ccy,want", [(-1234, "USD", "-12.34 USD"), (100, "JPY", "100 JPY"), (5, "GBP", "0.05 GBP"), (0, "JPY", "0 JPY"), (-(2**63), "USD", "-92233720368547758.08 USD")])
def test_money_text(spark, minor, ccy, want):
    assert one(spark, S.money_text(F.lit(minor).cast("long"), F.lit(ccy))) == want


def test_money_arithmetic(spark):
    big = F.lit(2**63 - 1).cast("long")
    assert one(spark, S.money_add(big, F.lit("USD"), F.lit(1), F.lit("USD"))) is None
    assert one(spark, S.money_add(F.lit(1), F.lit("USD"), F.lit(1), F.lit("EUR"))) is None
    assert one(spark, S.money_sub(F.lit(5), F.lit("USD"), F.lit(7), F.lit("USD"))) == -2


def test_pan(spark):
    for pan, b, t in (("4111110000001234", "411111", "411111****1234"), ("12345", None, "****2345"), ("12", None, "****12")):
        r = spark.range(1).select(S.pan_bin(F.lit(pan)).alias("b"), S.pan_token(F.lit(pan)).alias("t")).first()
        assert (r.b, r.t) == (b, t)


def test_haversine(spark):
    km = one(spark, S.haversine_km(*[F.lit(x) for x in (-36.85, 174.76, 36.85, -5.24)]))
    assert math.isfinite(km) and km > 18_000
    assert one(spark, S.haversine_km(*[F.lit(x) for x in (40.71, -74.0, 40.71, -74.0)])) == 0


def test_scores_and_names(spark):
    for v, want in ((0.5, 0.5), (1.0, 1.0), (1.1, None), (-0.1, None), (float("nan"), None), (float("inf"), None)):
        assert one(spark, S.valid_score(F.lit(v))) == want
    for n, want in (("Robert", "R163"), ("O'Neil", "O540"), ("", "0000"), ("123", "0000"), ("Ashcraft", "A261")):
        assert one(spark, S.soundex(F.lit(n))) == want
    assert one(spark, S.person_name(F.lit("  Ann \t Lee "))) == "ann lee"
    assert one(spark, S.identifier(F.lit("phone"), F.lit("+1 (2)-٣4"))) == "124"


def test_jaro_winkler():
    assert udfs.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert udfs.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert udfs.jaro_winkler("abc", "xyz") == 0.0
    assert udfs.jaro_winkler("", "") == 1.0 and udfs.jaro_winkler("", "a") == 0.0


def test_hashes(spark):
    # SplitMix64 of seed 0, from the generator's published description.
    from fraudloom.sources.simulator import draw

    assert [draw(0, k) for k in range(3)] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]
    assert udfs.fnv1a("") == 0xCBF29CE484222325 and udfs.fnv1a("a") == 0xAF63DC4C8601EC8C
    udfs.register(spark)
    r = spark.sql("SELECT jaro_winkler('martha', 'marhta') AS j, fnv1a_fraction('a') AS f, splitmix64(0, 0) AS s, haversine_km(0, 0, 0, 1) AS h").first()
    assert (r.s, r.f) == ("e220a8397b1dcdaf", (0xAF63DC4C8601EC8C % 10000) / 10000) and r.h == pytest.approx(111.19, abs=0.01)
