"""Column functions: money, card numbers, geography, scores, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# Minor-unit exponents of the currencies.
EXPONENT = {"USD": 2, "EUR": 2, "GBP": 2, "JPY": 0}


def exponent(currency: Column) -> Column:
    out = F.lit(None).cast("int")
    for c, e in EXPONENT.items():
        out = F.when(currency == c, F.lit(e)).otherwise(out)
    return out


def money(major: Column, minor: Column, currency: Column) -> Column:
    """Minor units of major.minor with the sign of major; null if minor doesn't fit the currency or on overflow."""
    scale = F.pow(F.lit(10), exponent(currency)).cast("long")
    part = F.when(major < 0, -minor).otherwise(minor)
    return F.when((minor >= 0) & (minor < scale), F.try_add(F.try_multiply(major.cast("long"), scale), part.cast("long")))


def money_add(a: Column, a_ccy: Column, b: Column, b_ccy: Column) -> Column:
    """Null on overflow or if the currencies differ."""
    return F.when(a_ccy == b_ccy, F.try_add(a, b))


def money_sub(a: Column, a_ccy: Column, b: Column, b_ccy: Column) -> Column:
    return F.when(a_ccy == b_ccy, F.try_subtract(a, b))


def money_text(minor: Column, currency: Column) -> Column:
    """-12.34 USD, 100 JPY; exact over the whole range of minor units."""
    e = exponent(currency)
    wide = minor.cast("decimal(20,0)")
    digits = F.lpad(F.abs(wide).cast("string"), 20, "0")
    whole = F.when(e == 0, digits).otherwise(F.substring(digits, 1, 18))
    whole = F.regexp_replace(whole, "^0+(?=.)", "")
    cents = F.when(e == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.substring(digits, 19, 2)))
    return F.concat(F.when(wide < 0, F.lit("-")).otherwise(F.lit("")), whole, cents, F.lit(" "), currency)


def pan_bin(pan: Column) -> Column:
    return F.when(F.length(pan) >= 6, F.substring(pan, 1, 6))


def pan_last4(pan: Column) -> Column:
    return F.right(pan, F.lit(4))


def pan_token(pan: Column) -> Column:
    """<bin>****<last4>, without the bin for short numbers."""
    return F.concat(F.coalesce(pan_bin(pan), F.lit("")), F.lit("****"), pan_last4(pan))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sqrt(a))))


def valid_score(score: Column) -> Column:
    """The score if it is finite and in [0, 1], else null."""
    return F.when(~F.isnan(score) & score.between(0.0, 1.0), score)


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def identifier(kind: Column, value: Column) -> Column:
    """Phones keep their ASCII digits, everything else is trimmed and lower-cased."""
    return F.when(kind == "phone", F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(F.trim(value)))


def person_name(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def soundex(name: Column) -> Column:
    """Soundex of the name's ASCII letters taken together; 0000 without any."""
    letters = F.regexp_replace(name, "[^A-Za-z]", "")
    return F.when(letters == "", F.lit("0000")).otherwise(F.soundex(letters))


def risk_band(score: Column) -> Column:
    return F.when(score < 0.3, "LOW").when(score < 0.6, "MEDIUM").when(score < 0.85, "HIGH").otherwise("VERY_HIGH")


def risk_tier(score: Column) -> Column:
    """The dashboard's name of the band."""
    return F.when(score >= 0.85, "VERY HIGH").when(score >= 0.6, "HIGH").when(score >= 0.3, "MEDIUM").otherwise("LOW")


def window_mean(count: Column, total: Column) -> Column:
    return F.when(count > 0, total.cast("double") / count.cast("double")).otherwise(0.0)


def window_std(count: Column, total: Column, squares: Column) -> Column:
    """Population deviation from moments, never the root of a negative number; 0 below two events."""
    n = count.cast("double")
    mean = total.cast("double") / n
    return F.when(count >= 2, F.sqrt(F.greatest(F.lit(0.0), squares.cast("double") / n - mean * mean))).otherwise(0.0)

