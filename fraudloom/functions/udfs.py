"""Functions Spark lacks, as Arrow-batched UDFs: Jaro-Winkler, FNV-1a, SplitMix64; and SQL registration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAMMA = np.uint64(0x9E3779B97F4A7C15)
FNV_BASIS = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3


def jaro_winkler(a: str, b: str) -> float:
    """Prefix boost of 0.1 for up to four characters, at similarities above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    half = sum(x != y for x, y in zip(left, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def mix64(z: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over uint64."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def splitmix_draw(seed: int, k: np.ndarray) -> np.ndarray:
    """Draw number k (from 0) of the stream with this seed: the generator is counter-based."""
    with np.errstate(over="ignore"):
        return mix64(np.uint64(seed) + (k.astype(np.uint64) + np.uint64(1)) * GAMMA)


def fnv1a(text: str, salt: int = 0) -> int:
    h = FNV_BASIS ^ salt
    for b in text.encode():
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def sample_fraction(text: str, salt: int = 0) -> float:
    return fnv1a(text, salt) % 10_000 / 10_000


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def fraction_udf(salt: int):
    @F.pandas_udf(T.DoubleType())
    def fraction(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else sample_fraction(x, salt)).astype("float64")

    return fraction


def below_udf(seed: int):
    """(draw number, n) -> that draw modulo n."""

    @F.pandas_udf(T.LongType())
    def below(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series((splitmix_draw(seed, k.to_numpy()) % n.to_numpy().astype(np.uint64)).astype(np.int64))

    return below


def register(spark: SparkSession) -> None:
    """SQL names: jaro_winkler(a, b), fnv1a_fraction(id), splitmix64(seed, k) as hexadecimal, haversine_km(lat1, lon1, lat2, lon2)."""

    @F.pandas_udf(T.StringType())
    def splitmix64(seed: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([f"{int(splitmix_draw(int(s), np.array([x]))[0]):016x}" for s, x in zip(seed, k)])

    spark.udf.register("jaro_winkler", jaro_winkler_udf)
    spark.udf.register("fnv1a_fraction", fraction_udf(0))
    spark.udf.register("splitmix64", splitmix64)
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN
        2 * 6371.0D * asin(least(1.0D, sqrt(pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))""")
