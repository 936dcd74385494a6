"""Decision requests: wire schema and normalisation into transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudloom.functions import scalars as S

REQUEST = T.StructType([
    T.StructField("idempotency_key", T.StringType()), T.StructField("transaction_id", T.StringType()), T.StructField("amount_minor_units", T.LongType()), T.StructField("currency", T.StringType()),
    T.StructField("vertical", T.StringType()), T.StructField("channel", T.StringType()), T.StructField("pan", T.StringType()), T.StructField("merchant", T.StringType()), T.StructField("device", T.StringType()),
    T.StructField("occurred_at_unix_ms", T.LongType()), T.StructField("mcc", T.IntegerType()), T.StructField("avs_match", T.BooleanType()), T.StructField("cvv_match", T.BooleanType()), T.StructField("ip", T.StringType()),
    T.StructField("geo_country", T.StringType()), T.StructField("geo_lat", T.DoubleType()), T.StructField("geo_lon", T.DoubleType()),
])
VERTICALS = ("CARD", "P2P", "CRYPTO")
CHANNELS = ("CARD_PRESENT", "CARD_NOT_PRESENT", "P2P_PUSH", "CRYPTO_WITHDRAWAL", "CRYPTO_DEPOSIT")
IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){4}$"
IPV6 = r"^(?=.*:.*:)[0-9A-Fa-f:.]+$"
MAX_MS = 253_402_300_799_999


def normalise(requests: DataFrame) -> DataFrame:
    """Requests -> transactions: unknown enums take their defaults, empty texts and zeros are absent, a bad time is the epoch, a bad IP is null.

    Accounts and counterparties are never set by this path. The raw card
    number doesn't leave: bin and token do.
    """
    text = lambda c: F.expr(f"nullif({c}, '')")
    ms = F.when(F.col("occurred_at_unix_ms").between(-MAX_MS, MAX_MS), F.col("occurred_at_unix_ms")).otherwise(F.lit(0).cast("long"))
    pan = text("pan")
    geo = text("geo_country").isNotNull()
    return requests.select(
        "idempotency_key", F.col("transaction_id").alias("txn_id"), F.timestamp_millis(ms).alias("occurred_at"), (ms * 1000).alias("us"), F.col("amount_minor_units").alias("amount_minor"),
        F.when(F.col("currency").isin(*S.EXPONENT), F.col("currency")).otherwise("USD").alias("currency"), F.when(F.col("vertical").isin(*VERTICALS), F.col("vertical")).otherwise("CARD").alias("vertical"),
        F.when(F.col("channel").isin(*CHANNELS), F.col("channel")).otherwise("CARD_NOT_PRESENT").alias("channel"), S.pan_bin(pan).alias("bin"), S.pan_token(pan).alias("card_token"),
        F.lit(None).cast("string").alias("account"), text("device").alias("device"), F.when(text("ip").rlike(IPV4) | text("ip").rlike(IPV6), F.lower("ip")).alias("ip"), text("merchant").alias("merchant"),
        F.lit(None).cast("string").alias("counterparty"), F.expr("nullif(mcc, 0)").alias("mcc"), "avs_match", "cvv_match", F.when(geo, F.col("geo_country")).alias("country"), F.when(geo, F.col("geo_lat")).alias("lat"), F.when(geo, F.col("geo_lon")).alias("lon"))
