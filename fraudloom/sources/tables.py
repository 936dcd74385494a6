"""Loaders and the canonical views over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minor(c: str) -> F.Column:
    return F.round(F.col(c) * 100).cast("long")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card transactions from events; see FIXTURES.md section 2."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = load(spark, sf_dir, "events").withColumn("k", k)
    bin_ = (F.lit(400000) + F.col("user_id") % 10).cast("string")
    flag = lambda m: F.when(F.col("k") % m == 0, F.lit(False)).when(F.col("k") % m == 1, F.lit(None).cast("boolean")).otherwise(F.lit(True))
    geo = F.col("k") % 5 != 0
    return e.select(
        F.col("event_id").alias("txn_id"), F.col("ts").alias("occurred_at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "k",
        minor("value").alias("amount_minor"), F.lit("USD").alias("currency"), bin_.alias("bin"),
        F.concat(bin_, F.lit("****"), F.right(F.lpad(F.col("user_id").cast("string"), 10, "0"), F.lit(4))).alias("card_token"),
        F.concat(F.lit("dev-"), F.col("k") % 20).alias("device"), F.concat(F.lit("10.0.0."), F.col("k")).alias("ip"), F.concat(F.lit("mrc-"), F.col("k") % 10).alias("merchant"),
        F.when(F.col("k") % 10 == 7, 7995).when(F.col("k") % 10 == 6, 6051).when(F.col("k") % 10 == 4, 4829).when(F.col("k") % 10 == 2, 6211).otherwise(5411).alias("mcc"),
        flag(7).alias("avs_match"), flag(11).alias("cvv_match"), (F.col("event_type") == "error").alias("declined"),
        F.when(geo, ((F.col("k") * 37) % 121 - 60).cast("double")).alias("lat"), F.when(geo, ((F.col("k") * 53) % 301 - 150).cast("double")).alias("lon"),
        F.lit(None).cast("string").alias("counterparty"))


def p2p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn(spark, sf_dir).select(F.col("txn_id").alias("seq"), F.col("user_id").alias("payer"), F.col("k").alias("payee"), "amount_minor", "us")


def edges(spark: SparkSession, sf_dir: str, least: int | None = None) -> DataFrame:
    """Every transfer; with `least` those of that amount or more."""
    t = txn(spark, sf_dir)
    return (t if least is None else t.filter(F.col("amount_minor") >= least)).select(
        F.concat(F.lit("n"), F.col("user_id")).alias("src"), F.concat(F.lit("n"), F.col("k")).alias("dst"), "amount_minor", F.col("us").alias("time"), F.col("txn_id").alias("seq"))


def aml(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("acct"), F.col("o_orderkey").alias("seq"), minor("o_totalprice").alias("amount_minor"),
                    F.when(F.col("o_orderstatus") == "P", "out").otherwise("in").alias("direction"), F.concat(F.lit("cp-"), F.col("o_orderkey") % 3).alias("counterparty"),
                    F.concat(F.lit("g"), F.col("o_orderkey") % 5).alias("geography"), F.col("o_orderdate").alias("occurred_at"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions."""
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("txid")).agg(
        F.sort_array(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey")))).alias("inputs"),
        F.sort_array(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("l_suppkey")).alias("address"), minor("l_extendedprice").alias("value")))).alias("outputs"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a part name, its attributes the smallest ones."""
    p = load(spark, sf_dir, "part")
    return p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("dob"), F.min("p_brand").alias("nationality"), F.min(F.col("p_size").cast("string")).alias("national_id")).withColumn("subject_id", F.concat(F.lit("s-"), F.col("name")))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").filter("p_partkey % 7 = 0")
    kind = F.when(F.col("p_partkey") % 3 == 0, "OFAC_SDN").when(F.col("p_partkey") % 3 == 1, "PEP").otherwise("ADVERSE_MEDIA")
    return p.select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("name"), F.col("p_type").alias("dob"), F.col("p_brand").alias("nationality"), F.lit(None).cast("string").alias("national_id"), kind.alias("list"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    top = d.agg(F.max("n_chars").alias("top"))
    return d.crossJoin(F.broadcast(top)).select("doc_id", F.col("toxic").cast("int").alias("y"), (F.col("n_chars") / F.col("top")).alias("score"))
