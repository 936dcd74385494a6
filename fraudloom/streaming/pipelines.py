"""Structured Streaming twins: decisions in micro-batches, stores, hop windows, running metrics; windows and verdicts by keyed state and joins of streams are modules of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fraudloom.config import Reloader, Rules
from fraudloom.operators import decide as D
from fraudloom.operators import rules as R
from fraudloom.operators.windows import fan_out
from fraudloom.streaming.joins import poisoning
from fraudloom.streaming.latest import latest, upsert_latest
from fraudloom.streaming.state import OUT, entity_windows, replayed

__all__ = ["OUT", "entity_windows", "latest", "poisoning", "replayed", "upsert_latest"]


def source(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options: str) -> DataFrame:
    """A file, rate or broker source; brokers need their connector on the class path."""
    r = spark.readStream.format(fmt)
    if fmt in ("parquet", "json", "csv", "orc", "text"):
        r = r.schema(schema)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(path) if path else r.load()


def keyed(txn: DataFrame) -> DataFrame:
    return fan_out(txn).withColumnRenamed("txn_id", "seq")


def hop_windows(events: DataFrame, key: str = "user_id", ts: str = "ts", size: str = "5 minutes", hop: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Hop-aligned counts and sums: built-in state, cheaper than the exact windows, but aligned."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, hop), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def tumbling_windows(events: DataFrame, key: str = "user_id", ts: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def deduplicated(requests: DataFrame, key: str = "idempotency_key", ts: str = "occurred_at", late: str = "1 hour") -> DataFrame:
    """First arrival of each key within the watermark, retries dropped; replayed() answers them. Empty keys are rejected."""
    return requests.filter(F.col(key) != "").withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def append_audit(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: appends each batch once, in a folder of its own; nothing is ever updated or deleted."""

    def write(batch: DataFrame, n: int) -> None:
        D.audit_records(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


class History:
    """What the velocity rules need of earlier micro-batches, in folders under `path`.

    Each batch writes its slim events (events/batch=n) and their sums by card
    (cards/batch=n), so nothing old is rewritten. Batches whose newest event
    is older than the longest window are read through their sums only. The
    sums are merged into one table (cards/upto=n) every MERGE batches.
    Repeating a batch after a failure overwrites its own folders and reads
    only those before it.
    """

    SLIM = ["txn_id", "us", "amount_minor", "card_token", "bin", "device", "declined", "lat", "lon"]
    MERGE = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folders(self, kind: str, prefix: str) -> dict[int, str]:
        hp = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = hp.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(hp)] if fs.exists(hp) else []
        done = [x for x in names if x.startswith(prefix) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{x}/_SUCCESS"))]
        return {int(x[len(prefix) :]): f"{self.path}/{kind}/{x}" for x in done}

    def _newest(self, folder: str) -> int:
        return self.spark.read.parquet(folder).agg(F.max("us")).first()[0] or 0

    def before(self, n: int, since: int) -> tuple[DataFrame | None, DataFrame | None]:
        """(events of earlier batches that reach `since`, sums by card of all the others)."""
        events = {k: p for k, p in self._folders("events", "batch=").items() if k < n}
        live, k = [], -1
        for m in sorted(events, reverse=True):  # from the last batch back to the first that is too old
            if self._newest(events[m]) < since:
                k = m
                break
            live.append(events[m])
        cards = {m: p for m, p in self._folders("cards", "batch=").items() if m <= k}
        merged = {m: p for m, p in self._folders("cards", "upto=").items() if m <= k}
        top = max(merged, default=-1)
        parts = ([merged[top]] if merged else []) + [p for m, p in cards.items() if m > top]
        read = lambda p: self.spark.read.parquet(*p) if p else None
        sums = read(parts)
        if sums is not None and len(parts) > self.MERGE:
            self._summed(sums).write.mode("overwrite").parquet(f"{self.path}/cards/upto={k}")
            sums = read([f"{self.path}/cards/upto={k}"])
        return read(live), None if sums is None else self._summed(sums)

    @staticmethod
    def _summed(sums: DataFrame) -> DataFrame:
        return sums.groupBy("card_token").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max_by("place", F.struct("place.us", "seq")).alias("place"), F.max("seq").alias("seq"))

    def add(self, batch: DataFrame, n: int) -> None:
        slim = batch.select(*self.SLIM)
        slim.write.mode("overwrite").parquet(f"{self.path}/events/batch={n}")
        slim = self.spark.read.parquet(f"{self.path}/events/batch={n}").filter("card_token is not null")
        place = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon", "us"))
        seen = F.when(place.isNotNull(), F.struct("us", "txn_id"))
        sums = slim.groupBy("card_token").agg(F.count("amount_minor").alias("n"), F.sum("amount_minor").alias("total"), F.max_by(place, seen).alias("place"), F.max(F.when(place.isNotNull(), F.col("txn_id"))).alias("seq"))
        sums.write.mode("overwrite").parquet(f"{self.path}/cards/batch={n}")

    def evaluate(self, batch: DataFrame, n: int, rules: Rules) -> DataFrame:
        """The batch's rows with hits, as if all events had come in one table, in the order of (us, txn_id)."""
        reach = max(rules.card_testing.window_secs, rules.bin_attack.window_secs, rules.decline_retry.window_secs) * 1_000_000
        since = (batch.agg(F.min("us")).first()[0] or 0) - reach
        events, sums = self.before(n, since)
        rows = batch.withColumn("_old", F.lit(False))
        if events is not None:
            rows = rows.unionByName(events.select(*self.SLIM).withColumn("_old", F.lit(True)), allowMissingColumns=True)
        if sums is not None:
            rows = rows.join(sums.select("card_token", F.struct("n", "total", "place").alias("card_before")), "card_token", "left")
        out = R.evaluate(rows, rules).filter("not _old")
        return out.select(*batch.columns, *[c for c in out.columns if c not in batch.columns and c not in ("_old", "card_before")])


def decisions(txn: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, rules: Rules | Reloader = Rules(), history: str | None = None) -> StreamingQuery:
    """Rules-only decisions per micro-batch; a Reloader is asked once a batch and its version is on every row.

    Velocity rules see all events so far, kept under `history` (by default in
    the checkpoint's folder), so results don't depend on how the input is cut
    while it comes in the order of time.
    """
    past = History(txn.sparkSession, history or f"{checkpoint}/history")

    def run(batch: DataFrame, n: int) -> None:
        r = rules.current() if isinstance(rules, Reloader) else rules
        sink(D.decide_rules_only(past.evaluate(batch, n, r)), n)
        past.add(batch, n)

    return txn.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_metrics(decided: DataFrame) -> DataFrame:
    """Counts since the start, complete mode: processed, approved, declined, alerts, decline_rate."""
    g = decided.groupBy().agg(F.count("*").alias("processed"), F.count_if(F.col("action") == "APPROVE").alias("approved"), F.count_if(F.col("action") == "DECLINE").alias("declined"), F.count_if(F.size("reason_codes") > 0).alias("alerts"))
    return g.withColumn("decline_rate", F.col("declined") / F.col("processed"))


def with_freshness(txn: DataFrame, features: DataFrame, key: str, bound_us: int) -> DataFrame:
    """Left join with the feature table; feature_status MISS without a row, TIMED_OUT if it is older than the bound, else OK."""
    f = features.withColumnRenamed("us", "feature_us")
    j = txn.join(f, key, "left")
    return j.withColumn("feature_status", F.when(F.col("feature_us").isNull(), "MISS").when(F.col("us") - F.col("feature_us") > bound_us, "TIMED_OUT").otherwise("OK"))
