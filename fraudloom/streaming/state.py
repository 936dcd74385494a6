"""Typed keyed state in the stream: exact sliding windows and first verdicts, as stateful processors.

State is kept in RocksDB, so a key's history lies on disk and only what a batch
touches is read. Timers of event time clear keys that have been quiet for
longer than anything can still ask for.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

from fraudloom.operators.windows import HORIZONS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An age is cut to whole seconds, so an event counts for nearly a second more.
EDGES = [s * 1_000_000 + 999_999 for s in HORIZONS.values()]
OUT = "entity string, seq bigint, us bigint, " + ", ".join(f"cnt_{h} bigint, sum_{h} bigint, sq_{h} string, dev_{h} bigint, dec_{h} bigint" for h in HORIZONS)
NAMES = [c.split()[0] for c in OUT.split(", ")]

TOTALS = ("n array<bigint>, amount array<bigint>, squares array<string>, declined array<bigint>, devices array<bigint>, "
          "head_chunk array<bigint>, head_at array<bigint>, first_chunk bigint, last_chunk bigint, last_us bigint, timer boolean")
EVENTS = "us array<bigint>, seq array<bigint>, amount array<bigint>, device array<string>, declined array<boolean>"
#: Events in a chunk of a key's history; late ones may make it longer.
CHUNK = 512


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need this store; it holds for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Key:
    """One key's windows while a batch of its events is taken in; what was touched is written back at the end."""

    def __init__(self, totals, chunks, devices):
        self.states = totals, chunks, devices
        got = totals.get()
        k = len(EDGES)
        if got is None:
            got = ([0] * k, [0] * k, ["0"] * k, [0] * k, [0] * k, [0] * k, [0] * k, 0, 0, None, False)
        self.n, self.amount, self.squares, self.declined, self.distinct, self.head_chunk, self.head_at = [list(x) for x in got[:7]]
        self.squares = [int(x) for x in self.squares]
        self.first, self.last, self.us, self.timer = got[7:]
        self.loaded: dict[int, list[list]] = {}
        self.changed: set[int] = set()
        self.counts: dict[str, list[int]] = {}

    def chunk(self, k: int) -> list[list]:
        if k not in self.loaded:
            got = self.states[1].getValue((k,))
            self.loaded[k] = [list(x) for x in got] if got else [[], [], [], [], []]
        return self.loaded[k]

    def counted(self, device: str) -> list[int]:
        if device not in self.counts:
            got = self.states[2].getValue((device,))
            self.counts[device] = list(got[0]) if got else [0] * len(EDGES)
        return self.counts[device]

    def shift(self, h: int, amount: int, device: str | None, declined: bool, by: int) -> None:
        """An event comes into (by 1) or leaves (-1) a horizon's totals."""
        self.n[h] += by
        self.amount[h] += by * amount
        self.squares[h] += by * amount * amount
        self.declined[h] += by * declined
        if device is not None:
            c = self.counted(device)
            c[h] += by
            if c[h] == (by + 1) // 2:  # the first has come or the last has gone
                self.distinct[h] += by

    def append(self, us: int, *event) -> list:
        """An event no older than all before: totals move on, each read head lets go of what is too old."""
        if len(self.chunk(self.last)[0]) >= CHUNK:
            self.last += 1
            self.loaded[self.last] = [[], [], [], [], []]
        for x, v in zip(self.chunk(self.last), (us, *event)):
            x.append(v)
        self.changed.add(self.last)
        self.us = us
        for h, edge in enumerate(EDGES):
            self.shift(h, *event[1:], 1)
            while True:
                c = self.chunk(self.head_chunk[h])
                if self.head_at[h] >= len(c[0]):
                    self.head_chunk[h], self.head_at[h] = self.head_chunk[h] + 1, 0
                elif c[0][self.head_at[h]] < us - edge:
                    self.shift(h, *(x[self.head_at[h]] for x in c[2:]), -1)
                    self.head_at[h] += 1
                else:
                    break
        return [v for h in range(len(EDGES)) for v in (self.n[h], self.amount[h], str(self.squares[h]), self.distinct[h], self.declined[h])]

    def insert(self, us: int, *event) -> list:
        """A late event: put where it belongs, counted in the totals it is young enough for; its own windows are read from the history."""
        k = self.last
        while k > self.first and self.chunk(k)[0][0] > us:
            k -= 1
        c = self.chunk(k)
        at = bisect_right(c[0], us)
        for x, v in zip(c, (us, *event)):
            x.insert(at, v)
        self.changed.add(k)
        for h, edge in enumerate(EDGES):
            place = (self.head_chunk[h], self.head_at[h])
            if us >= self.us - edge:
                self.shift(h, *event[1:], 1)
                if (k, at) < place:
                    self.head_chunk[h], self.head_at[h] = k, at
            elif k == place[0]:
                self.head_at[h] += 1
        return self.look(k, at, us)

    def look(self, k: int, at: int, us: int) -> list:
        n, amount, squares, declined, devices = ([z() for _ in EDGES] for z in (int, int, int, int, set))
        while k >= self.first:
            c = self.chunk(k)
            for j in range(at, -1, -1):
                age = us - c[0][j]
                if age > EDGES[-1]:
                    k = self.first
                    break
                for h in range(len(EDGES) - 1, -1, -1):
                    if age > EDGES[h]:
                        break
                    n[h] += 1
                    amount[h] += c[2][j]
                    squares[h] += c[2][j] ** 2
                    declined[h] += c[4][j]
                    if c[3][j] is not None:
                        devices[h].add(c[3][j])
            k -= 1
            at = len(self.chunk(k)[0]) - 1 if k >= self.first else 0
        return [v for h in range(len(EDGES)) for v in (n[h], amount[h], str(squares[h]), len(devices[h]), declined[h])]

    def store(self, keep: int) -> None:
        """Writes what has changed; chunks that end `keep` microseconds before the newest event go."""
        totals, chunks, devices = self.states
        while self.first < self.head_chunk[-1] and self.chunk(self.first)[0][-1] < self.us - keep:
            chunks.removeKey((self.first,))
            self.changed.discard(self.first)
            self.first += 1
        for k in self.changed:
            chunks.updateValue((k,), tuple(self.loaded[k]))
        for d, c in self.counts.items():
            if any(c):
                devices.updateValue((d,), (c,))
            else:
                devices.removeKey((d,))
        totals.update((self.n, self.amount, [str(x) for x in self.squares], self.declined, self.distinct, self.head_chunk, self.head_at, self.first, self.last, self.us, self.timer))


class SixWindows(StatefulProcessor):
    """Events of one entity in the order of `seq` within a batch; each answers with its six windows, itself included."""

    def __init__(self, late_secs: int):
        self.keep = EDGES[-1] + late_secs * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.chunks = handle.getMapState("chunks", "chunk bigint", EVENTS)
        self.devices = handle.getMapState("devices", "device string", "counts array<bigint>")

    def _timer(self, us: int) -> None:
        self.handle.registerTimer((us + self.keep) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        have, out = _Key(self.totals, self.chunks, self.devices), []
        cols = [pdf[c].tolist() for c in ("us", "seq", "amount_minor", "device", "declined")]
        for us, seq, amount, device, declined in zip(*cols):
            event = (us, seq, int(amount), None if device is None or device != device else device, declined is not None and declined == True)  # noqa: E712
            got = have.append(*event) if have.us is None or us >= have.us else have.insert(*event)
            out.append([key[0], seq, us, *got])
        if not have.timer:
            have.timer = True
            self._timer(have.us)
        have.store(self.keep)
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        got = self.totals.get()
        if got is not None:
            if (got[9] + self.keep) // 1000 + 1 > expiredTimerInfo.getExpiryTimeInMs():  # events have come since
                self._timer(got[9])
            else:
                for s in (self.totals, self.chunks, self.devices):
                    s.clear()
        return iter(())

    def close(self) -> None:
        pass


def entity_windows(events: DataFrame, late_secs: int = 86_400) -> DataFrame:
    """Streaming six windows: events (entity, seq, us, amount_minor, device, declined) -> a row an event, as six_windows(ties='arrival') in batch.

    Each event is answered at once with what has arrived by then. An event
    that comes in order of time costs the same whatever the history: running
    totals, and a read head a horizon that lets go of what gets too old. An
    event up to `late_secs` late still counts wherever it belongs, and pays by
    reading its own window; later ones are dropped by the watermark. Events
    with null amounts fail; null devices aren't counted, null declined is no.
    """
    use_rocksdb(events.sparkSession)
    e = events.select("entity", "seq", "us", "amount_minor", "device", "declined", F.timestamp_micros("us").alias("at")).withWatermark("at", f"{late_secs} seconds")
    return e.groupBy("entity").transformWithStateInPandas(SixWindows(late_secs), OUT, "append", "EventTime")


class FirstVerdict(StatefulProcessor):
    """The first arrival's verdict of a key answers all that come with it or later."""

    def __init__(self, verdict: StructType, order: str, keep_secs: int):
        self.schema, self.order, self.keep = verdict, order, keep_secs * 1000
        self.verdict = verdict.names

    def _plain(self, x, name: str):
        """A cell as the state takes it: null for what pandas calls missing, whole numbers whole again."""
        if x is None or isinstance(x, float) and x != x:
            return None
        return int(x) if isinstance(self.schema[name].dataType, IntegralType) else x.item() if hasattr(x, "item") else x

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        got = self.first.get()
        pdf["replayed"] = got is not None
        if got is None:
            pdf["replayed"] = pdf.index > 0
            got = tuple(self._plain(pdf[v].iloc[0], v) for v in self.verdict)
            self.first.update(got)
            self.handle.registerTimer(int(pdf["verdict_ms"].iloc[0]) + self.keep)
        for name, x in zip(self.verdict, got):
            pdf[name] = pd.Series([x] * len(pdf), dtype=pdf[name].dtype if x is not None else object)
        yield pdf.drop(columns=["verdict_key", "verdict_ms", "verdict_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def replayed(decisions: DataFrame, key: str, order: str, verdict: list[str], ts: str, keep_secs: int = 86_400, late_secs: int = 3_600) -> DataFrame:
    """Streaming idempotency: a retry gets the verdict its key's first arrival got, however late it comes, and `replayed` true.

    Within a micro-batch arrivals are in the order of `order`, as in
    decide.idempotent(); between micro-batches the earlier one wins. A verdict
    is kept for at least `keep_secs` of event time after the first arrival; a retry
    beyond is decided anew. Null and empty keys are rejected; rows later than
    `late_secs` are dropped by the watermark.
    """
    use_rocksdb(decisions.sparkSession)
    d = decisions.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    out = StructType([*decisions.schema.fields]).add("replayed", "boolean")
    d = d.withColumn("verdict_at", F.col(ts)).withColumn("verdict_ms", F.unix_millis(F.col(ts))).withWatermark("verdict_at", f"{late_secs} seconds")
    return d.withColumn("verdict_key", F.col(key)).groupBy("verdict_key").transformWithStateInPandas(FirstVerdict(StructType([decisions.schema[v] for v in verdict]), order, keep_secs), out, "append", "EventTime")
