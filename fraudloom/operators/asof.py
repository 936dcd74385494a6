"""As-of lookups: the last row known at a moment, in another table or in the same one.

Time is cut into chunks, and a key's chunk is one unit of work, so a busy key
is many tasks' work. What a chunk has to know of those before it is one row,
the last known one, carried over from chunk to chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def _carried(last: DataFrame, value: str) -> DataFrame:
    """last (key, chunk, value: what the chunk ends with, null if nothing) -> (key, chunk, before: what the chunks before it end with)."""
    w = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return last.select("key", "chunk", F.last(value, ignorenulls=True).over(w).alias("before"))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_us: str, right_us: str, tie: list[str], take: list[str], span_us: int = 30 * DAY_US, within_us: int | None = None, prefix: str = "asof_", strict: bool = False) -> DataFrame:
    """Adds to each row of `left` the columns `take` of the last row of `right` with the same key and no later time.

    left and right share the key's name; times are whole numbers (microseconds,
    days), `span_us` is a chunk in the same unit. Of right rows at the same
    moment the one with the greatest `tie` columns counts. strict: only rows
    before the moment. within_us: older rows than that aren't taken. Rows of
    `left` with a null key or time, and those before anything known, have
    nulls; right rows with a null key or time are known to nobody. Repeated
    rows of `left` each come back; further columns stay as they are.
    """
    known = F.struct(F.col(right_us).cast("long").alias("us"), *[F.col(c).alias(f"t{k}") for k, c in enumerate(tie)], F.struct(*[F.col(f"`{c}`") for c in take]).alias("v"))
    r = right.filter(F.col(key).isNotNull() & F.col(right_us).isNotNull()).select(F.col(key).alias("key"), F.col(right_us).cast("long").alias("us"), F.lit(0).alias("side"), known.alias("known"))
    asks = F.col(key).isNotNull() & F.col(left_us).isNotNull()
    rows = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    l = left.filter(asks).select(F.col(key).alias("key"), F.col(left_us).cast("long").alias("us"), F.lit(-1 if strict else 1).alias("side"), rows.alias("row"))
    chunk = lambda d: d.withColumn("chunk", F.floor(F.col("us") / span_us))
    r, l = chunk(r), chunk(l)
    ends = r.groupBy("key", "chunk").agg(F.max("known").alias("known")).unionByName(l.select("key", "chunk").distinct(), allowMissingColumns=True)
    before = _carried(ends.groupBy("key", "chunk").agg(F.max("known").alias("known")), "known").filter("before is not null")
    w = Window.partitionBy("key", "chunk").orderBy("us", "side", "known").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l, allowMissingColumns=True).withColumn("known", F.last("known", ignorenulls=True).over(w)).filter("row is not null")
    found = both.join(before, ["key", "chunk"], "left").withColumn("known", F.coalesce("known", "before"))
    if within_us is not None:
        found = found.withColumn("known", F.when(F.col("us") - F.col("known.us") <= within_us, F.col("known")))
    out = found.select("row.*", *[F.col(f"known.v.`{c}`").alias(f"{prefix}{c}") for c in take])
    rest = left.filter(~asks).select(*[F.col(f"`{c}`") for c in left.columns], *[F.lit(None).cast(right.schema[c].dataType).alias(f"{prefix}{c}") for c in take])
    return out.unionByName(rest)


def previous(df: DataFrame, key: str, us: str, order: list[str], take: list[str | Column], names: list[str], span_us: int = 30 * DAY_US) -> DataFrame:
    """Adds as `names` what `take` was in the key's row before, by (us, order); null in the first. Columns of these names give way. Rows with a null key are each other's."""
    d = df.withColumn("_c", F.floor(F.col(us) / span_us)).withColumn("_v", F.struct(*[t if isinstance(t, Column) else F.col(t) for t in take]))
    at = F.struct(F.col(us), *order)
    ends = d.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(key).isNull().alias("none"), F.col("_c").alias("chunk")).agg(F.max_by("_v", at).alias("v"))
    ends = _carried(ends.withColumn("key", F.struct("key", "none")), "v").filter("before is not null").select(F.col("key.key").alias("_k"), F.col("key.none").alias("_none"), F.col("chunk").alias("_c"), F.col("before").alias("_before"))
    d = d.withColumn("_k", F.coalesce(F.col(key).cast("string"), F.lit(""))).withColumn("_none", F.col(key).isNull())
    w = Window.partitionBy("_k", "_none", "_c").orderBy(us, *order)
    d = d.withColumn("_v", F.lag("_v").over(w)).join(ends, ["_k", "_none", "_c"], "left").withColumn("_v", F.coalesce("_v", "_before"))
    fields = [f"_v.`{f.name}`" for f in d.schema["_v"].dataType.fields]
    return d.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *[F.col(f).alias(n) for f, n in zip(fields, names)])
