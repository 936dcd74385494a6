"""JSON of window aggregates: a missing field is an error, never a zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = "struct<count:bigint,sum_minor:bigint,sum_sq:decimal(38,0),distinct_devices:bigint,decline_count:bigint>"
WINDOWS = f"map<string,{WINDOW}>"
FIELDS = ("count", "sum_minor", "sum_sq", "distinct_devices", "decline_count")


def encode(windows: Column) -> Column:
    return F.to_json(windows)


def decode(text: Column) -> Column:
    """Windows of stored JSON; malformed text and absent or null fields raise. Null stays null.

    Spark fills an absent field with null even in FAILFAST mode, so every
    field of every window is looked at.
    """
    got = F.from_json(text, WINDOWS, {"mode": "FAILFAST"})
    lacking = F.exists(F.map_values(got), lambda w: w.isNull() | F.array_contains(F.array(*[w[f].isNull() for f in FIELDS]), True))
    return F.when(text.isNull(), F.lit(None).cast(WINDOWS)).when(F.coalesce(lacking, F.lit(True)), F.raise_error(F.concat(F.lit("incomplete window aggregates: "), text)).cast(WINDOWS)).otherwise(got)
