"""As-of joins: each row with the last row of another table that is not later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ts", strict: bool = False) -> DataFrame:
    """left with values of the last right row of the same keys at or before its ts (before it, if strict); null if there is none.

    Both sides are put into one order by key and time, and values carried forward: one shuffle and sort, no
    range join. right has at most one row for each key and time.
    """
    cols = left.columns
    kept = F.struct(*values)
    a = left.select(*keys, ts, F.struct(*cols).alias("row"), F.lit(None).cast(right.select(kept.alias("s")).schema["s"].dataType).alias("value"), F.lit(0 if strict else 1).alias("side"))
    b = right.select(*keys, ts, F.lit(None).cast(a.schema["row"].dataType).alias("row"), kept.alias("value"), F.lit(1 if strict else 0).alias("side"))
    carry = Window.partitionBy(*keys).orderBy(ts, "side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("value", F.last("value", True).over(carry)).where("row is not null").select("row.*", *(F.col(f"value.{v}").alias(v) for v in values))
