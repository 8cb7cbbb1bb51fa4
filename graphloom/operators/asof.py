"""As-of joins: for each row the nearest other row before or after it within a window, by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import ranged, running


def nearest(left: DataFrame, right: DataFrame, by: str, at: str, take: list[str], seconds: float | None = None, after: bool = False) -> DataFrame:
    """left with the columns `take` of the nearest right row of the same key: the last at or before left's time, or, after, the
    first at or after it; nulls where none lies within `seconds`. Rows of the same time count as before and as after. A null key
    has no nearest row.

    Both sides are sorted together once, into ranges of key and time, so there is no range join, and a key with very many rows lies
    in many ranges. Ties at the same time go to the largest (smallest) values.
    """
    near = F.struct(F.col(at).alias("near_at"), *take)
    rows = left.withColumn("__near", F.lit(None).cast(right.select(near.alias("n")).schema["n"].dataType)).withColumn("__left", F.lit(True))
    other = right.select(F.col(by), F.col(at), near.alias("__near"), F.lit(False).alias("__left"))
    both = rows.unionByName(other, allowMissingColumns=True)
    side = F.col("__left").cast("int")
    order = [F.col(at).desc(), side, F.col("__near").desc()] if after else [F.col(at), side, F.col("__near")]
    found = running(ranged(both, [F.col(by), *order], "asof"), [by], order, "__near", "last", "__hit").filter("__left")
    if seconds is not None:
        gap = F.abs(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("__hit.near_at").cast("timestamp")))
        found = found.withColumn("__hit", F.when(gap <= int(seconds * 1_000_000), F.col("__hit")))
    return found.select(*left.columns, *[F.col(f"__hit.{c}").alias(f"near_{c}") for c in take])
