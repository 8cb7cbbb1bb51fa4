"""Running values and numbers in an order of all rows, without a task that sees more than a range of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.storage import materialize


def ranged(df: DataFrame, order: list[Column], name: str, again: bool = False) -> DataFrame:
    """df written in ranges of the order, as many as shuffles have partitions, each with its number as __range. Ranges come from a
    sample of df, which is made twice for it; if that is dear, `again` writes it before."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = materialize(df, f"{name}-rows") if again else df
    return materialize(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), name)


def running(parts: DataFrame, by: list[str], order: list[Column], value: str, how: str, out: str) -> DataFrame:
    """parts (of ranged() by `by` and then `order`) with what column `value` has come to before each row, by key: its "max", or its
    "last" that isn't null. Null keys are no keys.

    Each range runs by itself; what a key brings from earlier ranges is added. Only the first key of a range can have begun in an
    earlier one, so there are no more rows to add than ranges.
    """
    at = Window.partitionBy("__range", *by).orderBy(*order)
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumn("__n", F.row_number().over(at))
    whole = F.max(value) if how == "max" else F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__n")))
    ends = rows.groupBy("__range", *by).agg(whole.alias("__whole"))
    over = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.max("__whole").over(over) if how == "max" else F.last("__whole", ignorenulls=True).over(over)
    carried = ends.select("__range", *by, earlier.alias("__carried")).filter(F.col("__carried").isNotNull())
    here = F.max(value).over(before) if how == "max" else F.last(value, ignorenulls=True).over(before)
    both = rows.withColumn("__here", here).join(F.broadcast(carried), ["__range", *by], "left")
    total = F.greatest("__here", "__carried") if how == "max" else F.coalesce("__here", "__carried")
    known = [F.col(c).isNotNull() for c in by]
    for k in known[1:]:
        known[0] = known[0] & k
    return both.withColumn(out, F.when(known[0], total)).drop("__n", "__here", "__carried", "__range")


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with its place in order, from 1. Rows must differ in the order's columns."""
    parts = ranged(df, order, "placed", again=True)
    sizes = {r["__range"]: r["count"] for r in parts.groupBy("__range").count().collect()}  # a row for each range
    before, total = [], 0
    for k in sorted(sizes):
        before.append((k, total))
        total += sizes[k]
    starts = df.sparkSession.createDataFrame(before, "__range int, __before long")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return parts.withColumn("__rank", rank).join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + F.col("__rank")).drop("__range", "__rank", "__before")
