"""As-of joins: to each row the last other row of its key at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: list[str], time: str, values: list[str], within: int | None = None) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` with the same key and a time no later, at most ``within`` seconds before.

    Both sides are sorted together once by key and time, so no pairs of rows
    are made. Rows of ``right`` at one time count as one, the greatest. Without
    such a row, and for null keys or times, the values are null.
    """
    other = right.groupBy(*key, time).agg(F.max(F.struct(*values)).alias("_values"))
    own = left.withColumn("_row", F.struct(*left.columns)).withColumn("_values", F.lit(None).cast(other.schema["_values"].dataType))
    both = own.select(*key, time, "_row", "_values", F.lit(1).alias("_side")).unionByName(other.withColumn("_row", F.lit(None).cast(own.schema["_row"].dataType)).withColumn("_side", F.lit(0)))
    before = Window.partitionBy(*key).orderBy(F.asc_nulls_first(time), "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct(F.col(time).alias("at"), "_values")), ignorenulls=True).over(before)
    met = both.withColumn("_last", last).filter("_side = 1")
    fresh = F.col(time).isNotNull() & F.col("_last.at").isNotNull()
    for k in key:
        fresh = fresh & F.col(k).isNotNull()
    if within is not None:
        fresh = fresh & (F.unix_timestamp(time) - F.unix_timestamp("_last.at") <= within)
    return met.select("_row.*", *(F.when(fresh, F.col(f"_last._values.{v}")).alias(v) for v in values))
