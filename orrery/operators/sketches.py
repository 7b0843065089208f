"""Distinct counts from stored days, merged into longer periods without a look at the rows: sketches, or the values themselves for exact counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of a sketch's registers: 64 KB at most, and exact to a few thousand values.
LG_K = 16
#: Standard errors of the bounds.
SIGMAS = 3.0


def daily(rows: DataFrame, keys: list[str], value: str, time: str, lg_k: int = LG_K) -> DataFrame:
    """``keys, day, sketch`` of the distinct values of a column: the table to store and to add days to.

    Null values are in no sketch, rows without a time in no day.
    """
    days = rows.filter(F.col(time).isNotNull()).withColumn("day", F.to_date(time))
    return days.groupBy(*keys, "day").agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str], period: str | None = None) -> DataFrame:
    """``keys, period, sketch``: sketches of days joined by a unit of ``date_trunc``, or all of them; merged ones may be merged again."""
    day = "day" if "day" in sketches.columns else "period"
    unit = F.to_date(F.date_trunc(period, F.col(day))) if period else F.lit(None).cast("date")
    return sketches.groupBy(*keys, unit.alias("period")).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """The sketches' tables with ``estimate`` and the bounds ``low`` and ``high`` at SIGMAS standard errors in place of ``sketch``."""
    error = SIGMAS * 1.04 / math.sqrt(1 << lg_k)
    out = sketches.withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch")
    return out.withColumns({"low": F.floor(F.col("estimate") * (1 - error)), "high": F.ceil(F.col("estimate") * (1 + error))})


def daily_values(rows: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """``keys, day, value`` once each: what :func:`daily` stores in a sketch, kept whole. Rows without a time have no day and count in no unit but all."""
    return rows.select(*keys, F.to_date(time).alias("day"), F.col(value).alias("value")).distinct()


def merged_values(values: DataFrame, keys: list[str], period: str | None = None) -> DataFrame:
    """``keys, period, value`` once each, like :func:`merged`; each value is a row, so no task holds a period's."""
    day = "day" if "day" in values.columns else "period"
    unit = F.to_date(F.date_trunc(period, F.col(day))) if period else F.lit(None).cast("date")
    return values.select(*keys, unit.alias("period"), "value").distinct()


def counted(values: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, period, estimate``: how many values there are, null not among them."""
    return values.groupBy(*keys, "period").agg(F.count("value").alias("estimate"))
