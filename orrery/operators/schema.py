"""Target schemas: matching columns, converting to them, checking and profiling tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.dates import mixed_date

#: Share of required columns that a table must have to match a schema.
MATCH = 0.7


@dataclass(frozen=True)
class ColumnDef:
    name: str
    dtype: str = "string"  # string, float, int, date, bool
    required: bool = True
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class TargetSchema:
    name: str
    columns: tuple[ColumnDef, ...] = field(default_factory=tuple)


def _key(name: str) -> str:
    return re.sub(r"[\s_]+", " ", name.strip().lower())


def renames(columns: list[str], schema: TargetSchema) -> dict[str, str]:
    """Which column stands for which target column, by name or alias in any case; the first of several counts."""
    known = {_key(n): c.name for c in schema.columns for n in (c.name, *c.aliases)}
    out: dict[str, str] = {}
    for c in columns:
        target = known.get(_key(c))
        if target and target not in out.values():
            out[c] = target
    return out


def match_schema(columns: list[str], schemas: list[TargetSchema]) -> tuple[TargetSchema | None, float]:
    """The schema with the largest share of its required columns present, if that reaches MATCH."""
    best, ratio = None, 0.0
    for s in schemas:
        required = [c.name for c in s.columns if c.required]
        share = len(set(renames(columns, s).values()) & set(required)) / max(1, len(required))
        if share > ratio:
            best, ratio = s, share
    return (best, ratio) if ratio >= MATCH else (None, ratio)


def converted(frame: DataFrame, schema: TargetSchema) -> DataFrame:
    """The frame under the schema's names and types; what does not parse is null, a null text is empty."""
    out = frame.withColumnsRenamed(renames(frame.columns, schema))

    def cast(c: ColumnDef) -> Column:
        if c.name not in out.columns:
            return F.lit("" if c.dtype == "string" else None)
        value = F.col(f"`{c.name}`")
        if c.dtype in ("float", "int"):
            return F.regexp_replace(F.trim(value.cast("string")), "%$", "").try_cast("double")
        if c.dtype == "date":
            return mixed_date(value.cast("string"))
        if c.dtype == "bool":
            return F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "y")
        return F.coalesce(value.cast("string"), F.lit(""))

    return out.select(*(cast(c).alias(c.name) for c in schema.columns))


def violations(frame: DataFrame, rules: dict[str, str]) -> DataFrame:
    """For each named rule (a condition of bad rows), the number of rows that break it; one pass, one row a rule."""
    counts = frame.agg(*(F.count_if(F.coalesce(F.expr(r), F.lit(False))).alias(n) for n, r in rules.items()))
    return counts.unpivot([], list(rules), "rule", "rows")


def completeness(frame: DataFrame) -> DataFrame:
    """Percentage of nulls of each column, to three digits; one pass, one row a column."""
    shares = frame.agg(*(F.round(F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100, 3).alias(c) for c in frame.columns))
    return shares.unpivot([], frame.columns, "column_name", "null_pct")


def top_values(frame: DataFrame, column: str, k: int = 5) -> DataFrame:
    return frame.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(k)


def profile(frame: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """Minimum, maximum, mean, total and distinct counts of several columns in one pass."""
    numeric = [f(F.col(c)).alias(f"{n}_{c}") for c in numbers for n, f in (("min", F.min), ("max", F.max), ("mean", lambda x: F.round(F.avg(x), 2)), ("sum", lambda x: F.round(F.sum(x), 2)))]
    return frame.agg(*numeric, *(F.count_distinct(c).alias(f"distinct_{c}") for c in categories))


def gaps(frame: DataFrame, date: str, days: int = 7, by: list[str] = ()) -> DataFrame:
    """Dates after which nothing follows for more than ``days``: ``by.., gap_from, gap_to, gap_days``.

    Only distinct dates reach the window; without ``by`` that is one row a day.
    """
    dates = frame.select(*by, F.col(date).alias("gap_to")).filter("gap_to is not null").distinct()
    before = F.lag("gap_to").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("gap_to"))
    return dates.withColumn("gap_from", before).withColumn("gap_days", F.datediff("gap_to", "gap_from").cast("long")).filter(F.col("gap_days") > days)


def singles(frame: DataFrame, column: str) -> DataFrame:
    """Values that one row has."""
    return frame.groupBy(column).agg(F.count("*").alias("n")).filter("n = 1").select(column)
