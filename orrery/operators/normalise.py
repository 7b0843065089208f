"""Normalising a raw table: total rows, month and year, dates, null tokens, empty rows and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.dates import date_key, month_of, year_of

# A cell that contains one of these marks a row of totals.
TOTAL_TOKENS = ["total", "grand total", "year total", "subtotal", "sub total", "monthly total", "yearly total", "overall", "summary"]
# What counts as null in a text column.
NULL_TOKENS = ["nan", "None", "NaN", "NaT", ""]


def is_total_row(columns: list[str], strict: bool = False) -> Column:
    """Whether any cell, as lower-case text, contains a total token; ``strict`` asks for whole words."""
    pattern = "|".join(TOTAL_TOKENS)
    pattern = rf"\b({pattern})\b" if strict else pattern
    hits = [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).rlike(pattern), F.lit(False)) for c in columns]
    return reduce(Column.__or__, hits, F.lit(False))


def normalised(frame: DataFrame, month_column: str, year_column: str | None = None, strict: bool = False) -> DataFrame:
    """The table with ``is_total_row, month_num, year, date_key``; nothing is dropped."""
    month, year = month_of(F.col(month_column).cast("string")), year_of(F.col(year_column or month_column).cast("string"))
    return frame.withColumns({"is_total_row": is_total_row(frame.columns, strict), "month_num": month, "year": year, "date_key": date_key(year, month)})


def clean(frame: DataFrame) -> DataFrame:
    """The rows of a normalised table that are no totals."""
    return frame.filter("not is_total_row")


def nulls_from_tokens(frame: DataFrame) -> DataFrame:
    """Text columns with null tokens as nulls, the policy of loaded tables."""
    return frame.withColumns({c: F.when(~F.trim(F.col(c)).isin(NULL_TOKENS), F.col(c)) for c, t in frame.dtypes if t == "string"})


def drop_empty(frame: DataFrame) -> DataFrame:
    """Without rows whose cells are all null, then without columns that are all null (one pass over the rest)."""
    rows = frame.na.drop("all")
    counts = rows.agg(*(F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(frame.columns))).first()
    return rows.drop(*(c for i, c in enumerate(frame.columns) if not counts[i]))


def clean_names(names: list[str]) -> list[str]:
    """Column names of letters, digits and single underscores in lower case; blank ones by place, repeated ones numbered."""
    out: list[str] = []
    for i, name in enumerate(names):
        low = "".join(ch if ch.isalnum() else "_" for ch in (name or "")).lower()
        low = "_".join(p for p in low.split("_") if p) or f"col_{i}"
        base, k = low, 1
        while low in out:
            low, k = f"{base}_{k}", k + 1
        out.append(low)
    return out


def table_name(path: str) -> str:
    """A table's name from a file's: letters, digits and underscores, ``t_`` before a leading digit, 50 characters."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    name = "_".join(p for p in "".join(ch if ch.isalnum() else "_" for ch in stem).lower().split("_") if p)
    return (f"t_{name}" if not name or name[0].isdigit() else name)[:50]


def dataset_key(name: Column) -> Column:
    """A file's stem in lower case without a number at its end, so that copies of one form have one key."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(name, r"^.*/|\.[^.]*$", "")), r"[\s_\-]*\(?\d+\)?$", ""), r"[\s_\-]+$", "")


def best_month(frame: DataFrame, value: str, worst: bool = False) -> DataFrame:
    """The month with the largest (or smallest) sum of a value over rows that are no totals; ties go to the earlier month."""
    sums = clean(frame).filter("month_num is not null").groupBy("month_num").agg(F.round(F.sum(F.expr(f"try_cast(`{value}` as double)")), 2).alias("amount"))
    return sums.orderBy(F.asc("amount") if worst else F.desc("amount"), "month_num").limit(1)


def forward_filled(frame: DataFrame, column: str, partition: list[str], order: list[str]) -> DataFrame:
    """Nulls of a column take the last value before them in order."""
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn(column, F.last(column, ignorenulls=True).over(window))


def shifts_to_long(frame: DataFrame, ids: list[str], shifts: list[str]) -> DataFrame:
    """One row an id and shift with a value over zero: ``shift, workers``."""
    return frame.unpivot(ids, shifts, "shift", "workers").filter("workers > 0")
