"""Unions of tables of one form: sheets, files, periods, sources in order of priority."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def sheets(tables: dict[str, DataFrame], label: str = "_sheet_name") -> DataFrame | None:
    """The largest set of at least two tables with the same columns, one below the other, each row with its table's name."""
    by = defaultdict(list)
    for name, t in tables.items():
        by[frozenset(t.columns)].append(name)
    names = max(by.values(), key=len, default=[])
    return _all([tables[n].withColumn(label, F.lit(n)) for n in names]) if len(names) > 1 else None


def grouped(tables: dict[tuple[str, str, str], DataFrame], label: str = "_source_table") -> tuple[dict[tuple[str, str], DataFrame], list[str]]:
    """One union for each (corpus, schema) over the tables keyed (corpus, schema, name), and the names left out.

    The most common column tuple of a group counts; tables of another layout
    are left out and named. The corpus is in the key, so tenants never meet.
    """
    by: dict[tuple[str, str], list[tuple[str, DataFrame]]] = defaultdict(list)
    for (corpus, schema, name), t in tables.items():
        by[corpus, schema].append((name, t))
    unions, left_out = {}, []
    for key, found in by.items():
        layout = Counter(tuple(t.columns) for _, t in found).most_common(1)[0][0]
        same = [(n, t) for n, t in found if tuple(t.columns) == layout]
        left_out += [n for n, t in found if tuple(t.columns) != layout]
        if len(same) > 1:
            unions[key] = _all([t.withColumn(label, F.lit(n)) for n, t in same])
    return unions, left_out


def common(tables: dict[str, DataFrame], label: str = "_source_table") -> DataFrame:
    """All tables on the columns they share."""
    names = list(tables)
    shared = [c for c in tables[names[0]].columns if all(c in tables[n].columns for n in names)]
    return _all([tables[n].select(*shared).withColumn(label, F.lit(n)) for n in names])


def periods(tables: dict[str, DataFrame], label: str = "period") -> DataFrame:
    """Sheets of several months, each row with its period; columns go by place."""
    names = list(tables)
    first = tables[names[0]].columns
    return reduce(DataFrame.union, [tables[n].toDF(*first).withColumn(label, F.lit(n)) for n in names])


def first_source_wins(sources: list[tuple[str, DataFrame]], key: str, order: str) -> DataFrame:
    """One row a key, from the first source that has it; within a source the first in order."""
    rows = _all([t.withColumn("source_name", F.lit(n)).withColumn("_rank", F.lit(i)) for i, (n, t) in enumerate(sources)])
    place = F.row_number().over(Window.partitionBy(key).orderBy("_rank", order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_rank", "_place")
