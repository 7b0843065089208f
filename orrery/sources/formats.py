"""Known forms: templates that score a sheet, extractors of daily reports, and a registry of trusted converters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.normalise import clean_names
from orrery.session import ship

# Parts of a template's score and the scores from which it applies.
FILE_PATTERN, SHEETS, COLUMNS, COUNT, NUMERIC, MARKER = 15, 15, 35, 10, 5, 5
AUTO, REVIEW = 0.85, 0.70
#: Share of a converter's columns that a table must have.
FINGERPRINT = 0.7


def jaccard(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


@dataclass(frozen=True)
class Template:
    """What a known form looks like."""

    name: str
    file_pattern: str = ""
    sheets: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    numeric_share: float = 0.5
    markers: tuple[str, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class Look:
    """What a file shows: its name, sheets, columns, share of numeric columns, texts near the top."""

    file: str
    sheets: tuple[str, ...]
    columns: tuple[str, ...]
    numeric_share: float
    texts: tuple[str, ...] = ()


def template_score(t: Template, look: Look) -> float:
    """Points over the points possible: file name, sheets, columns and their number, numeric share, up to four markers."""
    low = lambda xs: {x.strip().lower() for x in xs}
    got = possible = 0.0
    parts = [
        (bool(t.file_pattern), FILE_PATTERN, bool(t.file_pattern and re.search(t.file_pattern, look.file, re.IGNORECASE))),
        (bool(t.sheets), SHEETS, len(low(t.sheets) & low(look.sheets)) / max(1, len(t.sheets))),
        (bool(t.columns), COLUMNS, jaccard(set(clean_names(list(t.columns))), set(clean_names(list(look.columns))))),
        (bool(t.columns), COUNT, 1 - min(1.0, abs(len(t.columns) - len(look.columns)) / max(1, len(t.columns)))),
        (True, NUMERIC, 1 - min(1.0, abs(t.numeric_share - look.numeric_share))),
        *((True, MARKER, any(m.lower() in x.lower() for x in look.texts)) for m in t.markers[:4]),
    ]
    for applies, points, share in parts:
        if applies:
            got, possible = got + points * share, possible + points
    return got / possible if possible else 0.0


def best_template(templates: list[Template], look: Look) -> tuple[Template | None, float, str]:
    """The best template with its score and whether it applies by itself, after review or not at all."""
    scored = max(((template_score(t, look), t.name, t) for t in templates), default=(0.0, "", None), key=lambda x: x[:2])
    return scored[2], round(scored[0], 4), "auto" if scored[0] >= AUTO else "review" if scored[0] >= REVIEW else "none"


def daily_report(cells: DataFrame, ids: list[str], day: str, night: str) -> DataFrame:
    """A wide daily report as rows: contractors and zones filled down, both shifts added up, zero rows dropped.

    ``cells(sheet, row, ..)`` with a nullable ``contractor`` and ``zone``.
    """
    upto = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    filled = cells.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("contractor", "zone")})
    total = F.coalesce(F.col(day).try_cast("double"), F.lit(0.0)) + F.coalesce(F.col(night).try_cast("double"), F.lit(0.0))
    return filled.withColumn("workers", total).filter("workers > 0").select(*ids, "contractor", "zone", "workers")


def invoice_breakup(cells: DataFrame, code: str, amount: str) -> DataFrame:
    """Lines of an invoice's break-up: those with a code and an amount that is a number; section headers have a dash or none."""
    value = F.regexp_replace(F.col(amount).cast("string"), "[, ]", "").try_cast("double")
    return cells.withColumn("_amount", value).filter(F.col(code).isNotNull() & ~F.trim(F.col(code)).isin("", "-") & F.col("_amount").isNotNull()).withColumn(amount, F.col("_amount")).drop("_amount")


@dataclass(frozen=True)
class Converter:
    """A trusted function from frames to frames with its schema, and what it is for."""

    name: str
    function: Callable[[pd.DataFrame], pd.DataFrame]
    schema: str
    file_pattern: str = ""
    columns: tuple[str, ...] = ()


class Converters:
    """Registered converters. Only functions of the program are run, never text."""

    def __init__(self) -> None:
        self._known: dict[str, Converter] = {}

    def register(self, converter: Converter) -> None:
        self._known[converter.name] = converter

    def match(self, file: str, columns: list[str]) -> Converter | None:
        """By file name, else by the largest share of its columns present, if that reaches FINGERPRINT."""
        for c in self._known.values():
            if c.file_pattern and re.search(c.file_pattern, file, re.IGNORECASE):
                return c
        have = set(clean_names(columns))
        share = {c.name: len(have & set(clean_names(list(c.columns)))) / len(c.columns) for c in self._known.values() if c.columns}
        best = max(share, key=lambda n: (share[n], n), default=None)
        return self._known[best] if best is not None and share[best] >= FINGERPRINT else None

    def apply(self, name: str, frame: DataFrame) -> DataFrame:
        """Runs a converter over batches of a frame; it must treat rows one by one."""
        ship(frame.sparkSession)
        converter = self._known[name]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield converter.function(f)

        return frame.mapInPandas(run, converter.schema)
