"""Numbered entries of an authored chronology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NUMBER = r"^\s*(\d{1,3})[.)]\s+"
_DATE = r"^(?:On |By |In )?((?:\d{1,2}(?:st|nd|rd|th)?\s+)?(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}|\d{4})\b[,:\s-]*"


def entries(paragraphs: DataFrame) -> DataFrame:
    """``path, entry, number, date_text, text`` from ``paragraphs(path, paragraph, text)``.

    A numbered paragraph begins an entry and what follows without a number
    belongs to it; paragraphs before the first number are left out. A date at
    the entry's beginning is split off.
    """
    starts = F.regexp_extract("text", _NUMBER, 1)
    order = Window.partitionBy("path").orderBy("paragraph")
    grouped = paragraphs.withColumn("entry", F.sum((starts != "").cast("long")).over(order)).filter("entry > 0")
    parts = grouped.groupBy("path", "entry").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "text"))), lambda p: p["text"]), " ").alias("whole"))
    body = F.regexp_replace("whole", _NUMBER, "")
    return parts.select("path", "entry", F.regexp_extract("whole", _NUMBER, 1).cast("int").alias("number"), F.nullif(F.regexp_extract(body, _DATE, 1), F.lit("")).alias("date_text"), F.regexp_replace(body, _DATE, "").alias("text"))
