"""Evidence for entries: ranked chunks and dated events of each, merging, deduplication, revision marks, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.retrieval import bm25, cosine, small, tokens

# Documents kept for an entry, events shown for it.
DOCUMENTS, EVENTS = 40, 10
CACHE_LEAST = 0.97


def evidence(chunks: DataFrame, entries: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """The best chunk of each document for each of ``entries(query_id, text)``, up to ``documents`` of them, in one job."""
    terms = entries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    scored = bm25(chunks, ["doc_id", "page"], terms).withColumn("score", F.round("score", 6))
    best = scored.groupBy("query_id", "doc_id").agg(F.max(F.struct("score", (-F.col("page")).alias("neg"))).alias("s")).select("query_id", "doc_id", (-F.col("s.neg")).alias("page"), F.col("s.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("place", place).filter(F.col("place") <= documents)


def events_for(events: DataFrame, windows: DataFrame, k: int = EVENTS) -> DataFrame:
    """The first events of each window's rows, as :func:`events_near` gives them."""
    place = F.row_number().over(Window.partitionBy("entry").orderBy("ts", "event_id"))
    return events.withColumn("place", place).filter(F.col("place") <= k)


def keep_best(rows: DataFrame, key: list[str], score: str, by: Column | None = None) -> DataFrame:
    """Of rows with one key the one with the best score: coverage merging.

    With ``by`` that value decides, and the best score stands beside the row
    that it picks, which need not have it. Rows where it is null are not picked.
    """
    rest = [c for c in rows.columns if c not in key and c != score]
    if by is not None:
        best = rows.groupBy(*key).agg(F.max(score).alias(score), F.max_by(F.struct(*rest), by).alias("b"))
        return best.select(*key, score, "b.*")
    best = rows.groupBy(*key).agg(F.max(F.struct(score, *rest)).alias("b"))
    return best.select(*key, "b.*")


def distinct_events(events: DataFrame) -> DataFrame:
    """One event for each date, actor and start of its description: the one of the smallest id."""
    keys = [F.col("date_sort"), F.lower("actor").alias("actor_key"), F.lower(F.left("description", F.lit(120))).alias("text_key")]
    return events.groupBy(*keys).agg(F.min("event_id").alias("event_id"))


def revision(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A mark of a table's content that does not depend on order: count, and sums of two halves of each row's hash.

    A hash of all rows in order would need them in one place; sums are partial
    aggregates.
    """
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    half = lambda a: F.conv(F.substring(digest, a, 12), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(F.count("*").alias("n"), F.sum(half(1)).alias("a"), F.sum(half(13)).alias("b"))
    return sums.select("n", F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 32).alias("revision"))


def cached(cache: DataFrame, queries: DataFrame, least: float = CACHE_LEAST) -> DataFrame:
    """The nearest cached answer of the same namespace for each of ``queries(query_id, namespace, query)``, at a cosine of ``least`` or more."""
    met = cache.join(small(queries), "namespace").withColumn("c", cosine(F.col("embedding"), F.col("query"))).filter(F.col("c") >= least)
    return met.groupBy("query_id").agg(F.max(F.struct("c", (-F.col("vec_id")).alias("neg"))).alias("b")).select("query_id", (-F.col("b.neg")).alias("vec_id"), F.round("b.c", 6).alias("similarity"))


def table_blocks(rows: DataFrame, sheet: str, order: list[str], size: int = 40) -> DataFrame:
    """Rows of each sheet numbered into blocks of ``size``, with the first row of each."""
    place = F.row_number().over(Window.partitionBy(sheet).orderBy(*order)) - 1
    numbered = rows.withColumn("_row", place).withColumn("block", (F.col("_row") / size).cast("long"))
    return numbered.groupBy(sheet, "block").agg(F.count("*").alias("rows"), F.min("_row").cast("long").alias("first_row"))


def chart_kind(rows: Column, labels: Column, dated: Column) -> Column:
    """``line`` for dated labels, ``bar`` for others, none unless there are 3 to 24 rows with labels of their own."""
    return F.when(rows.between(3, 24) & (labels == rows), F.when(dated, "line").otherwise("bar"))


def golden(examples: DataFrame, order: list[str]) -> DataFrame:
    """One example for each question (in lower case), route and vote: the first in order."""
    place = F.row_number().over(Window.partitionBy(F.lower(F.trim("question")), "route", "vote").orderBy(*order))
    return examples.withColumn("_place", place).filter("_place = 1").drop("_place")
