"""Queries over PDF files that executors make of the given tables: their texts and their tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from orrery.plans.registry import query
from orrery.plans.views import table
from orrery.session import ship
from orrery.sources import pdf
from orrery.sources.pdf_export import document, table_page
from orrery.storage import stash

#: Order keys of a file, and rows of a page.
KEYS, ROWS = 1000, 40
NAMES = ["Order Key", "Customer #", "Priority"]


def _files(spark, sf_dir):
    """A file of order tables for each thousand order keys, ruled or aligned, of older or newer make, and a broken one at each fifth."""
    ship(spark)

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        part, frame = int(frame["part"].iloc[0]), frame.sort_values("o_orderkey")
        rows = [[str(k), str(c), p] for k, c, p in zip(frame["o_orderkey"], frame["o_custkey"], frame["o_orderpriority"], strict=True)]
        pages = [table_page(f"Orders (part {part}), page {i // ROWS + 1}", NAMES, rows[i : i + ROWS], part % 2 == 0) for i in range(0, len(rows), ROWS)]
        out = [(f"{part}.pdf", document(pages, packed=part % 3 == 1, wide=part % 3 == 2))]
        return pd.DataFrame(out + [(f"{part}-broken.pdf", out[0][1][8:])] * (part % 5 == 0), columns=["path", "content"])

    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / KEYS).alias("part"), "o_orderkey", "o_custkey", "o_orderpriority")
    o = o.repartition(pdf.TASKS_A_CORE * spark.sparkContext.defaultParallelism, "part")  # by number, as a file takes longer than its rows tell
    return stash(o.groupBy("part").applyInPandas(made, "path string, content binary"), "pdf-files")


@query("pdf_texts", """WITH o AS (SELECT o_orderkey // 1000 AS part, o_orderkey, CAST(o_orderkey AS VARCHAR) || ' ' || CAST(o_custkey AS VARCHAR) || ' ' || o_orderpriority AS said,
        (row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) - 1) // 40 + 1 AS page FROM orders)
    SELECT CAST(part AS VARCHAR) || '.pdf' AS path, CAST(page AS INTEGER) AS page, 'Orders (part ' || part || '), page ' || page || chr(10) || 'Order Key Customer # Priority' || chr(10) || string_agg(said, chr(10) ORDER BY o_orderkey) AS text,
        FALSE AS broken, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) < 0.2 AS needs_ocr FROM o GROUP BY part, page
    UNION ALL SELECT DISTINCT CAST(part AS VARCHAR) || '-broken.pdf', CAST(NULL AS INTEGER), NULL, TRUE, NULL FROM o WHERE part % 5 = 0""")
def pdf_texts(spark, sf_dir):
    pages = pdf.page_texts(pdf.page_marks(_files(spark, sf_dir)))
    return pages.select("path", "page", "text", F.col("error").isNotNull().alias("broken"), "needs_ocr")


@query("pdf_tables", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) - 1 AS i FROM orders),
    p AS (SELECT CAST(o_orderkey // 1000 AS VARCHAR) || '.pdf' AS path, CAST(i // 40 + 1 AS INTEGER) AS page, CAST(i % 40 AS INTEGER) AS row, o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority AS priority, count(*) OVER (PARTITION BY o_orderkey // 1000, i // 40) AS n FROM o)
    SELECT path, page, row, o_orderkey, customer, priority FROM p WHERE n > 1""")
def pdf_tables(spark, sf_dir):
    """All rows of all tables; a page with one row only is no table."""
    rows = pdf.page_tables(stash(pdf.page_marks(_files(spark, sf_dir)), "pdf-marks"))
    cell = lambda name: F.try_element_at("cells", F.lit(name))
    return rows.select("path", "page", F.col("row").cast("int").alias("row"), cell("order_key").cast("long").alias("o_orderkey"), cell("customer").alias("customer"), cell("priority").alias("priority"))
