"""Queries over compound files that executors make of the given tables: mail messages and older workbooks."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from orrery.plans.registry import query
from orrery.plans.views import table
from orrery.session import ship
from orrery.sources import compound_export, files, spreadsheet

_SENT = datetime(2024, 1, 1, tzinfo=UTC)
#: Bytes of files that go on together.
HELD = 4_000_000


@query("msg_mail", """WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS body FROM documents), p AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil(length(body) / 2000.0) AS BIGINT)))) AS page FROM d WHERE doc_id % 50 <> 7)
    SELECT CAST(doc_id AS VARCHAR) || '.msg' AS path, 'Writer ' || doc_id || ' <w' || doc_id || '@x.org>' AS sender, 'Reader <r@x.org>;c' || doc_id % 3 || '@x.org' AS recipients, 'Nº ' || doc_id AS subject,
        strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)), '%a, %d %b %Y %H:%M:%S +0000') AS date, page, md5(substr(body, CAST(page * 2000 + 1 AS BIGINT), 2000)) AS text_md5, CASE WHEN doc_id % 4 = 0 THEN 'a.pdf' ELSE '' END AS attachments, FALSE AS broken FROM p
    UNION ALL SELECT CAST(doc_id AS VARCHAR) || '.msg', NULL, NULL, NULL, NULL, NULL, NULL, NULL, TRUE FROM d WHERE doc_id % 50 = 7""")
def msg_mail(spark, sf_dir):
    """Every document as the body of a message, read back by pages; of each fifty files one is cut short."""
    ship(spark)

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for frame in frames:
            for i, text in zip(frame["doc_id"], frame["text"], strict=True):
                people = [(2, "", f"c{i % 3}@x.org"), (1, "Reader", "r@x.org"), (3, "Hidden", "h@x.org")]
                raw = compound_export.message((f"Writer {i}", f"w{i}@x.org"), people, f"Nº {i}", _SENT + timedelta(minutes=int(i)), text or "", ["a.pdf"] * (i % 4 == 0))
                rows.append((f"{i}.msg", raw[:700] if i % 50 == 7 else raw))
                held += len(raw)
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "content"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("doc_id is not null")
    pages = files.mail(docs.mapInPandas(made, "path string, content binary"))
    joined = lambda name: F.array_join(name, ";").alias(name)
    return pages.select("path", "sender", joined("recipients"), "subject", "date", "page", F.md5("text").alias("text_md5"), joined("attachments"), F.col("error").isNotNull().alias("broken"))


#: Order keys of a workbook.
KEYS = 1000


@query("xls_tables", f"""SELECT CAST(o_orderkey // {KEYS} AS VARCHAR) || '.xls' AS path, 'Orders' AS name, o_orderkey, o_custkey AS customer, o_orderpriority AS priority, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date, o_totalprice AS total, o_totalprice > 100000 AS large, FALSE AS broken FROM orders
    UNION ALL SELECT DISTINCT CAST(o_orderkey // {KEYS} AS VARCHAR) || '-broken.xls', NULL, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), NULL, NULL, NULL, CAST(NULL AS BOOLEAN), TRUE FROM orders WHERE o_orderkey // {KEYS} % 5 = 0""")
def xls_tables(spark, sf_dir):
    """A workbook for each thousand order keys and a broken one at each fifth, read back."""
    ship(spark)

    def made(frame: pd.DataFrame) -> pd.DataFrame:
        part, frame = int(frame["part"].iloc[0]), frame.sort_values("o_orderkey")
        rows = [["Order Key", "Customer #", "Priority", "Order Date", "Total", "Large"]]
        rows += [[int(k), int(c), p, d, float(t), bool(t > 100000)] for k, c, p, d, t in zip(frame["o_orderkey"], frame["o_custkey"], frame["o_orderpriority"], frame["o_orderdate"], frame["o_totalprice"], strict=True)]
        raw = compound_export.workbook({"Orders": rows})
        return pd.DataFrame([(f"{part}.xls", raw)] + [(f"{part}-broken.xls", raw[:-2000])] * (part % 5 == 0), columns=["path", "content"])

    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / KEYS).alias("part"), "o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("o_orderdate"), "o_totalprice")
    rows = spreadsheet.tables(o.groupBy("part").applyInPandas(made, "path string, content binary"))
    cell = lambda name: F.try_element_at("cells", F.lit(name))
    return rows.select(
        "path", F.col("table").alias("name"), cell("order_key").cast("long").alias("o_orderkey"), cell("customer").cast("long").alias("customer"), cell("priority").alias("priority"),
        cell("order_date").alias("order_date"), cell("total").cast("double").alias("total"), (cell("large") == "True").alias("large"), F.col("error").isNotNull().alias("broken"),
    )
