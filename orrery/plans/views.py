"""Shaping views: the driver's tables in the shape of the domain's relations.

Each view exists twice, as a DataFrame and as the same relation in SQL text (a
common table expression), so that an operator and its SQL read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.retrieval import windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a work record: date, place, machine or trade, activity, hours, output."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.to_date("l_shipdate").alias("work_date"),
        F.col("l_returnflag").alias("block"),
        F.col("l_linestatus").alias("floor"),
        F.col("p_brand").alias("item"),
        F.col("p_type").alias("activity"),
        F.col("l_quantity").alias("hours"),
        F.col("l_extendedprice").alias("output"),
        F.col("p_name").alias("unit"),
        F.col("l_orderkey").alias("rec_id"),
        F.col("l_linenumber").cast("long").alias("rec_line"),
    )


DAILY_LOG = """daily_log AS (
    SELECT CAST(l_shipdate AS DATE) AS work_date, l_returnflag AS block, l_linestatus AS floor, p_brand AS item,
           p_type AS activity, l_quantity AS hours, l_extendedprice AS output, p_name AS unit,
           l_orderkey AS rec_id, CAST(l_linenumber AS BIGINT) AS rec_line
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def ipc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a contract item: total, cumulative and current amounts and the cumulative percentage."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("code"),
        F.col("p_name").alias("name"),
        F.col("l_extendedprice").alias("total"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cum_amt"),
        F.round(100 * (1 - F.col("l_discount")), 6).alias("cum_pct"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("cur_amt"),
        F.col("l_returnflag").alias("period"),
    )


IPC = """ipc AS (
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS code, p_name AS name,
           l_extendedprice AS total, l_extendedprice * (1 - l_discount) AS cum_amt,
           round(100 * (1 - l_discount), 6) AS cum_pct, l_extendedprice * l_tax AS cur_amt, l_returnflag AS period
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters between parties: one an order, from its customer to its first supplier or, every third, back."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    per = line.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("sk"), F.sort_array(F.collect_set("l_partkey")).alias("refs"), F.sort_array(F.collect_set("p_type")).alias("topics"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = per.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("sk") == F.col("s_suppkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    back = F.col("o_orderkey") % 3 == 0
    return rows.select(
        F.col("o_orderkey").alias("doc_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(back, F.col("s_name")).otherwise(F.col("c_name")).alias("sender"),
        F.when(back, F.col("c_name")).otherwise(F.col("s_name")).alias("recipient"),
        F.col("o_orderpriority").alias("doc_type"),
        F.col("o_custkey").cast("string").alias("contract_ref"),
        F.col("n_name").alias("project"),
        "refs",
        "topics",
    )


NOTICES = """notices AS (
    SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS date,
           CASE WHEN o_orderkey % 3 = 0 THEN s_name ELSE c_name END AS sender,
           CASE WHEN o_orderkey % 3 = 0 THEN c_name ELSE s_name END AS recipient,
           o_orderpriority AS doc_type, CAST(o_custkey AS VARCHAR) AS contract_ref, n_name AS project, refs, topics
    FROM (SELECT l_orderkey, min(l_suppkey) AS sk, list_sort(list(DISTINCT l_partkey)) AS refs, list_sort(list(DISTINCT p_type)) AS topics
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) per
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON sk = s_suppkey JOIN nation ON c_nationkey = n_nationkey)"""


def event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated events of documents and actors."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 37).alias("doc_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_sort"),
        "ts",
        "event_type",
        F.concat(F.lit("actor"), F.col("user_id").cast("string")).alias("actor"),
        F.get_json_object("props", "$.k").cast("long").alias("severity"),
        F.round("value", 6).alias("value"),
    )


EVENT_STORE = """event_store AS (
    SELECT event_id, user_id % 37 AS doc_id, strftime(ts, '%Y-%m-%d') AS date_sort, ts, event_type,
           'actor' || CAST(user_id AS VARCHAR) AS actor, CAST(json_extract_string(props, '$.k') AS BIGINT) AS severity, round(value, 6) AS value
    FROM events)"""


#: Characters of a chunk and how far the next one starts after it.
CHUNK, STRIDE = 1024, 824


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of the documents' texts, scoped by project (source) and corpus (language)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("project_id"), F.col("lang").alias("corpus"))
    return windows(docs, CHUNK, STRIDE)


CHUNKS = f"""chunks AS (
    SELECT doc_id, source AS project_id, lang AS corpus, CAST(p AS BIGINT) AS page, substr(text, CAST(p * {STRIDE} + 1 AS BIGINT), {CHUNK}) AS text
    FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil((length(text) - {CHUNK - STRIDE}) / {STRIDE}.0) AS BIGINT)))) AS p FROM documents WHERE text IS NOT NULL))"""


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_YEARS = tuple(range(1992, 2002))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer ordered by priority and year, in cents less an even share: ``vec_id, grp, embedding``."""
    o = table(spark, sf_dir, "orders").filter("o_custkey is not null").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    cells = [F.coalesce(F.sum(F.when((F.col("o_orderpriority") == p) & (F.year("o_orderdate") == y), F.col("cents"))), F.lit(0)) for p in _PRIORITIES for y in _YEARS]
    even = [(len(cells) * x - F.coalesce(F.sum("cents"), F.lit(0))).cast("double") for x in cells]
    return o.groupBy(F.col("o_custkey").alias("vec_id")).agg(F.array(*even).alias("embedding")).withColumn("grp", F.col("vec_id") % 5)


_CELLS = ", ".join(f"CAST({len(_PRIORITIES) * len(_YEARS)} * coalesce(sum(cents) FILTER (o_orderpriority = '{p}' AND year(o_orderdate) = {y}), 0) - coalesce(sum(cents), 0) AS DOUBLE)" for p in _PRIORITIES for y in _YEARS)
PROFILES = f"""orders_by AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_custkey IS NOT NULL),
    profiles AS (SELECT o_custkey AS vec_id, o_custkey % 5 AS grp, [{_CELLS}] AS embedding FROM orders_by GROUP BY o_custkey)"""
