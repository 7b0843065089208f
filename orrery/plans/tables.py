"""Queries that normalise, check and unite tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.dates import mixed_date, sortable
from orrery.operators import normalise, schema, unions
from orrery.plans.registry import query
from orrery.plans.templates import number
from orrery.plans.views import DAILY_LOG, daily_log, table

RAW_SHEET = (
    "WITH "
    + DAILY_LOG
    + """, later AS (SELECT * REPLACE (CAST(work_date + 4000 AS DATE) AS work_date) FROM daily_log), raw_sheet AS (
    SELECT rec_id, rec_line, CASE rec_id % 5
             WHEN 0 THEN strftime(work_date, '%-d.%m.%Y') WHEN 1 THEN strftime(work_date, '%Y/%m/%d')
             WHEN 2 THEN strftime(work_date, '%d-%b-%Y') WHEN 3 THEN strftime(work_date, '%m/%d/%Y')
             ELSE CAST(CAST(epoch(CAST(work_date AS TIMESTAMP)) AS BIGINT) AS VARCHAR) END AS date_text,
           strftime(work_date, '%B %Y') AS month_text,
           CASE WHEN rec_id % 97 = 0 THEN 'Grand Total' ELSE item END AS item, hours,
           CAST(rec_id % 101 AS VARCHAR) || '.5%' AS pct, work_date
    FROM later)"""
)


def raw_sheet(spark, sf_dir):
    """The work log as it comes from spreadsheets: dates in five layouts, rows of totals, percentages as text."""
    d, at = daily_log(spark, sf_dir).withColumn("work_date", F.date_add("work_date", 4000)), F.col("work_date")  # an epoch of ten digits
    layouts = ["d.MM.yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "MM/dd/yyyy"]
    text = F.unix_seconds(at.cast("timestamp")).cast("string")
    for i, layout in enumerate(layouts):
        text = F.when(F.col("rec_id") % 5 == i, F.date_format(at, layout)).otherwise(text)
    return d.select(
        "rec_id", "rec_line", text.alias("date_text"), F.date_format(at, "MMMM yyyy").alias("month_text"),
        F.when(F.col("rec_id") % 97 == 0, "Grand Total").otherwise(F.col("item")).alias("item"), "hours",
        F.concat((F.col("rec_id") % 101).cast("string"), F.lit(".5%")).alias("pct"), "work_date",
    )


def _normal(spark, sf_dir):
    return normalise.normalised(raw_sheet(spark, sf_dir), "month_text")


@query("norm_total_rows", RAW_SHEET + " SELECT count(*) AS total_rows FROM raw_sheet WHERE lower(item) LIKE '%total%'")
def norm_total_rows(spark, sf_dir):
    return _normal(spark, sf_dir).filter("is_total_row").agg(F.count("*").alias("total_rows"))


@query("norm_clean", RAW_SHEET + " SELECT item, count(*) AS n, round(sum(hours), 2) AS hours FROM raw_sheet WHERE lower(item) NOT LIKE '%total%' GROUP BY item")
def norm_clean(spark, sf_dir):
    return normalise.clean(_normal(spark, sf_dir)).groupBy("item").agg(F.count("*").alias("n"), F.round(F.sum("hours"), 2).alias("hours"))


@query("norm_month_year_key", RAW_SHEET + " SELECT CAST(month(work_date) AS INTEGER) AS month_num, CAST(year(work_date) AS INTEGER) AS year, strftime(work_date, '%Y-%m') AS date_key, count(*) AS n FROM raw_sheet GROUP BY ALL")
def norm_month_year_key(spark, sf_dir):
    return _normal(spark, sf_dir).groupBy("month_num", "year", "date_key").agg(F.count("*").alias("n"))


@query("norm_mixed_dates", RAW_SHEET + " SELECT rec_id, rec_line, date_text, CAST(work_date AS DATE) AS parsed FROM raw_sheet")
def norm_mixed_dates(spark, sf_dir):
    return raw_sheet(spark, sf_dir).select("rec_id", "rec_line", "date_text", mixed_date(F.col("date_text")).alias("parsed"))


@query("norm_sortable_dates", RAW_SHEET + " SELECT month_text, strftime(work_date, '%Y-%m') || '-00' AS date_sort, count(*) AS n FROM raw_sheet GROUP BY ALL")
def norm_sortable_dates(spark, sf_dir):
    return raw_sheet(spark, sf_dir).groupBy("month_text", sortable(F.col("month_text")).alias("date_sort")).agg(F.count("*").alias("n"))


_MONTHS = RAW_SHEET + " SELECT CAST(month(work_date) AS INTEGER) AS month_num, round(sum(hours), 2) AS amount FROM raw_sheet WHERE lower(item) NOT LIKE '%total%' GROUP BY 1 ORDER BY 2 {}, 1 LIMIT 1"


@query("month_best", _MONTHS.format("DESC"))
def month_best(spark, sf_dir):
    return normalise.best_month(_normal(spark, sf_dir), "hours")


@query("month_worst", _MONTHS.format("ASC"))
def month_worst(spark, sf_dir):
    return normalise.best_month(_normal(spark, sf_dir), "hours", worst=True)


@query("pct_text_parse", RAW_SHEET + " SELECT count(*) AS n, count(TRY_CAST(rtrim(pct, '%') AS DOUBLE)) AS parsed, round(sum(TRY_CAST(rtrim(pct, '%') AS DOUBLE)), 2) AS total FROM raw_sheet")
def pct_text_parse(spark, sf_dir):
    return raw_sheet(spark, sf_dir).agg(F.count("*").alias("n"), F.count(number("pct")).alias("parsed"), F.round(F.sum(number("pct")), 2).alias("total"))


LOG_SCHEMA = schema.TargetSchema(
    "equipment_log",
    (schema.ColumnDef("Date", "date", aliases=("date_text",)), schema.ColumnDef("Machinery Name", "string", aliases=("item", "machine")), schema.ColumnDef("Estimated Machinery Hours", "float", aliases=("hours",)), schema.ColumnDef("Share", "float", False, ("pct",)), schema.ColumnDef("Remark", "string", False)),
)


@query("schema_cast", RAW_SHEET + """ SELECT CAST(work_date AS DATE) AS "Date", item AS "Machinery Name", hours AS "Estimated Machinery Hours", CAST(rtrim(pct, '%') AS DOUBLE) AS "Share", '' AS "Remark" FROM raw_sheet""")
def schema_cast(spark, sf_dir):
    return schema.converted(raw_sheet(spark, sf_dir).drop("rec_id", "rec_line", "month_text", "work_date"), LOG_SCHEMA)


@query("schema_violations", f"""WITH {DAILY_LOG} SELECT * FROM (
    SELECT 'negative_hours' AS rule, count(*) FILTER (hours < 0) AS rows FROM daily_log
    UNION ALL SELECT 'no_output', count(*) FILTER (output <= 0) FROM daily_log
    UNION ALL SELECT 'hours_over_24', count(*) FILTER (hours > 24) FROM daily_log)""")
def schema_violations(spark, sf_dir):
    return schema.violations(daily_log(spark, sf_dir), {"negative_hours": "hours < 0", "no_output": "output <= 0", "hours_over_24": "hours > 24"})


@query("completeness", """SELECT * FROM (
    SELECT 'lang' AS column_name, round(avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END) * 100, 3) AS null_pct FROM documents
    UNION ALL SELECT 'source', round(avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0.0 END) * 100, 3) FROM documents
    UNION ALL SELECT 'quality', round(avg(CASE WHEN quality IS NULL THEN 1.0 ELSE 0.0 END) * 100, 3) FROM documents LEFT JOIN labels USING (doc_id))""")
def completeness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return schema.completeness(docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").drop("doc_id"))


@query("profile_log", f"""WITH {DAILY_LOG} SELECT min(hours) AS min_hours, max(hours) AS max_hours, round(avg(hours), 2) AS mean_hours, round(sum(hours), 2) AS sum_hours,
    count(DISTINCT item) AS distinct_item, count(DISTINCT activity) AS distinct_activity FROM daily_log""")
def profile_log(spark, sf_dir):
    return schema.profile(daily_log(spark, sf_dir), ["hours"], ["item", "activity"])


@query("top5_values", f"WITH {DAILY_LOG} SELECT activity, count(*) AS n FROM daily_log GROUP BY activity ORDER BY n DESC, activity LIMIT 5")
def top5_values(spark, sf_dir):
    return schema.top_values(daily_log(spark, sf_dir), "activity")


@query("anomaly_zero", "SELECT count(*) FILTER (l_discount = 0) AS zero_discounts, count(*) FILTER (l_tax = 0) AS zero_taxes FROM lineitem")
def anomaly_zero(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_discount") == 0).alias("zero_discounts"), F.count_if(F.col("l_tax") == 0).alias("zero_taxes"))


@query("anomaly_single", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1")
def anomaly_single(spark, sf_dir):
    return schema.singles(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("anomaly_gap", """WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS gap_to FROM orders WHERE o_orderdate IS NOT NULL),
    g AS (SELECT o_custkey, gap_to, lag(gap_to) OVER (PARTITION BY o_custkey ORDER BY gap_to) AS gap_from FROM d)
    SELECT o_custkey, gap_from, gap_to, CAST(gap_to - gap_from AS BIGINT) AS gap_days FROM g WHERE gap_to - gap_from > 7""")
def anomaly_gap(spark, sf_dir):
    return schema.gaps(table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), "day", by=["o_custkey"])


@query("month_coverage", f"WITH {DAILY_LOG} SELECT min(strftime(work_date, '%Y-%m')) AS first_month, max(strftime(work_date, '%Y-%m')) AS last_month, count(DISTINCT strftime(work_date, '%Y-%m')) AS months FROM daily_log")
def month_coverage(spark, sf_dir):
    month = F.date_format("work_date", "yyyy-MM")
    return daily_log(spark, sf_dir).agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"), F.count_distinct(month).alias("months"))


def _blocks(spark, sf_dir):
    log = daily_log(spark, sf_dir)
    return {b: log.filter(F.col("block") == b).drop("block") for b in ("A", "N", "R")}


@query("sheets_combined", f"WITH {DAILY_LOG} SELECT block AS _sheet_name, count(*) AS n, round(sum(hours), 2) AS hours FROM daily_log WHERE block IN ('A', 'N', 'R') GROUP BY block")
def sheets_combined(spark, sf_dir):
    return unions.sheets(_blocks(spark, sf_dir)).groupBy("_sheet_name").agg(F.count("*").alias("n"), F.round(F.sum("hours"), 2).alias("hours"))


@query("files_grouped", f"WITH {DAILY_LOG} SELECT 'c1' AS corpus, block AS _source_table, count(*) AS n FROM daily_log WHERE block IN ('A', 'N') GROUP BY block")
def files_grouped(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    found, _ = unions.grouped({("c1", "log", "A"): b["A"], ("c1", "log", "N"): b["N"], ("c1", "log", "other"): b["A"].drop("unit"), ("c2", "log", "R"): b["R"]})
    return found["c1", "log"].groupBy(F.lit("c1").alias("corpus"), "_source_table").agg(F.count("*").alias("n"))


@query("schema_unified", f"WITH {DAILY_LOG} SELECT block AS _source_table, count(*) AS n, round(sum(output), 2) AS output FROM daily_log WHERE block IN ('A', 'R') GROUP BY block")
def schema_unified(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    return unions.common({"A": b["A"].drop("hours"), "R": b["R"].drop("unit")}).groupBy("_source_table").agg(F.count("*").alias("n"), F.round(F.sum("output"), 2).alias("output"))


@query("period_union", f"WITH {DAILY_LOG} SELECT block AS period, item, round(sum(hours), 2) AS hours FROM daily_log WHERE block IN ('A', 'N', 'R') GROUP BY 1, 2")
def period_union(spark, sf_dir):
    return unions.periods(_blocks(spark, sf_dir)).groupBy("period", "item").agg(F.round(F.sum("hours"), 2).alias("hours"))


@query("search_priority_union", """WITH s AS (
      SELECT c_custkey AS id, 0 AS p, 'registry' AS source_name, c_name AS title FROM customer WHERE c_acctbal > 5000
      UNION ALL SELECT c_custkey, 1, 'catalog', c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'
      UNION ALL SELECT o_custkey, 2, 'orders', o_orderpriority FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, title) AS k FROM s)
    SELECT id, source_name, title FROM r WHERE k = 1""")
def search_priority_union(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    sources = [
        ("registry", c.filter("c_acctbal > 5000").selectExpr("c_custkey AS id", "c_name AS title")),
        ("catalog", c.filter("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS id", "c_mktsegment AS title")),
        ("orders", o.selectExpr("o_custkey AS id", "o_orderpriority AS title")),
    ]
    return unions.first_source_wins(sources, "id", "title")


@query("unpivot_shift_ffill", """WITH wide AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS contractor, o_custkey % 7 AS day_shift, o_custkey % 4 AS night_shift, o_orderstatus AS zone FROM orders),
    filled AS (SELECT *, last_value(contractor IGNORE NULLS) OVER (PARTITION BY zone ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS who FROM wide),
    long AS (SELECT who, 'day_shift' AS shift, day_shift AS workers FROM filled UNION ALL SELECT who, 'night_shift', night_shift FROM filled)
    SELECT who AS contractor, shift, CAST(sum(workers) AS BIGINT) AS workers FROM long WHERE workers > 0 GROUP BY 1, 2""")
def unpivot_shift_ffill(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("contractor"), (F.col("o_custkey") % 7).alias("day_shift"), (F.col("o_custkey") % 4).alias("night_shift"), F.col("o_orderstatus").alias("zone"))
    filled = normalise.forward_filled(wide, "contractor", ["zone"], ["o_orderkey"])
    return normalise.shifts_to_long(filled, ["contractor"], ["day_shift", "night_shift"]).groupBy("contractor", "shift").agg(F.sum("workers").alias("workers"))
