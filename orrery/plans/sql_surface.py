"""Analytic SQL that users write: each query runs guarded, from the same text that a SQL engine would get."""

from __future__ import annotations

from orrery.plans.guard import run_sql
from orrery.plans.registry import query
from orrery.plans.views import DAILY_LOG, IPC, daily_log, ipc, table

_DRIVER = ("customer", "orders", "lineitem", "events", "nation", "region", "supplier", "part")

SURFACE = {
    "pct_of_total": "SELECT activity, round(100 * sum(hours) / sum(sum(hours)) OVER (), 2) AS pct FROM daily_log GROUP BY activity",
    "running_total": "SELECT work_date, round(sum(sum(hours)) OVER (ORDER BY work_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total FROM daily_log WHERE block = 'A' GROUP BY work_date",
    "rank_metric": "SELECT item, round(sum(hours), 2) AS hours, CAST(rank() OVER (ORDER BY round(sum(hours), 2) DESC) AS BIGINT) AS place FROM daily_log GROUP BY item",
    "above_average": "WITH t AS (SELECT item, sum(hours) AS h FROM daily_log GROUP BY item), a AS (SELECT avg(h) AS m FROM t) SELECT item, round(h, 2) AS hours FROM t CROSS JOIN a WHERE h > m",
    "cond_agg": "SELECT block, CAST(sum(CASE WHEN hours > 25 THEN 1 ELSE 0 END) AS BIGINT) AS long_days, count(*) AS n FROM daily_log GROUP BY block HAVING count(*) > 1",
    "period_compare": "SELECT item, round(sum(CASE WHEN year(work_date) = 1996 THEN hours ELSE 0 END), 2) AS before, round(sum(CASE WHEN year(work_date) = 1997 THEN hours ELSE 0 END), 2) AS after FROM daily_log GROUP BY item",
    "outliers_2sigma": "WITH t AS (SELECT work_date, sum(hours) AS h FROM daily_log GROUP BY work_date), s AS (SELECT avg(h) AS m, stddev_samp(h) AS sd FROM t) SELECT work_date, round(h, 2) AS hours FROM t CROSS JOIN s WHERE abs(h - m) > 2 * sd",
    "monthly_trend": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1",
    "peak_days": "SELECT work_date, round(sum(hours), 2) AS hours FROM daily_log GROUP BY work_date ORDER BY hours DESC, work_date LIMIT 10",
    "idle_items": "SELECT p.p_brand AS item, count(*) AS parts FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey WHERE l.l_partkey IS NULL GROUP BY 1",
    "utilisation_by_place": "SELECT block, floor, round(sum(hours) / count(DISTINCT work_date), 2) AS per_day FROM daily_log GROUP BY block, floor",
    "hours_flag": "SELECT work_date, item, round(sum(hours), 2) AS hours, CASE WHEN sum(hours) > 100 THEN 'over' ELSE 'ok' END AS flag FROM daily_log WHERE block = 'R' GROUP BY work_date, item",
    "near_complete": "SELECT code, cum_pct FROM ipc WHERE cum_pct BETWEEN 90 AND 99.99",
    "zero_progress": "SELECT count(*) AS n FROM ipc WHERE coalesce(nullif(cum_pct, 0), 0) = 0",
    "weighted_progress": "SELECT period, round(sum(cum_amt) / nullif(sum(total), 0) * 100, 3) AS pct, round(sum(total) / sum(sum(total)) OVER () * 100, 3) AS weight FROM ipc GROUP BY period",
    "period_movers": "SELECT code, round(cur_amt + 0.0000001, 2) AS moved FROM ipc ORDER BY cur_amt DESC, code LIMIT 20",
    "prev_month_of_max": "WITH m AS (SELECT date_trunc('month', max(o_orderdate)) AS last_month FROM orders) SELECT count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders CROSS JOIN m WHERE o_orderdate >= last_month - INTERVAL '1' MONTH AND o_orderdate < last_month",
    "rollup_block_floor": "SELECT block, floor, round(sum(hours), 2) AS hours, CAST(grouping(block) + grouping(floor) AS BIGINT) AS level FROM daily_log GROUP BY ROLLUP (block, floor)",
    "cube_flags": "SELECT block, floor, count(*) AS n FROM daily_log GROUP BY CUBE (block, floor)",
    "grouping_sets": "SELECT block, item, count(*) AS n FROM daily_log GROUP BY GROUPING SETS ((block), (item), ())",
    "union_ids": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_ids": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "except_ids": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "semi_customers": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)",
    "anti_customers": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "in_subquery": "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "correlated_counts": "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders, (SELECT round(sum(o_totalprice), 2) FROM orders o WHERE o.o_custkey = c.c_custkey) AS spent FROM customer c",
    "inner_star": "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2",
    "left_right_full": "SELECT count(*) AS n, count(c_custkey) AS with_customer, count(s_suppkey) AS with_supplier FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey * 10",
    "lateral_latest": "SELECT c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) t",
    "window_frames": "SELECT o_orderkey, CAST(ntile(4) OVER w AS BIGINT) AS quarter, lead(o_orderkey) OVER w AS following, first_value(o_orderkey) OVER w AS first_key, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) + 0.0000001, 2) AS smooth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "extract_parts": "SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q, count(*) AS n FROM orders GROUP BY 1, 2",
    "like_ilike": "SELECT count(*) AS n FROM customer WHERE c_name LIKE '%1%' AND c_mktsegment ILIKE 'build%'",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY 1, 2 LIMIT 50",
    "recursive_days": "WITH RECURSIVE d(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM d WHERE n < 12) SELECT CAST(n AS BIGINT) AS n, count(o_orderkey) AS orders FROM d LEFT JOIN orders ON month(o_orderdate) = n GROUP BY 1",
    "string_list": "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS kinds FROM customer GROUP BY c_nationkey",
    "best_per_group": "SELECT l_returnflag, max_by(l_orderkey, l_extendedprice * 1000000 + l_orderkey) AS top_order FROM lineitem GROUP BY l_returnflag",
}

#: What Spark is given in place of a text: it orders a lateral query's rows only by columns that this selects, and puts null keys first.
_SPARK = {
    "lateral_latest": "SELECT c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey, o_orderdate FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey NULLS LAST LIMIT 1) t",
}


def _register(name: str, sql: str) -> None:
    text = sql
    for view in (DAILY_LOG, IPC):
        if view.split(" ", 1)[0] in sql:
            text = f"WITH {view} SELECT * FROM ({sql})"

    def run(spark, sf_dir):
        frames = {t: table(spark, sf_dir, t) for t in _DRIVER if t in sql}
        frames |= {n: f(spark, sf_dir) for n, f in (("daily_log", daily_log), ("ipc", ipc)) if n in sql}
        return run_sql(spark, _SPARK.get(name, sql), frames)

    query(name, text)(run)


for _name, _sql in SURFACE.items():
    _register(_name, _sql)
