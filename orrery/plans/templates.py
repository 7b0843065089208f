"""The fixed question templates over the work log and the contract items.

A template is a pattern over the question, and an aggregate. Questions are
matched in order and the first match wins: counts before breakdowns, breakdowns
before totals, so "total hours by block" is answered by block. Nothing from the
question is spliced into a query.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.plans.registry import query
from orrery.plans.views import DAILY_LOG, IPC, daily_log, ipc


def number(column: str) -> Column:
    """A column as a double; text that is no number is null, and a percent sign at its end is dropped."""
    return F.expr(f"try_cast(regexp_replace(trim(cast(`{column}` AS STRING)), '%$', '') AS DOUBLE)")


def total(column: str) -> Column:
    return F.round(F.sum(F.expr(f"try_cast(`{column}` AS DOUBLE)")), 2)


def by(frame: DataFrame, keys: list[str], order: list[Column], **aggregates: Column) -> DataFrame:
    return frame.groupBy(*keys).agg(*(v.alias(k) for k, v in aggregates.items())).orderBy(*order)


def distinct_list(column: str) -> Column:
    """The distinct values as one comma-separated text, in order."""
    return F.array_join(F.sort_array(F.collect_set(column)), ",")


@dataclass(frozen=True)
class Template:
    """One question template: name, schema it belongs to, pattern of the question, builder over the schema's view, and SQL over it."""

    name: str
    schema: str
    pattern: str
    build: Callable[[DataFrame], DataFrame]
    sql: str


def _t(column: str) -> str:
    return f"TRY_CAST({column} AS DOUBLE)"


def _share(part: str, whole: str) -> Column:
    return F.round(F.sum(number(part)) / F.nullif(F.sum(number(whole)), F.lit(0.0)) * 100, 2)


def _top(key: str, value: str) -> list[Column]:
    return [F.desc(value), F.asc(key)]


#: Half a cent counts as a whole one, whatever the last binary digit of a product.
HALF = 1e-7
_SUM_HOURS = f"round(sum({_t('hours')}), 2)"

TEMPLATES: list[Template] = [
    Template("log_distinct_blocks", "equipment_log", r"how many.*blocks", lambda d: d.agg(F.count_distinct("block").alias("blocks")), "SELECT count(DISTINCT block) AS blocks FROM daily_log"),
    Template("log_distinct_floors", "equipment_log", r"how many.*floors", lambda d: d.agg(F.count_distinct("floor").alias("floors")), "SELECT count(DISTINCT floor) AS floors FROM daily_log"),
    Template("log_floor_item", "equipment_log", r"floor.*(machine|equipment)|(machine|equipment).*floor", lambda d: by(d, ["floor", "item"], [F.asc("floor"), F.desc("total_hours"), F.asc("item")], total_hours=total("hours")), f"SELECT floor, item, {_SUM_HOURS} AS total_hours FROM daily_log GROUP BY floor, item"),
    Template("log_by_block", "equipment_log", r"hours?.*block|block.*hours?", lambda d: by(d, ["block"], _top("block", "total_hours"), total_hours=total("hours")), f"SELECT block, {_SUM_HOURS} AS total_hours FROM daily_log GROUP BY block"),
    Template("log_item_list", "equipment_log", r"(which|list|how many).*(machines|equipment)", lambda d: d.agg(F.count_distinct("item").alias("items"), distinct_list("item").alias("item_list")), "SELECT count(DISTINCT item) AS items, string_agg(DISTINCT item, ',' ORDER BY item) AS item_list FROM daily_log"),
    Template("log_avg_active_days", "equipment_log", r"(average|avg|daily).*(machine|equipment|hours)", lambda d: by(d, ["item"], _top("item", "avg_hours"), avg_hours=F.round(F.avg(F.expr("try_cast(hours AS DOUBLE)")), 2), active_days=F.count_distinct("work_date")), f"SELECT item, round(avg({_t('hours')}), 2) AS avg_hours, count(DISTINCT work_date) AS active_days FROM daily_log GROUP BY item"),
    Template("log_total", "equipment_log", r"total.*hours", lambda d: d.agg(total("hours").alias("total_hours")), f"SELECT {_SUM_HOURS} AS total_hours FROM daily_log"),
    Template("log_by_item", "equipment_log", r"hours|machine|equipment|utili[sz]ation", lambda d: by(d, ["item"], _top("item", "total_hours"), total_hours=total("hours")), f"SELECT item, {_SUM_HOURS} AS total_hours FROM daily_log GROUP BY item"),
    Template("wk_distinct_activities", "manpower_production", r"how many.*activit", lambda d: d.agg(F.count_distinct("activity").alias("activities")), "SELECT count(DISTINCT activity) AS activities FROM daily_log"),
    Template("wk_productivity", "manpower_production", r"productivity|per worker", lambda d: by(d, ["activity"], [F.desc("productivity"), F.asc("activity")], productivity=F.round(F.sum(F.expr("try_cast(output AS DOUBLE)")) / F.nullif(F.sum("hours"), F.lit(0.0)), 2), unit=F.min("unit"), workers=F.round(F.sum("hours"), 2)), f"SELECT activity, round(sum({_t('output')}) / nullif(sum(hours), 0), 2) AS productivity, min(unit) AS unit, round(sum(hours), 2) AS workers FROM daily_log GROUP BY activity"),
    Template("wk_avg_daily", "manpower_production", r"average.*(workers|manpower)", lambda d: d.agg(F.round(F.sum("hours") / F.nullif(F.count_distinct("work_date").cast("double"), F.lit(0.0)), 1).alias("avg_workers")), "SELECT round(sum(hours) * 1.0 / nullif(count(DISTINCT work_date), 0), 1) AS avg_workers FROM daily_log"),
    Template("wk_daily", "manpower_production", r"(daily|per day|trend).*", lambda d: by(d, ["work_date"], [F.asc_nulls_last("work_date")], workers=F.round(F.sum("hours"), 2)), "SELECT work_date, round(sum(hours), 2) AS workers FROM daily_log GROUP BY work_date"),
    Template("wk_block_activity", "manpower_production", r"block", lambda d: by(d, ["block"], _top("block", "workers"), workers=F.round(F.sum("hours"), 2), activities=F.count_distinct("activity")), "SELECT block, round(sum(hours), 2) AS workers, count(DISTINCT activity) AS activities FROM daily_log GROUP BY block"),
    Template("wk_trade_list", "manpower_production", r"(which|list|how many).*trades", lambda d: d.agg(F.count_distinct("item").alias("trades"), distinct_list("item").alias("trade_list")), "SELECT count(DISTINCT item) AS trades, string_agg(DISTINCT item, ',' ORDER BY item) AS trade_list FROM daily_log"),
    Template("wk_output_unit", "manpower_production", r"(output|quantity).*(trade|job)", lambda d: by(d, ["item"], _top("item", "output"), output=total("output"), unit=F.min("unit")), f"SELECT item, round(sum({_t('output')}), 2) AS output, min(unit) AS unit FROM daily_log GROUP BY item"),
    Template("wk_by_activity", "manpower_production", r"activit", lambda d: by(d, ["activity"], _top("activity", "workers"), workers=F.round(F.sum("hours"), 2)), "SELECT activity, round(sum(hours), 2) AS workers FROM daily_log GROUP BY activity"),
    Template("wk_total", "manpower_production", r"total.*(workers|manpower)", lambda d: d.agg(F.round(F.sum("hours"), 2).alias("workers")), "SELECT round(sum(hours), 2) AS workers FROM daily_log"),
    Template("wk_by_trade", "manpower_production", r"trade|workers|manpower", lambda d: by(d, ["item"], _top("item", "workers"), workers=F.round(F.sum("hours"), 2)), "SELECT item, round(sum(hours), 2) AS workers FROM daily_log GROUP BY item"),
    Template("ipc_progress", "ipc_sample", r"(overall|total)?.*progress", lambda d: d.agg(_share("cum_amt", "total").alias("progress_pct"), F.round(F.sum(number("cum_amt")), 2).alias("earned"), F.round(F.sum(number("total")), 2).alias("amount")), f"SELECT round(sum({_t('cum_amt')}) / nullif(sum({_t('total')}), 0) * 100, 2) AS progress_pct, round(sum({_t('cum_amt')}), 2) AS earned, round(sum({_t('total')}), 2) AS amount FROM ipc"),
    Template("ipc_remaining", "ipc_sample", r"remaining|outstanding", lambda d: d.filter(number("cum_pct") < 100).select("code", F.round(number("total") - number("cum_amt") + HALF, 2).alias("remaining"), F.round(100 - number("cum_pct"), 2).alias("remaining_pct")), f"SELECT code, round({_t('total')} - {_t('cum_amt')} + 1e-7, 2) AS remaining, round(100 - {_t('cum_pct')}, 2) AS remaining_pct FROM ipc WHERE {_t('cum_pct')} < 100"),
    Template("ipc_not_started", "ipc_sample", r"not started", lambda d: d.filter((number("cum_pct") == 0) | number("cum_pct").isNull()).select("code", "name"), f"SELECT code, name FROM ipc WHERE {_t('cum_pct')} = 0 OR {_t('cum_pct')} IS NULL"),
    Template("ipc_completed", "ipc_sample", r"complete", lambda d: d.filter(number("cum_pct") >= 100).select("code", "name"), f"SELECT code, name FROM ipc WHERE {_t('cum_pct')} >= 100"),
    Template("ipc_period", "ipc_sample", r"(this|current) (period|month)", lambda d: d.agg(_share("cur_amt", "total").alias("period_pct"), F.round(F.sum(number("cur_amt")), 2).alias("period_amount")), f"SELECT round(sum({_t('cur_amt')}) / nullif(sum({_t('total')}), 0) * 100, 2) AS period_pct, round(sum({_t('cur_amt')}), 2) AS period_amount FROM ipc"),
    Template("ipc_top", "ipc_sample", r"(top|largest|highest).*(item|activit)", lambda d: d.select("code", "name", F.round(number("total"), 2).alias("amount")).orderBy(F.desc("amount"), "code"), f"SELECT code, name, round({_t('total')}, 2) AS amount FROM ipc"),
    Template("ipc_count", "ipc_sample", r"how many.*(item|activit)", lambda d: d.agg(F.count("*").alias("items")), "SELECT count(*) AS items FROM ipc"),
    Template("ipc_total", "ipc_sample", r"(contract|total).*(amount|value|boq)", lambda d: d.agg(F.round(F.sum(number("total")), 2).alias("amount")), f"SELECT round(sum({_t('total')}), 2) AS amount FROM ipc"),
]

_VIEWS = {"equipment_log": (daily_log, DAILY_LOG), "manpower_production": (daily_log, DAILY_LOG), "ipc_sample": (ipc, IPC)}


def match(question: str, schema: str) -> Template | None:
    """The first template of a schema whose pattern the question matches, or None."""
    return next((t for t in TEMPLATES if t.schema == schema and re.search(t.pattern, question, re.IGNORECASE)), None)


def answer(question: str, schema: str, frame: DataFrame) -> DataFrame | None:
    """The template's result over a table of the schema; None when no template fits."""
    found = match(question, schema)
    return None if found is None else found.build(frame)


def _register(t: Template) -> None:
    view, text = _VIEWS[t.schema]
    query(t.name, f"WITH {text} {t.sql}")(lambda spark, sf_dir: t.build(view(spark, sf_dir)))


for _template in TEMPLATES:
    _register(_template)
