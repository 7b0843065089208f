"""Guarded SQL: one SELECT over named tables, checked on the parsed plan.

The check walks Spark's own parse of the statement, so names in literals,
comments and quoted identifiers are what the engine takes them for: a second
table of a comma join is seen, and a word in a string is not.
"""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

# The plan nodes that a read-only query may have.
_NODES = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except",
    "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "OneRowRelation", "LocalRelation", "UnresolvedInlineTable", "UnresolvedHaving",
    "WithWindowDefinition", "Generate", "LateralJoin", "Pivot", "Unpivot", "UnresolvedSubqueryColumnAliases", "Window", "UnresolvedOrderBy",
    "UnresolvedPivot", "ResolvedInlineTable", "Deduplicate",
}
# Functions that reach outside the tables.
_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "read_files", "session_user", "current_user", "user", "version", "raise_error"}
#: Words of a question that ask for a part of the groups only.
_SUBSET = re.compile(r"\b(top|bottom|first|last|limit|highest|lowest|best|worst|most|least|only|\d+)\b", re.IGNORECASE)


class Refused(ValueError):
    """A statement that may not run."""


def strip_fences(sql: str) -> str:
    """The statement without a Markdown fence and a last semicolon."""
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", sql.strip())
    return body.strip().rstrip(";").strip()


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _simple(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _walk(node, names: set[str], plans: list, expressions: list) -> None:
    plans.append(node)
    if _simple(node) == "UnresolvedWith":
        for pair in _items(node.cteRelations()):
            names.add(pair.productElement(0).lower())
            _walk(pair.productElement(1), names, plans, expressions)
    for e in _items(node.expressions()):
        _walk_expression(e, names, plans, expressions)
    for c in _items(node.children()):
        _walk(c, names, plans, expressions)


def _walk_expression(e, names: set[str], plans: list, expressions: list) -> None:
    expressions.append(e)
    if _simple(e) in {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "UnresolvedTableArgPlanId", "FunctionTableSubqueryArgumentExpression"}:
        _walk(e.plan(), names, plans, expressions)
    for c in _items(e.children()):
        _walk_expression(c, names, plans, expressions)


def violation(spark: SparkSession, sql: str, allowed: set[str]) -> str | None:
    """Why a statement may not run over the allowed tables, or None.

    Refused: what does not parse as one statement, anything but a query,
    relations that are not allowed names or the statement's own, names of
    several parts (paths and catalogs), table functions, and functions that
    reach outside.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        return f"it does not parse: {e.getCondition()}"
    names, plans, expressions = set(), [], []
    _walk(plan, names, plans, expressions)
    known = {a.lower() for a in allowed} | names
    for node in plans:
        kind = _simple(node)
        if kind not in _NODES:
            return f"{kind} is no part of a read-only query"
        if kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in known:
                return f"unknown table {'.'.join(parts)}"
    for e in expressions:
        if _simple(e) == "UnresolvedFunction" and _items(e.nameParts())[-1].lower() in _FUNCTIONS:
            return f"function {_items(e.nameParts())[-1]} is not allowed"
    return None


def loses_order(frame: DataFrame) -> bool:
    """Whether a subquery that depends on its outer row has a limit and is ordered by what it does not select.

    Spark numbers such a subquery's rows for the limit after an exchange that
    forgets their order, so which ones stay is chance.
    """
    plans, expressions = [], []
    _walk(frame._jdf.queryExecution().analyzed(), set(), plans, expressions)
    held: list = []
    for e in expressions:
        if _simple(e) in {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"} and not e.outerAttrs().isEmpty():
            _walk(e.plan(), set(), held, [])
    for node in held:
        below = node.child() if _simple(node) == "LocalLimit" else None
        while below is not None and _simple(below) in {"Project", "SubqueryAlias"}:
            below = below.child()
            if _simple(below) == "Sort":
                return True
    return False


def without_stray_limit(spark: SparkSession, sql: str, question: str) -> str:
    """Drops the last LIMIT of a grouped query when the question asks for no part of the groups."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if _simple(plan) != "GlobalLimit" or _SUBSET.search(question):
        return sql
    plans: list = []
    _walk(plan, set(), plans, [])
    if not any(_simple(p) == "Aggregate" for p in plans):
        return sql
    return re.sub(r"\s+LIMIT\s+\d+\s*$", "", sql, flags=re.IGNORECASE)


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], question: str | None = None) -> DataFrame:
    """Runs a guarded statement over the given tables and no others.

    The tables are views of a session of their own, so nothing else has a name
    there, and double quotes mark identifiers. A statement whose limit would
    take rows out of order is refused as well.
    """
    sql = strip_fences(sql)
    own = spark.newSession()
    for key, value in {"spark.sql.runSQLOnFiles": "false", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.session.timeZone": "UTC"}.items():
        own.conf.set(key, value)
    if (why := violation(own, sql, set(tables))) is not None:
        raise Refused(why)
    if question is not None:
        sql = without_stray_limit(own, sql, question)
    for name, frame in tables.items():
        # the frame's plan moves to the other session, which shares catalogs, caches and executors with this one
        DataFrame(own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, frame._jdf.logicalPlan()), own).createOrReplaceTempView(name)
    frame = own.sql(sql)
    if loses_order(frame):
        raise Refused("a subquery with a limit has to select the columns that it is ordered by")
    return frame
