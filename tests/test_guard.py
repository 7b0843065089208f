from __future__ import annotations

import pytest

from orrery.plans.guard import Refused, run_sql, violation, without_stray_limit

REFUSED = [
    "DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE x AS SELECT 1", "DELETE FROM t", "UPDATE t SET a = 1", "SET x = 1", "DESCRIBE t", "SHOW TABLES",
    "SELECT * FROM t; DROP TABLE t", "SELECT * FROM other", "SELECT * FROM t, other", "SELECT * FROM parquet.`/etc/passwd`", "SELECT * FROM 'file.csv'",
    "SELECT * FROM db.t", "SELECT * FROM range(10)", "SELECT reflect('java.lang.System', 'exit', 1) FROM t", "SELECT java_method('a', 'b') FROM t",
    "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM other)", "SELECT a FROM t WHERE a IN (SELECT b FROM other)", "SELECT (SELECT max(a) FROM other) FROM t",
    "WITH c AS (SELECT * FROM other) SELECT * FROM c", "SELECT a FROM t UNION SELECT b FROM other", "SELECT TRANSFORM (a) USING 'cat' FROM t", "",
]
ALLOWED = [
    "SELECT 'drop table t' AS x FROM t", "SELECT a AS update_count FROM t -- delete from t", "WITH c AS (SELECT a FROM t) SELECT * FROM c", "SELECT a FROM t WHERE a IN (SELECT a FROM t)",
    "SELECT a, count(*) FROM t GROUP BY a HAVING count(*) > 1 ORDER BY 2 DESC LIMIT 5", "SELECT t.a FROM t JOIN t AS u ON t.a = u.a", "SELECT sum(a) OVER (ORDER BY a) FROM t",
    'SELECT "a" FROM t /* from other */', "SELECT explode(array(1, 2)) FROM t", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    assert violation(spark, sql, {"t"})


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, sql):
    t = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    assert violation(spark, sql, {"t"}) is None
    run_sql(spark, sql, {"t": t}).collect()


def test_tables_of_others_are_not_there(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("hidden")
    with pytest.raises(Refused):
        run_sql(spark, "SELECT * FROM hidden", {"t": spark.range(1)})


def test_fences_and_stray_limits(spark):
    t = spark.createDataFrame([(i,) for i in range(9)], "a int")
    assert run_sql(spark, "```sql\nSELECT a FROM t;\n```", {"t": t}).count() == 9
    grouped = "SELECT a, count(*) AS n FROM t GROUP BY a LIMIT 5"
    assert run_sql(spark, grouped, {"t": t}, "count by a").count() == 9
    assert run_sql(spark, grouped, {"t": t}, "top five of a").count() == 5
    assert without_stray_limit(spark, "SELECT a FROM t LIMIT 5", "all a") == "SELECT a FROM t LIMIT 5"


def test_limits_of_subqueries_keep_their_order(spark, tmp_path):
    """A limit by columns that a lateral query does not select would be by chance; the query over customers orders its window, null keys last."""
    from orrery.plans.catalog import QUERIES

    t = spark.createDataFrame([(1, 5), (1, 7), (2, 3)], "a int, b int")
    for lost in ("SELECT t.a, x.c FROM t, LATERAL (SELECT u.a + 1 AS c FROM t u WHERE u.a = t.a ORDER BY u.b DESC LIMIT 1) x", "SELECT a, (SELECT u.a FROM t u WHERE u.a = t.a ORDER BY u.b LIMIT 1) AS c FROM t"):
        with pytest.raises(Refused, match="ordered by"):
            run_sql(spark, lost, {"t": t})
    kept = "SELECT t.a, x.b FROM t, LATERAL (SELECT b FROM t u WHERE u.a = t.a ORDER BY b DESC LIMIT 1) x"
    assert sorted(map(tuple, run_sql(spark, kept, {"t": t}).collect())) == [(1, 7), (1, 7), (2, 3)]
    assert run_sql(spark, "SELECT a, (SELECT max(b) FROM t u WHERE u.a = t.a) AS c FROM t WHERE a = (SELECT a FROM t ORDER BY b DESC LIMIT 1)", {"t": t}).count() == 2
    spark.createDataFrame([(1,), (1,), (2,), (None,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, None, "2024-01-02"), (1, 9, "2024-01-02"), (1, 8, "2024-01-01"), (2, None, None), (3, 4, "2024-01-01")], "o_custkey long, o_orderkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["lateral_latest"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 9), (1, 9), (2, None)]
    assert "row_number() windowspecdefinition(o_custkey#" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "DESC NULLS LAST, o_orderkey#" in plan.split("windowspecdefinition")[1].split("]")[0]
