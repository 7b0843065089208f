"""Merged sketches of days against one sketch of all rows and the exact count."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import sketches


def test_merged_days_are_the_sketch_of_all_rows(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 50 > 0, F.pmod(F.xxhash64("id"), F.lit(90_000))).alias("v"), F.when(F.col("id") % 97 > 0, F.timestamp_seconds(F.col("id") * 60)).alias("ts"))
    days = sketches.daily(rows, ["k"], "v", "ts")
    months = sketches.merged(days, ["k"], "month")
    whole = {r.k: r for r in sketches.estimated(sketches.merged(months, ["k"])).collect()}
    direct = {r.k: (r.estimate, r.exact) for r in rows.filter("ts is not null").groupBy("k").agg(F.hll_sketch_estimate(F.hll_sketch_agg("v", sketches.LG_K)).alias("estimate"), F.count_distinct("v").alias("exact")).collect()}
    assert months.count() > 9 and whole.keys() == direct.keys()
    for k, (estimate, exact) in direct.items():
        assert abs(whole[k].estimate - estimate) <= 0.01 * estimate and whole[k].low <= exact <= whole[k].high
    assert sketches.merged(days.limit(0), ["k"]).count() == 0


def test_stored_days_count_exactly_beyond_what_sketches_do(spark, tmp_path):
    """Ten thousand users, where a sketch of all is off; users and times that are null count as in SQL."""
    import datetime as dt

    import duckdb

    from orrery.plans.catalog import ORACLE_SQL, QUERIES

    rows = spark.range(30_000).select(F.concat(F.lit("t"), F.col("id") % 2).alias("event_type"), F.when(F.col("id") % 90 > 0, F.pmod(F.xxhash64("id"), F.lit(10_000)) * 7).alias("user_id"), F.when(F.col("id") % 11 > 0, F.timestamp_seconds(F.col("id") * 180)).cast("timestamp_ntz").alias("ts"))
    odd = spark.createDataFrame([("none", None, dt.datetime(2024, 1, 1)), ("when", 5, None), (None, 6, dt.datetime(2024, 2, 1))], "event_type string, user_id long, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.unionByName(odd).coalesce(2).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.execute(ORACLE_SQL["stored_sketches"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    got = [(r.event_type, r.period, r.estimate) for r in QUERIES["stored_sketches"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and max(r[2] for r in want) > 7_000
