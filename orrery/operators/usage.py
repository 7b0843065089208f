"""Usage analytics: billing, runs, A/B variants, feedback, queues, co-retrieval, record merging. Money is in whole nanos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def billing_rollup(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of tokens, cost and charge; the part of the cost that charges do not cover, never below zero."""
    return ledger.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost_nanos").alias("cost_nanos"), F.sum("charge_nanos").alias("charge_nanos"), F.sum(F.greatest(F.col("cost_nanos") - F.col("charge_nanos"), F.lit(0).cast("long"))).alias("uncovered_nanos"))


def balance(ledger: DataFrame, credits: DataFrame, key: str) -> DataFrame:
    """Credits less charges of each user, with zeros for what is missing."""
    spent = ledger.groupBy(key).agg(F.sum("charge_nanos").alias("spent"))
    given = credits.groupBy(key).agg(F.sum("credit_nanos").alias("given"))
    joined = given.join(spent, key, "full_outer")
    zero = F.lit(0).cast("long")
    return joined.select(key, (F.coalesce("given", zero) - F.coalesce("spent", zero)).alias("balance_nanos"))


def exact_cost(input_tokens: Column, cached: Column, output: Column, price_in: int, price_cached: int, price_out: int) -> Column:
    """Cost in nanos of a call; prices are nanos for a million tokens, halves are rounded up."""
    total = (input_tokens - cached).cast("decimal(38,0)") * price_in + cached.cast("decimal(38,0)") * price_cached + output.cast("decimal(38,0)") * price_out
    return F.round(total / F.lit(1_000_000).cast("decimal(10,0)"), 0).cast("long")


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def append_once(ledger: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key the ledger does not have, each key once; append them to the ledger."""
    return new.dropDuplicates([key]).join(ledger.select(key), key, "left_anti").select(new.columns)


def run_metrics(steps: DataFrame, run: str = "run_id") -> DataFrame:
    """One row a run: steps by status, tokens, time; one aggregate for all of them."""
    done, failed = F.col("status") == "done", F.col("status") == "failed"
    return steps.groupBy(run).agg(F.count("*").alias("steps"), F.count_if(done).alias("done"), F.count_if(failed).alias("failed"), F.round(F.sum("latency"), 2).alias("latency"), F.round(F.max("latency"), 2).alias("slowest"))


def ab_report(samples: DataFrame) -> DataFrame:
    """Averages and success rate of each variant; nulls of the quality are left out."""
    return samples.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("latency"), 4).alias("avg_latency"), F.round(F.avg(F.col("success").cast("double")), 4).alias("success_rate"), F.round(F.avg("quality"), 4).alias("avg_quality"))


def feedback_summary(votes: DataFrame) -> DataFrame:
    """Up and down votes in all (route ``*``) and by route."""
    sums = votes.rollup("route").agg(F.count_if(F.col("vote") > 0).alias("up"), F.count_if(F.col("vote") < 0).alias("down"), F.grouping("route").alias("g"))
    return sums.select(F.when(F.col("g") == 1, "*").otherwise(F.col("route")).alias("route"), "up", "down")


def queue_eta(jobs: DataFrame, workers: int = 2, last: int = 20) -> DataFrame:
    """Open jobs and seconds to go: the mean of each queue's last durations times open jobs over workers."""
    place = F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("finished"), F.desc("job_id")))
    mean = jobs.filter("finished is not null").withColumn("_place", place).filter(F.col("_place") <= last).groupBy("queue").agg(F.avg("seconds").alias("mean"))
    open_ = jobs.groupBy("queue").agg(F.count_if(F.col("finished").isNull()).alias("open"), F.count("*").alias("jobs"))
    return open_.join(mean, "queue", "left").select("queue", "jobs", "open", F.round(F.col("mean") * F.col("open") / workers, 3).alias("eta_seconds"))


def co_retrieval(interactions: DataFrame) -> DataFrame:
    """How often two files were used in one answer: ``doc_a < doc_b, cnt``; an answer has few files."""
    files = interactions.select("interaction", "file").distinct()
    b = files.withColumnRenamed("file", "doc_b")
    return files.withColumnRenamed("file", "doc_a").join(b, "interaction").filter("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.count("*").alias("cnt"))


def related(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The files most often used together with each file."""
    both = pairs.select(F.col("doc_a").alias("doc"), F.col("doc_b").alias("other"), "cnt").unionByName(pairs.select(F.col("doc_b").alias("doc"), F.col("doc_a").alias("other"), "cnt"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("cnt"), "other"))
    return both.withColumn("place", place).filter(F.col("place") <= k)


def largest_record(records: DataFrame, keys: list[str], size: str, ties: list[str]) -> DataFrame:
    """Of records of one key the one of the largest size."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(size), *ties))
    return records.withColumn("_place", place).filter("_place = 1").drop("_place")


def merged(stored: DataFrame, new: DataFrame, key: list[str], add: list[str] = ()) -> DataFrame:
    """Upsert: new rows replace stored ones of the same key; columns in ``add`` are added up instead."""
    old = stored.select(*key, *(F.col(c).alias(f"_old_{c}") for c in stored.columns if c not in key), F.lit(True).alias("_stored"))
    fresh = new.withColumn("_new", F.lit(True))
    both = fresh.join(old, key, "full_outer")
    cols = []
    for c in stored.columns:
        if c in key:
            cols.append(F.col(c))
        elif c in add:
            cols.append((F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"_old_{c}"), F.lit(0))).alias(c))
        else:
            cols.append(F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c))
    return both.select(cols)


def usage_remaining(used: Column, budget: float) -> Column:
    """Percentage of a budget that is left, between 0 and 100."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - used / F.lit(budget)))), 2)


def next_sequence(stored: DataFrame, new: DataFrame, group: str, order: list[str], seq: str = "seq") -> DataFrame:
    """``new`` with the numbers that follow each group's largest stored one, from 0 for a new group, in order."""
    last = stored.groupBy(group).agg(F.max(seq).alias("_last"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return new.withColumn("_place", place).join(last, group, "left").withColumn(seq, (F.coalesce("_last", F.lit(-1)) + F.col("_place")).cast("long")).drop("_place", "_last")
