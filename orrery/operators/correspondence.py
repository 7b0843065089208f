"""Letters and events: filters, party statistics, threads, answers, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.dates import NO_DATE


def party_key(name: Column, strip_titles: bool = False) -> Column:
    """A party's name to compare by: before an address in brackets, without quotes, in lower case.

    ``strip_titles`` also drops a title before and a company form after it.
    """
    out = F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"<.*$", "")), "[\"']", ""))
    if strip_titles:
        out = F.trim(F.regexp_replace(F.regexp_replace(out, r"^(mr|mrs|ms|dr|eng)\.?\s+", ""), r"[\s,]+(llc|ltd|inc|co|gmbh)\.?$", ""))
    return out


def timeline(notices: DataFrame, start: str | None = None, end: str | None = None, party: str | None = None, topic: str | None = None) -> DataFrame:
    """Letters in a date range, of a party and on a topic (substrings); those without a date pass and come last."""
    out = notices.withColumn("date_sort", F.coalesce("date", F.lit(NO_DATE)))
    if start:
        out = out.filter(F.col("date").isNull() | (F.col("date") >= start))
    if end:
        out = out.filter(F.col("date").isNull() | (F.col("date") <= end))
    if party:
        out = out.filter(F.lower("sender").contains(party.lower()) | F.lower("recipient").contains(party.lower()))
    if topic:
        out = out.filter(F.exists("topics", lambda t: F.lower(t).contains(topic.lower())))
    return out.orderBy("date_sort", "doc_id")


def filter_events(events: DataFrame, event_type: str | None = None, actor: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    checks = [(event_type, F.col("event_type") == event_type), (actor, F.lower("actor").contains((actor or "").lower())), (start, F.col("date_sort") >= start), (end, F.col("date_sort") <= end)]
    for given, check in checks:
        if given:
            events = events.filter(check)
    return events


def party_stats(notices: DataFrame) -> DataFrame:
    """Letters sent and received by each party, by its key."""
    both = notices.select(F.explode(F.array(F.struct(party_key(F.col("sender")).alias("party"), F.lit(1).alias("s")), F.struct(party_key(F.col("recipient")).alias("party"), F.lit(0).alias("s")))).alias("x"))
    return both.select("x.*").filter("party <> ''").groupBy("party").agg(F.sum("s").alias("sent"), F.sum(1 - F.col("s")).alias("received"), F.count("*").alias("total"))


def party_roles(notices: DataFrame) -> DataFrame:
    """Initiators send over 70 % of their letters, responders under 30 %."""
    share = F.col("sent") / F.col("total")
    role = F.when(share > 0.7, "initiator").when(share < 0.3, "responder").otherwise("participant")
    return party_stats(notices).select("party", F.round(share, 4).alias("send_ratio"), role.alias("role"))


def thread_by_party(notices: DataFrame, party: str) -> DataFrame:
    """For letters of a party, the other side's letters together: count, first and last date, ids in order."""
    low = party.lower()
    mine = notices.filter(F.lower("sender").contains(low) | F.lower("recipient").contains(low))
    other = F.when(F.lower("sender").contains(low), F.col("recipient")).otherwise(F.col("sender"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",")
    return mine.groupBy(other.alias("other")).agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), listed.alias("doc_ids"))


def thread_between(notices: DataFrame, a: str, b: str) -> DataFrame:
    """Letters between two parties in either direction."""
    s, r = F.lower("sender"), F.lower("recipient")
    return notices.filter((s.contains(a.lower()) & r.contains(b.lower())) | (s.contains(b.lower()) & r.contains(a.lower()))).orderBy("date", "doc_id")


def latest_per_pair(notices: DataFrame) -> DataFrame:
    """The latest letter of each unordered pair of parties; ties go to the larger id."""
    pair = F.concat_ws("|", F.least("sender", "recipient"), F.greatest("sender", "recipient"))
    place = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("date"), F.desc("doc_id")))
    return notices.withColumn("pair", pair).withColumn("_place", place).filter("_place = 1").drop("_place")


def unanswered(notices: DataFrame) -> DataFrame:
    """Letters after which no later one goes the other way between the same two parties.

    The latest date of each direction is one row a pair, so the anti-join is a
    comparison of aggregates and never pairs letters with letters.
    """
    s, r = party_key(F.col("sender")), party_key(F.col("recipient"))
    keyed = notices.withColumns({"_s": s, "_r": r})
    last = keyed.groupBy(F.col("_r").alias("_s"), F.col("_s").alias("_r")).agg(F.max("date").alias("_answer"))
    return keyed.join(last, ["_s", "_r"], "left").filter("_answer is null or _answer <= date").drop("_s", "_r", "_answer")


def pair_groups(notices: DataFrame) -> DataFrame:
    """Letters of each unordered pair together, pairs with the latest letter first."""
    pair = F.concat_ws(" - ", F.array_sort(F.array(party_key(F.col("sender")), party_key(F.col("recipient")))))
    return notices.groupBy(pair.alias("pair")).agg(F.count("*").alias("n"), F.max("date").alias("latest"), F.min("doc_id").alias("first_doc")).orderBy(F.desc("latest"), "pair")


def search_topics(notices: DataFrame, words: list[str]) -> DataFrame:
    """Letters by the number of words that match topic, type, sender, recipient or project; at least one must."""
    fields = [F.lower(F.array_join("topics", " ")), *(F.lower(c) for c in ("doc_type", "sender", "recipient", "project"))]
    hits = sum((F.greatest(*(f.contains(w.lower()).cast("int") for f in fields)) for w in words), F.lit(0))
    return notices.withColumn("score", hits.cast("long")).filter("score > 0").orderBy(F.desc("score"), "date", "doc_id")


def flow(notices: DataFrame) -> DataFrame:
    """Letters from each sender to each recipient."""
    return notices.groupBy("sender", "recipient").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def events_near(events: DataFrame, windows: DataFrame, pad: int = 30) -> DataFrame:
    """Events within ``pad`` days of each window ``entry, from_date, to_date``.

    Windows are cut into months so that the join is on a key: an event meets the
    windows of its own month only.
    """
    low, high = F.date_sub("from_date", pad), F.date_add("to_date", pad)
    months = windows.withColumns({"lo": low, "hi": high}).withColumn("month", F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))))
    dated = events.withColumn("day", F.to_date("ts")).withColumn("month", F.trunc("day", "month"))
    return dated.join(months, "month").filter("day between lo and hi").drop("month", "lo", "hi")
