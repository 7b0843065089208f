"""Queries over letters and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import correspondence as c
from orrery.plans.registry import query
from orrery.plans.views import EVENT_STORE, NOTICES, event_store, notices, table

_N, _E = f"WITH {NOTICES} ", f"WITH {EVENT_STORE} "
_COLS = ["doc_id", "date", "sender", "recipient"]


@query("timeline_filter", _N + "SELECT doc_id, date, sender, recipient FROM notices WHERE date BETWEEN '1996-01-01' AND '1997-12-31' AND (lower(sender) LIKE '%supplier#00000001%' OR lower(recipient) LIKE '%supplier#00000001%')")
def timeline_filter(spark, sf_dir):
    return c.timeline(notices(spark, sf_dir), "1996-01-01", "1997-12-31", "Supplier#00000001").select(_COLS)


@query("timeline_topic", _N + "SELECT doc_id, date FROM notices WHERE len(list_filter(topics, lambda t: lower(t) LIKE '%econ%')) > 0")
def timeline_topic(spark, sf_dir):
    return c.timeline(notices(spark, sf_dir), topic="ECON").select("doc_id", "date")


@query("event_filter", _E + "SELECT event_id, actor, date_sort FROM event_store WHERE event_type = 'click' AND actor LIKE '%actor1%' AND date_sort BETWEEN '2024-01-05' AND '2024-01-20'")
def event_filter(spark, sf_dir):
    return c.filter_events(event_store(spark, sf_dir), "click", "ACTOR1", "2024-01-05", "2024-01-20").select("event_id", "actor", "date_sort")


@query("type_counts", _E + "SELECT event_type, count(*) AS n, min(date_sort) AS first_date, max(date_sort) AS last_date FROM event_store GROUP BY event_type")
def type_counts(spark, sf_dir):
    return event_store(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.min("date_sort").alias("first_date"), F.max("date_sort").alias("last_date"))


@query("actor_window_join", _E + """, w AS (SELECT DISTINCT doc_id AS entry, CAST('2024-01-05' AS DATE) + CAST(doc_id % 20 AS INTEGER) AS from_date FROM event_store)
    SELECT entry, event_type, count(*) AS n FROM event_store JOIN w ON CAST(ts AS DATE) BETWEEN from_date - 3 AND from_date + 2 + 3 GROUP BY 1, 2""")
def actor_window_join(spark, sf_dir):
    events = event_store(spark, sf_dir)
    start = F.date_add(F.lit("2024-01-05").cast("date"), (F.col("doc_id") % 20).cast("int"))
    windows = events.select(F.col("doc_id").alias("entry"), start.alias("from_date")).distinct().withColumn("to_date", F.date_add("from_date", 2))
    return c.events_near(events, windows, 3).groupBy("entry", "event_type").agg(F.count("*").alias("n"))


@query("event_dedupe_hash", _E + """SELECT substr(sha256(doc_id || '|' || event_type || '|' || date_sort), 1, 24) AS event_key, min(event_id) AS event_id, count(*) AS n FROM event_store GROUP BY 1""")
def event_dedupe_hash(spark, sf_dir):
    key = F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "event_type", "date_sort"), 256), 1, 24)
    return event_store(spark, sf_dir).groupBy(key.alias("event_key")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


_STATS = _N + """, b AS (SELECT lower(sender) AS party, 1 AS s FROM notices UNION ALL SELECT lower(recipient), 0 FROM notices),
    t AS (SELECT party, CAST(sum(s) AS BIGINT) AS sent, CAST(sum(1 - s) AS BIGINT) AS received, count(*) AS total FROM b GROUP BY party) """


@query("party_stats", _STATS + "SELECT * FROM t")
def party_stats(spark, sf_dir):
    return c.party_stats(notices(spark, sf_dir))


@query("party_roles", _STATS + "SELECT party, round(sent / total, 4) AS send_ratio, CASE WHEN sent / total > 0.7 THEN 'initiator' WHEN sent / total < 0.3 THEN 'responder' ELSE 'participant' END AS role FROM t")
def party_roles(spark, sf_dir):
    return c.party_roles(notices(spark, sf_dir))


@query("thread_by_party", _N + """SELECT CASE WHEN lower(sender) LIKE '%supplier#00000007%' THEN recipient ELSE sender END AS other, count(*) AS n, min(date) AS first_date, max(date) AS last_date,
    string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY date, doc_id) AS doc_ids FROM notices WHERE lower(sender) LIKE '%supplier#00000007%' OR lower(recipient) LIKE '%supplier#00000007%' GROUP BY 1""")
def thread_by_party(spark, sf_dir):
    return c.thread_by_party(notices(spark, sf_dir), "Supplier#00000007")


@query("thread_between", _N + "SELECT doc_id, date, sender, recipient FROM notices WHERE (lower(sender) LIKE '%customer#0000001%' AND lower(recipient) LIKE '%supplier#00000002%') OR (lower(sender) LIKE '%supplier#00000002%' AND lower(recipient) LIKE '%customer#0000001%')")
def thread_between(spark, sf_dir):
    return c.thread_between(notices(spark, sf_dir), "Customer#0000001", "Supplier#00000002").select(_COLS)


@query("latest_per_pair", _N + """SELECT doc_id, date, sender, recipient FROM (SELECT *, row_number() OVER (PARTITION BY least(sender, recipient) || '|' || greatest(sender, recipient) ORDER BY date DESC, doc_id DESC) AS k FROM notices) WHERE k = 1""")
def latest_per_pair(spark, sf_dir):
    return c.latest_per_pair(notices(spark, sf_dir)).select(_COLS)


@query("truly_unanswered", _N + "SELECT doc_id, date FROM notices a WHERE NOT EXISTS (SELECT 1 FROM notices b WHERE b.sender = a.recipient AND b.recipient = a.sender AND b.date > a.date)")
def truly_unanswered(spark, sf_dir):
    return c.unanswered(notices(spark, sf_dir)).select("doc_id", "date")


@query("pair_groups", _N + "SELECT least(lower(sender), lower(recipient)) || ' - ' || greatest(lower(sender), lower(recipient)) AS pair, count(*) AS n, max(date) AS latest, min(doc_id) AS first_doc FROM notices GROUP BY 1")
def pair_groups(spark, sf_dir):
    return c.pair_groups(notices(spark, sf_dir))


@query("flow", _N + "SELECT sender, recipient, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM notices GROUP BY 1, 2")
def flow(spark, sf_dir):
    return c.flow(notices(spark, sf_dir))


_HIT = "CAST(array_to_string(topics, ' ') || ' ' || doc_type || ' ' || sender || ' ' || recipient || ' ' || project ILIKE '%{}%' AS BIGINT)"


@query("topic_search", _N + f"SELECT * FROM (SELECT doc_id, date, {_HIT.format('promo')} + {_HIT.format('urgent')} AS score FROM notices) WHERE score > 0")
def topic_search(spark, sf_dir):
    return c.search_topics(notices(spark, sf_dir), ["promo", "urgent"]).select("doc_id", "date", "score")


# the correspondence templates: count, from, to, between, latest, earliest, about, by type
TEXT_TEMPLATES = {
    "letters_count": ("SELECT count(*) AS n FROM notices", lambda n: n.agg(F.count("*").alias("n"))),
    "letters_from": ("SELECT doc_id, date FROM notices WHERE sender ILIKE '%supplier#00000003%'", lambda n: n.filter(F.lower("sender").contains("supplier#00000003")).select("doc_id", "date")),
    "letters_to": ("SELECT doc_id, date FROM notices WHERE recipient ILIKE '%supplier#00000003%'", lambda n: n.filter(F.lower("recipient").contains("supplier#00000003")).select("doc_id", "date")),
    "letters_latest": ("SELECT doc_id, date FROM notices ORDER BY date DESC, doc_id DESC LIMIT 5", lambda n: n.orderBy(F.desc("date"), F.desc("doc_id")).limit(5).select("doc_id", "date")),
    "letters_earliest": ("SELECT doc_id, date FROM notices ORDER BY date, doc_id LIMIT 5", lambda n: n.orderBy("date", "doc_id").limit(5).select("doc_id", "date")),
    "letters_by_type": ("SELECT doc_type, count(*) AS n FROM notices GROUP BY doc_type", lambda n: n.groupBy("doc_type").agg(F.count("*").alias("n"))),
    "letters_by_project": ("SELECT project, count(*) AS n, count(DISTINCT sender) AS senders FROM notices GROUP BY project", lambda n: n.groupBy("project").agg(F.count("*").alias("n"), F.count_distinct("sender").alias("senders"))),
    "letters_on_contract": ("SELECT contract_ref, count(*) AS n FROM notices GROUP BY contract_ref HAVING count(*) > 5", lambda n: n.groupBy("contract_ref").agg(F.count("*").alias("n")).filter("n > 5")),
}


def _register(name, sql, build):
    query(name, _N + sql)(lambda spark, sf_dir: build(notices(spark, sf_dir)))


for _name, (_sql, _build) in TEXT_TEMPLATES.items():
    _register(_name, _sql, _build)


@query("thread_messages", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, min(turn) AS first_turn FROM conversations GROUP BY conv_id")
def thread_messages(spark, sf_dir):
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), roles.alias("roles"), F.min("turn").alias("first_turn"))
