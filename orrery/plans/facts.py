"""Queries that extract facts from texts, review documents and report usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import extract as x
from orrery.operators import review, usage
from orrery.plans.registry import query
from orrery.plans.views import CHUNKS, EVENT_STORE, chunks, event_store, table

_LETTER = """letters AS (SELECT doc_id, 'From: ' || source || chr(10) || 'To: Team ' || CAST(doc_id % 7 AS VARCHAR) || chr(10) || 'Subject: Notice of delay ' || CAST(doc_id AS VARCHAR) || chr(10)
    || 'Ref: ABC-' || CAST(1000 + doc_id % 50 AS VARCHAR) || ' Contract No: C-' || CAST(doc_id % 9 AS VARCHAR) || '/X1' || chr(10)
    || 'Dear all, we hereby notify a delay and claim USD ' || CAST(100 + doc_id % 900 AS VARCHAR) || '.50, payable within ' || CAST(7 + doc_id % 3 AS VARCHAR) || ' days. Kind regards' || chr(10) || text AS text FROM documents)"""


def letters(spark, sf_dir):
    """Documents with a letter's head, so that the patterns have something to find."""
    d = table(spark, sf_dir, "documents")
    n = lambda c: c.cast("string")
    i = F.col("doc_id")
    head = F.concat(
        F.lit("From: "), "source", F.lit("\nTo: Team "), n(i % 7), F.lit("\nSubject: Notice of delay "), n(i), F.lit("\nRef: ABC-"), n(1000 + i % 50), F.lit(" Contract No: C-"), n(i % 9), F.lit("/X1\n"),
        F.lit("Dear all, we hereby notify a delay and claim USD "), n(100 + i % 900), F.lit(".50, payable within "), n(7 + i % 3), F.lit(" days. Kind regards\n"), "text",
    )
    return d.select("doc_id", head.alias("text"))


@query("notice_fields", f"""WITH {_LETTER} SELECT doc_id, regexp_extract(text, 'From: (.+)', 1) AS sender, 'Team ' || CAST(doc_id % 7 AS VARCHAR) AS recipient, 'Notice of delay ' || CAST(doc_id AS VARCHAR) AS subject, 'C-' || CAST(doc_id % 9 AS VARCHAR) || '/X1' AS contract_ref FROM letters""")
def notice_fields(spark, sf_dir):
    return x.notices(letters(spark, sf_dir)).select("doc_id", "sender", "recipient", "subject", "contract_ref")


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _in_order(values: str) -> str:
    """Distinct values of a list expression named ``l``, in order."""
    return f"list_filter({values}, lambda v, i: list_position({values}, v) = i)"


_REFS = " || ".join(f"regexp_extract_all(text, {_sql(p)}, 1)" for p in x.REF_PATTERNS)


@query("refs", f"""WITH {_LETTER}, r AS (SELECT list_filter({_REFS}, lambda v: length(v) >= 3 AND regexp_matches(v, '[0-9]')) AS l FROM letters)
    SELECT ref, count(*) AS n FROM (SELECT unnest({_in_order('l')}[1:10]) AS ref FROM r) GROUP BY ref""")
def refs(spark, sf_dir):
    found = x.notices(letters(spark, sf_dir)).select(F.explode("refs").alias("ref"))
    return found.groupBy("ref").agg(F.count("*").alias("n"))


#: Names behind a letter's text.
_SIGNED = "chr(10) || 'Attention Mr. John Smith and Eng. Mary Ann Lee' || chr(10) || 'Alpha Beta Contracting LLC, Al Noor Ltd and Eve & Co.' || chr(10) || 'Kind Regards,' || chr(10) || 'Omar Khan' || chr(10)"
_KINDS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(list_filter(regexp_extract_all(text, {_sql(p)}, {group}), lambda v: length(v) >= {least})) AS value FROM s" for k, (patterns, group, least) in x.KINDS.items() for p in patterns)


@query("entities", f"WITH {_LETTER}, s AS (SELECT doc_id, text || {_SIGNED} AS text FROM letters), e AS ({_KINDS}) SELECT kind, lower(value) AS value, count(DISTINCT doc_id) AS n FROM e GROUP BY ALL")
def entities(spark, sf_dir):
    signed = letters(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\nAttention Mr. John Smith and Eng. Mary Ann Lee\nAlpha Beta Contracting LLC, Al Noor Ltd and Eve & Co.\nKind Regards,\nOmar Khan\n")))
    return x.entities(signed).groupBy("kind", "value").agg(F.count("*").alias("n"))


_CLAIMED = "lambda v: regexp_replace(trim(regexp_replace(v, '\\s+', ' ', 'g')), '[.,;]+$', '')"
_CLAIMS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS claim_type, {i} AS pattern, list_filter(list_transform(regexp_extract_all(text, {_sql('(?i)' + p)}, 1), {_CLAIMED}), lambda v: length(v) > 10)[1] AS description FROM s" for k, ps in x.CLAIMS.items() for i, p in enumerate(ps))
_DEMANDS = "Claim for additional cost of USD 5. Short claim of x. Please ensure  that the  works proceed; completion date is 5 May 2012 at the latest."


@query("claims", f"WITH {_LETTER}, s AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || {_sql(_DEMANDS)} ELSE '' END AS text FROM letters), c AS ({_CLAIMS}) SELECT doc_id, claim_type, pattern, left(description, 200) AS description FROM c WHERE description IS NOT NULL")
def claims(spark, sf_dir):
    more = F.when(F.col("doc_id") % 2 == 0, "\n" + _DEMANDS).otherwise("")
    return x.claims(letters(spark, sf_dir).withColumn("text", F.concat("text", more))).drop("snippet")


_STOPS = ", ".join(map(_sql, x.STOP_WORDS))


@query("salient_terms", f"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-zA-Z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN ({_STOPS})) AS l FROM conversations)
    SELECT conv_id, turn, array_to_string({_in_order('l')}[1:5], ' ') AS terms FROM t""")
def salient_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(x.salient_terms(F.col("text")), " ").alias("terms"))


@query("source_snippets", r"""WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents), p AS (SELECT *, string_split(replace(t, chr(10), ' '), '. ') AS parts FROM s)
    SELECT doc_id, md5(CASE WHEN length(t) > 500 THEN left(t, 500) || '...' ELSE t END) AS snippet_md5, left(array_to_string(parts[1:3], '. ') || CASE WHEN len(parts) > 3 THEN '...' ELSE '' END, 300) AS highlight_text FROM p""")
def source_snippets(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(x.snippet(text).cast("binary")).alias("snippet_md5"), x.highlight(text).alias("highlight_text"))


def _lower_any(words):
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("actions", f"WITH {_LETTER}, a AS ({' UNION ALL '.join(f'SELECT {chr(39)}{a}{chr(39)} AS action, doc_id FROM letters WHERE {_lower_any(w)}' for a, w in x.ACTIONS.items())}) SELECT action, count(*) AS n FROM a GROUP BY action")
def actions(spark, sf_dir):
    return letters(spark, sf_dir).select(F.explode(x.actions(F.col("text"))).alias("action")).groupBy("action").agg(F.count("*").alias("n"))


_COUNTS = {t: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in ws) for t, ws in x.DOC_TYPES.items()}


@query("doc_type", f"""WITH {_LETTER}, c AS (SELECT doc_id, {', '.join(f'{e} AS {t}' for t, e in _COUNTS.items())} FROM letters), b AS (SELECT *, greatest({', '.join(_COUNTS)}) AS best FROM c)
    SELECT CASE WHEN best = 0 THEN 'other' {' '.join(f"WHEN {t} = best THEN '{t}'" for t in _COUNTS)} END AS doc_type, count(*) AS n FROM b GROUP BY 1""")
def doc_type(spark, sf_dir):
    return letters(spark, sf_dir).groupBy(x.doc_type(F.col("text")).alias("doc_type")).agg(F.count("*").alias("n"))


@query("deadlines", f"WITH {_LETTER} SELECT 'within ' || CAST(7 + doc_id % 3 AS VARCHAR) || ' days' AS deadline, count(*) AS n FROM letters GROUP BY 1")
def deadlines(spark, sf_dir):
    found = x.notices(letters(spark, sf_dir)).select(F.explode("deadlines").alias("deadline"))
    return found.groupBy("deadline").agg(F.count("*").alias("n"))


@query("facet_coverage", f"WITH {_LETTER} SELECT " + ", ".join(f"CAST(sum(len(regexp_extract_all(lower(text), '{'|'.join(t)}'))) AS BIGINT) AS {f}" for f, t in x.FACETS.items()) + " FROM letters")
def facet_coverage(spark, sf_dir):
    return letters(spark, sf_dir).agg(*(F.sum(c).cast("long").alias(f) for f, c in x.facet_counts(F.col("text")).items()))


@query("html_strip", r"""SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style.*?</style>', ' ', 'g'), '(?is)<script.*?</script>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)""")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", x.html_text(F.col("html")).alias("t")).select("page_id", F.length("t").cast("long").alias("chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query("claim_support", f"""WITH {_LETTER} SELECT doc_id, contains(text, CAST(100 + doc_id % 901 AS VARCHAR)) AND contains(text, '50') AS supported FROM letters""")
def claim_support(spark, sf_dir):
    rows = letters(spark, sf_dir)
    claim = F.concat(F.lit("hereby notify delay claim payable "), (100 + F.col("doc_id") % 901).cast("string"), F.lit(" and 50"))
    return rows.select("doc_id", x.supported(claim, F.col("text")).alias("supported"))


@query("keyword_score", "SELECT doc_id, round(least(0.15 * CAST(contains(lower(text), 'the') AS DOUBLE) + 0.15 * CAST(contains(lower(text), 'zu') AS DOUBLE) + 0.25 * CAST(contains(lower(text), 'que') AS DOUBLE), 1.0), 6) AS score FROM documents")
def keyword_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", review.relevance(F.col("text"), ["the", "zu"], ["que"]).alias("score"))


@query("issue_key_score", "SELECT doc_id, round(least(0.25 * 0.8 + 0.3 * least(CAST(doc_id % 7 AS DOUBLE) / 5, 1.0) + 0.2 * least(CAST(doc_id % 13 AS DOUBLE) * 1000 / greatest(n_chars, 1) / 10, 1.0) + 0.1 * CAST(doc_id % 2 > 0 AS DOUBLE) + 0.1 * CAST(doc_id % 3 > 0 AS DOUBLE) + 0.05 * CAST(doc_id % 4 > 0 AS DOUBLE), 1.0), 6) AS score FROM documents")
def issue_key_score(spark, sf_dir):
    i = F.col("doc_id")
    score = review.key_score(F.lit(0.8), (i % 7).cast("double"), (i % 13).cast("double"), F.col("n_chars"), i % 2, i % 3, i % 4)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"))


@query("review_accuracy", """WITH s AS (SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN 0.9 ELSE 0.1 END AS score FROM documents), j AS (SELECT score, quality FROM s LEFT JOIN labels USING (doc_id))
    SELECT count(*) AS n, count(quality) AS labelled, round(avg(CASE WHEN quality IS NULL THEN NULL WHEN CAST(score >= 0.7 AS INTEGER) = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
           coalesce(avg(CASE WHEN quality IS NULL THEN NULL WHEN CAST(score >= 0.7 AS INTEGER) = quality THEN 1.0 ELSE 0.0 END), 0) >= 0.8 AND count(quality) * 2 >= count(*) AS apply_all FROM j""")
def review_accuracy(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").select("doc_id", F.when(F.lower("text").contains("the"), 0.9).otherwise(0.1).alias("score"))
    return review.review_gate(scored, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))


@query("evidence_pack")
def evidence_pack(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("request"), F.date_diff("ts", F.lit("2024-01-01")).cast("long").alias("file"), F.col("event_id").alias("passage"), F.col("value").alias("score"), (400 + F.col("event_id") % 900).alias("chars"), F.array("event_type").alias("facets"))
    return review.evidence_pack(rows, budget=30_000)


@query("pack_description", "SELECT event_type AS request, count(DISTINCT nullif('f' || CAST(user_id % 10 AS VARCHAR), 'f0')) AS documents, count(DISTINCT user_id) AS fragments, count(*) AS passages, CAST(coalesce(sum(length(props)), 0) AS BIGINT) AS chars FROM events GROUP BY 1")
def pack_description(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    file = F.nullif(F.concat(F.lit("f"), (F.col("user_id") % 10).cast("string")), F.lit("f0"))
    return review.described(e.select(F.col("event_type").alias("request"), file.alias("file_name"), F.col("user_id").alias("doc_id"), F.col("props").alias("excerpt")), ["request"])


@query("next_sequence", """WITH s AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events WHERE event_id % 3 > 0 AND user_id % 5 > 0), m AS (SELECT run, max(seq) AS last FROM s GROUP BY 1)
    SELECT event_id, user_id AS run, CAST(coalesce(last, -1) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq FROM events LEFT JOIN m ON run = user_id WHERE event_id % 3 = 0""")
def next_sequence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run"))
    old = e.filter("event_id % 3 > 0 and run % 5 > 0")
    stored = usage.next_sequence(e.select("run").limit(0).withColumn("seq", F.lit(0).cast("long")), old, "run", ["event_id"])
    return usage.next_sequence(stored, e.filter("event_id % 3 = 0"), "run", ["event_id"])


@query("size_batches", f"""WITH RECURSIVE {CHUNKS}, r(doc_id, page, batch, used) AS (
        SELECT doc_id, page, CAST(0 AS BIGINT), CAST(length(text) + 160 AS BIGINT) FROM chunks WHERE page = 0
        UNION ALL SELECT c.doc_id, c.page, r.batch + CASE WHEN r.used + length(c.text) + 160 > 8000 THEN 1 ELSE 0 END, CASE WHEN r.used + length(c.text) + 160 > 8000 THEN 0 ELSE r.used END + length(c.text) + 160
        FROM r JOIN chunks c ON c.doc_id = r.doc_id AND c.page = r.page + 1)
    SELECT doc_id, page, length(text) AS chars, batch FROM r JOIN chunks USING (doc_id, page)""")
def size_batches(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("doc_id", "page", F.length("text").cast("long").alias("chars"))
    return review.size_batches(rows, "doc_id", ["page"], "chars", most=8_000)


_LEDGER = "ledger AS (SELECT o_orderkey AS event_id, o_custkey AS username, o_orderpriority AS project, CAST(o_orderkey % 5000 AS BIGINT) AS tokens, CAST(round(o_totalprice * 100) AS BIGINT) * 1000 AS cost_nanos, CAST(round(o_totalprice * 100) AS BIGINT) * (900 + o_orderkey % 200) AS charge_nanos FROM orders)"


def ledger(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("username"), F.col("o_orderpriority").alias("project"), (F.col("o_orderkey") % 5000).alias("tokens"), (cents * 1000).alias("cost_nanos"), (cents * (900 + F.col("o_orderkey") % 200)).alias("charge_nanos"))


@query("billing_rollup", f"WITH {_LEDGER} SELECT project, username, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nanos) AS BIGINT) AS cost_nanos, CAST(sum(charge_nanos) AS BIGINT) AS charge_nanos, CAST(sum(greatest(cost_nanos - charge_nanos, 0)) AS BIGINT) AS uncovered_nanos FROM ledger GROUP BY 1, 2")
def billing_rollup(spark, sf_dir):
    return usage.billing_rollup(ledger(spark, sf_dir), ["project", "username"])


@query("billing_balance", f"WITH {_LEDGER}, s AS (SELECT username, sum(charge_nanos) AS spent FROM ledger GROUP BY 1), c AS (SELECT c_custkey AS username, sum(CAST(1000000000 AS BIGINT)) AS given FROM customer GROUP BY 1) SELECT username, CAST(coalesce(given, 0) - coalesce(spent, 0) AS BIGINT) AS balance_nanos FROM c FULL JOIN s USING (username)")
def billing_balance(spark, sf_dir):
    credits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("username"), F.lit(1_000_000_000).cast("long").alias("credit_nanos"))
    return usage.balance(ledger(spark, sf_dir), credits, "username")


@query("exact_cost", "SELECT o_orderkey, CAST(((o_orderkey - o_orderkey % 100) * 2500000000 + (o_orderkey % 100) * 1250000000 + (o_custkey) * 10000000001 + 500000) // 1000000 AS BIGINT) AS nanos FROM orders")
def exact_cost(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", usage.exact_cost(F.col("o_orderkey"), F.col("o_orderkey") % 100, F.col("o_custkey"), 2_500_000_000, 1_250_000_000, 10_000_000_001).alias("nanos"))


@query("token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", usage.estimated_tokens(F.col("text")).alias("tokens"))


_STATUS = "CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END"


@query("run_metrics", f"WITH s AS (SELECT user_id AS run_id, {_STATUS} AS status, value AS latency FROM events) SELECT run_id, count(*) AS steps, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, round(sum(latency), 2) AS latency, round(max(latency), 2) AS slowest FROM s GROUP BY run_id")
def run_metrics(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    return usage.run_metrics(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), status.alias("status"), F.col("value").alias("latency")))


@query("ab_report", "SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, count(*) AS n, round(avg(value), 4) AS avg_latency, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 4) AS success_rate, round(avg(CASE WHEN event_id % 3 = 0 THEN value END), 4) AS avg_quality FROM events GROUP BY 1")
def ab_report(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return usage.ab_report(e.select(F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("variant"), F.col("value").alias("latency"), (F.col("event_type") != "error").alias("success"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("quality")))


@query("feedback_summary", "SELECT coalesce(event_type, '*') AS route, count(*) FILTER (user_id % 3 > 0) AS up, count(*) FILTER (user_id % 3 = 0) AS down FROM events GROUP BY ROLLUP (event_type)")
def feedback_summary(spark, sf_dir):
    return usage.feedback_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), F.when(F.col("user_id") % 3 > 0, 1).otherwise(-1).alias("vote")))


@query("queue_eta", """WITH j AS (SELECT event_id AS job_id, event_type AS queue, CASE WHEN event_id % 4 > 0 THEN ts END AS finished, value AS seconds FROM events),
    m AS (SELECT queue, avg(seconds) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY finished DESC, job_id DESC) AS k FROM j WHERE finished IS NOT NULL) WHERE k <= 20 GROUP BY 1)
    SELECT queue, count(*) AS jobs, count(*) FILTER (finished IS NULL) AS open, round(any_value(mean) * count(*) FILTER (finished IS NULL) / 2, 3) AS eta_seconds FROM j LEFT JOIN m USING (queue) GROUP BY queue""")
def queue_eta(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return usage.queue_eta(e.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("queue"), F.when(F.col("event_id") % 4 > 0, F.col("ts")).alias("finished"), F.col("value").alias("seconds")))


_PAIRS = "WITH f AS (SELECT DISTINCT l_orderkey AS i, l_partkey AS file FROM lineitem), p AS (SELECT a.file AS doc_a, b.file AS doc_b, count(*) AS cnt FROM f a JOIN f b ON a.i = b.i AND a.file < b.file GROUP BY 1, 2) "


def _pairs(spark, sf_dir):
    return usage.co_retrieval(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("interaction"), F.col("l_partkey").alias("file")))


@query("co_retrieval", _PAIRS + "SELECT doc_a, doc_b, cnt FROM p")
def co_retrieval(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("related_docs", _PAIRS + ", b AS (SELECT doc_a AS doc, doc_b AS other, cnt FROM p UNION ALL SELECT doc_b, doc_a, cnt FROM p) SELECT doc, other, cnt, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY cnt DESC, other) AS INTEGER) AS place FROM b) WHERE place <= 5")
def related_docs(spark, sf_dir):
    return usage.related(_pairs(spark, sf_dir))


@query("dedupe_largest", "SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_largest(spark, sf_dir):
    return usage.largest_record(table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], "n_chars", ["doc_id"])


@query("upsert_counts", """WITH s AS (SELECT source AS k, count(*) AS cnt FROM documents WHERE lang = 'en' GROUP BY 1), n AS (SELECT source AS k, count(*) AS cnt FROM documents WHERE lang = 'fr' GROUP BY 1)
    SELECT k, coalesce(s.cnt, 0) + coalesce(n.cnt, 0) AS cnt FROM s FULL JOIN n USING (k)""")
def upsert_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    counted = lambda lang: d.filter(F.col("lang") == lang).groupBy(F.col("source").alias("k")).agg(F.count("*").alias("cnt"))
    return usage.merged(counted("en"), counted("fr"), ["k"], add=["cnt"])


@query("append_once", "SELECT doc_id, source FROM documents WHERE n_chars > 1500 AND lang <> 'en'")
def append_once(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    stored, new = d.filter("lang = 'en'"), d.filter("n_chars > 1500")
    return usage.append_once(stored.select("doc_id", "source"), new.unionByName(new.filter("lang = 'fr'")).select("doc_id", "source"), "doc_id")


@query("library_summary", f"WITH {EVENT_STORE} SELECT doc_id, count(*) AS events, count(DISTINCT actor) AS actors, max(severity) AS worst, min(date_sort) AS first_date FROM event_store GROUP BY doc_id")
def library_summary(spark, sf_dir):
    return event_store(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("events"), F.count_distinct("actor").alias("actors"), F.max("severity").alias("worst"), F.min("date_sort").alias("first_date"))
