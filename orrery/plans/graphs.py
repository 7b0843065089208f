"""Queries over the letters' graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import graph as g
from orrery.operators.components import connected_components
from orrery.plans.registry import query
from orrery.plans.views import NOTICES, notices
from orrery.storage import stash

_N = f"WITH {NOTICES}"
#: Letters of a day between two parties in one direction, named by the smallest id.
_DAYS = f"{_N}, days AS (SELECT min(doc_id) AS doc_id, sender, recipient, date FROM notices GROUP BY 2, 3, 4)"


def _shared(column: str) -> str:
    return _N + f""", k AS (SELECT doc_id, list_sort(list_distinct({column})) AS facts FROM notices), r AS (SELECT min(doc_id) AS id, facts FROM k GROUP BY facts),
    f AS (SELECT id, len(facts) AS n, unnest(facts) AS fact FROM r),
    w AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS shared FROM f x JOIN f y ON x.fact = y.fact AND x.id < y.id GROUP BY ALL)"""


def _classes(column: str, kind: str) -> str:
    return _N + f""", k AS (SELECT doc_id, list_sort(list_distinct({column})) AS facts FROM notices), r AS (SELECT min(doc_id) AS id, count(*) AS letters, facts FROM k GROUP BY facts),
    f AS (SELECT id, CAST(len(facts) AS INTEGER) AS n, letters, CAST(unnest(facts) AS VARCHAR) AS fact FROM r)
    SELECT fact, id, n, letters, count(*) OVER (PARTITION BY fact) - 1 AS links, '{kind}' AS edge_type FROM f"""


@query("edge_refs", _shared("refs") + " SELECT a, b, 'references' AS edge_type, round(shared / greatest(na, nb), 6) AS weight FROM w")
def edge_refs(spark, sf_dir):
    return g.reference_edges(notices(spark, sf_dir))


@query("reference_members", _shared("refs") + " SELECT doc_id AS id, r.id AS rep FROM k JOIN r USING (facts)")
def reference_members(spark, sf_dir):
    """The class of each letter in ``edge_refs``."""
    return g.members(g.reference_sets(notices(spark, sf_dir)))


@query("reference_classes", _classes("refs", "references"))
def reference_classes(spark, sf_dir):
    return g.reference_classes(notices(spark, sf_dir))


@query("edge_party", _shared("[lower(sender), lower(recipient)]") + " SELECT a, b, 'same_party' AS edge_type, round(shared / greatest(na, nb), 6) AS weight FROM w")
def edge_party(spark, sf_dir):
    """Edges between classes; ``edge_members`` has the class of each letter."""
    return g.party_edges(notices(spark, sf_dir))


@query("party_classes", _classes("[lower(sender), lower(recipient)]", "same_party"))
def party_classes(spark, sf_dir):
    return g.party_classes(notices(spark, sf_dir))


@query("edge_party_weights", _shared("[lower(sender), lower(recipient)]") + """, e AS (SELECT a, b, round(shared / greatest(na, nb), 6) AS weight FROM w)
    SELECT a, b, 'same_party' AS edge_type, weight FROM (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e) WHERE a % 100 = 0""")
def edge_party_weights(spark, sf_dir):
    """Weighted edges of the classes whose id is divisible by 100."""
    facts = stash(g.party_classes(notices(spark, sf_dir)), "party-classes")
    return g.weighted(facts, facts.filter("id % 100 = 0"))


@query("edge_topic", _shared("topics") + " SELECT a, b, 'same_topic' AS edge_type, round(shared / (na + nb - shared), 6) AS weight FROM w WHERE round(shared / (na + nb - shared), 6) >= 0.3")
def edge_topic(spark, sf_dir):
    return g.topic_edges(notices(spark, sf_dir))


@query("edge_members", _shared("[lower(sender), lower(recipient)]") + " SELECT doc_id AS id, r.id AS rep FROM k JOIN r USING (facts)")
def edge_members(spark, sf_dir):
    return g.members(g.party_sets(notices(spark, sf_dir)))


@query("edge_contract", _N + ", m AS (SELECT doc_id AS b, min(doc_id) OVER (PARTITION BY contract_ref) AS a FROM notices) SELECT a, b, 'same_contract' AS edge_type, CAST(0.9 AS DOUBLE) AS weight FROM m WHERE a <> b")
def edge_contract(spark, sf_dir):
    return g.contract_edges(notices(spark, sf_dir))


_REPLY = "SELECT x.doc_id AS a, y.doc_id AS b, 'reply_to' AS edge_type, CAST(0.85 AS DOUBLE) AS weight FROM days x JOIN days y ON x.sender = y.recipient AND x.recipient = y.sender AND y.date > x.date"
_CHRONO = """SELECT DISTINCT a, b, 'chronological_next' AS edge_type, CAST(0.5 AS DOUBLE) AS weight FROM (
    SELECT doc_id AS a, lead(doc_id) OVER (PARTITION BY party ORDER BY date, doc_id) AS b FROM (
        SELECT doc_id, date, sender AS party FROM notices UNION ALL SELECT doc_id, date, recipient FROM notices)) WHERE b IS NOT NULL"""


@query("edge_reply", f"{_DAYS} {_REPLY}")
def edge_reply(spark, sf_dir):
    return g.reply_edges(notices(spark, sf_dir))


@query("reply_members", _N + " SELECT doc_id AS id, min(doc_id) OVER w AS rep, count(*) OVER w AS size FROM notices WINDOW w AS (PARTITION BY lower(sender), lower(recipient), date)")
def reply_members(spark, sf_dir):
    return g.reply_members(notices(spark, sf_dir))


@query("edge_chrono", f"{_N} {_CHRONO}")
def edge_chrono(spark, sf_dir):
    return g.chronological_edges(notices(spark, sf_dir))


_EDGES = f"{_DAYS}, e AS ({_REPLY} UNION ALL {_CHRONO})"


def _edges(spark, sf_dir):
    letters = notices(spark, sf_dir)
    return g.reply_edges(letters).unionByName(g.chronological_edges(letters))


@query("edge_stats", _EDGES + " SELECT edge_type, count(*) AS n, count(DISTINCT a) AS sources, round(sum(weight), 2) AS weight FROM e GROUP BY edge_type")
def edge_stats(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("edge_type").agg(F.count("*").alias("n"), F.count_distinct("a").alias("sources"), F.round(F.sum("weight"), 2).alias("weight"))


@query("edge_closure", _EDGES + " SELECT a, b FROM e UNION SELECT b, a FROM e")
def edge_closure(spark, sf_dir):
    return g.both_ways(_edges(spark, sf_dir))


@query("in_degree", _EDGES + " SELECT b AS node, count(*) AS in_degree FROM e GROUP BY b")
def in_degree(spark, sf_dir):
    return g.in_degree(_edges(spark, sf_dir))


_REPLIES = f"{_DAYS}, e AS ({_REPLY}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"


def _trace_sql(depth: int) -> str:
    text = _REPLIES.replace("WITH ", "WITH RECURSIVE ", 1)
    return text + f""", t(start, node, depth) AS (
        SELECT DISTINCT a, a, 0 FROM u WHERE a % 100 = 0
        UNION SELECT t.start, u.b, t.depth + 1 FROM t JOIN u ON u.a = t.node WHERE t.depth < {depth})
    SELECT start, node, CAST(min(depth) AS INTEGER) AS depth FROM t GROUP BY 1, 2"""


def _replies(spark, sf_dir):
    """Reply edges, written once, and the letters that searches start from."""
    edges = stash(g.reply_edges(notices(spark, sf_dir)).select("a", "b"), "graph-replies")
    return edges, g.both_ways(edges).select(F.col("a").alias("start")).filter("start % 100 = 0").distinct()


@query("trace_depth3", _trace_sql(3))
def trace_depth3(spark, sf_dir):
    return g.trace(*_replies(spark, sf_dir), 3)


def _paths_sql(depth: int) -> str:
    """Levels of shortest ways, each the first of the ways of that length."""
    levels = ["l0 AS (SELECT DISTINCT a AS start, a AS node, [a] AS path FROM u WHERE a % 100 = 0)"]
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT start, node FROM l{j}" for j in range(k))
        levels.append(f"l{k} AS (SELECT start, b AS node, min(list_append(path, b)) AS path FROM l{k - 1} JOIN u ON u.a = node WHERE NOT EXISTS (SELECT 1 FROM ({before}) s WHERE s.start = l{k - 1}.start AND s.node = u.b) GROUP BY 1, 2)")
    return f"{_REPLIES}, {', '.join(levels)} SELECT start, node AS goal, array_to_string(path, '>') AS path FROM ({' UNION ALL '.join(f'SELECT * FROM l{k}' for k in range(1, depth + 1))})"


@query("shortest_path", _paths_sql(4))
def shortest_path(spark, sf_dir):
    edges, starts = _replies(spark, sf_dir)
    pairs = stash(g.trace(edges, starts, 4).filter("depth > 0").select("start", F.col("node").alias("goal")), "graph-pairs")
    return g.paths(edges, pairs, 3).select("start", "goal", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("neighbours_by_weight", _shared("refs") + " SELECT CASE WHEN a = m THEN b ELSE a END AS b, max(round(shared / greatest(na, nb), 6)) AS weight FROM w, (SELECT min(a) AS m FROM w) WHERE a = m OR b = m GROUP BY 1 ORDER BY weight DESC, b LIMIT 10")
def neighbours_by_weight(spark, sf_dir):
    facts = stash(g.reference_classes(notices(spark, sf_dir)), "reference-classes")
    least = facts.filter("links > 0").agg(F.min("id")).first()[0]
    least = least if least is not None else -1
    return g.neighbours(g.weighted(facts, facts.filter(F.col("id") == least)), least)


@query("reply_components", _REPLIES.replace("WITH ", "WITH RECURSIVE ", 1) + ", r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a")
def reply_components(spark, sf_dir):
    return connected_components(g.reply_edges(notices(spark, sf_dir)).select("a", "b"))


@query("topic_components")
def topic_components(spark, sf_dir):
    return connected_components(g.topic_edges(notices(spark, sf_dir), 0.5).select("a", "b")).groupBy("component").agg(F.count("*").alias("size"))


@query("priority_clusters", _N + """, k AS (SELECT doc_id, least(lower(sender), lower(recipient)) || ' / ' || greatest(lower(sender), lower(recipient)) AS pair, lower(project) AS project FROM notices),
    p AS (SELECT *, count(*) OVER (PARTITION BY pair) AS np FROM k), q AS (SELECT *, count(*) OVER (PARTITION BY project) AS nq FROM p WHERE np = 1)
    SELECT 'pair' AS kind, pair AS name, count(*) AS n FROM p WHERE np > 1 GROUP BY 2 UNION ALL SELECT 'project', project, count(*) FROM q WHERE nq > 1 GROUP BY 2""")
def priority_clusters(spark, sf_dir):
    return g.clusters(notices(spark, sf_dir)).groupBy("kind", "name").agg(F.count("*").alias("n"))
