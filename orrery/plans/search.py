"""Queries that rank texts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import density
from orrery.operators import document_index as di
from orrery.operators import retrieval as r
from orrery.plans.registry import query
from orrery.plans.views import CHUNKS, PROFILES, chunks, profiles, table

QUERIES = {1: ["the", "which", "under"], 2: ["die", "nicht", "zu"], 3: ["les", "pour"]}


def _terms(spark):
    return spark.createDataFrame([(q, w) for q, words in QUERIES.items() for w in words], "query_id int, term string")


_Q = "q(query_id, term) AS (VALUES " + ", ".join(f"({q}, '{w}')" for q, ws in QUERIES.items() for w in ws) + ")"
_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


def _bm25_sql(source: str, key: str) -> str:
    return f"""w AS (SELECT {key}, {_TOKENS.format('text')} AS w FROM {source}), s AS (SELECT count(*) AS n, avg(len(w)) AS average FROM w),
    f AS (SELECT {key}, dl, term, count(*) AS tf FROM (SELECT {key}, len(w) AS dl, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    d AS (SELECT term, count(*) AS df FROM f GROUP BY term),
    b AS (SELECT query_id, {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))) AS score FROM f JOIN d USING (term) JOIN q USING (term), s GROUP BY ALL)"""


@query("chunk_windows", f"WITH {CHUNKS} SELECT project_id, corpus, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks GROUP BY 1, 2")
def chunk_windows(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("project_id", "corpus").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("tokens_per_doc", f"SELECT doc_id, len({_TOKENS.format('text')}) AS n, len(list_distinct({_TOKENS.format('text')})) AS kinds FROM documents")
def tokens_per_doc(spark, sf_dir):
    words = r.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n"), F.size(F.array_distinct(words)).cast("long").alias("kinds"))


@query("bm25_docs", f"WITH {_Q}, {_bm25_sql('documents', 'doc_id')} SELECT query_id, doc_id, round(score, 6) AS score FROM b")
def bm25_docs(spark, sf_dir):
    return r.bm25(table(spark, sf_dir, "documents"), ["doc_id"], _terms(spark)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("bm25_chunks_top", f"WITH {CHUNKS}, {_Q}, {_bm25_sql('chunks', 'doc_id, page')} SELECT query_id, doc_id, page, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id, page) AS INTEGER) AS rank FROM b) WHERE rank <= 30")
def bm25_chunks_top(spark, sf_dir):
    scored = r.bm25(chunks(spark, sf_dir), ["doc_id", "page"], _terms(spark)).withColumn("score", F.round("score", 6))
    return r.top_k(scored, "query_id", "score", ["doc_id", "page"], 30).select("query_id", "doc_id", "page", "rank")


@query("doc_index_score", f"""WITH {_Q}, {_bm25_sql('documents', 'doc_id')}, m AS (SELECT query_id, max(score) AS top FROM b GROUP BY 1)
    SELECT query_id, doc_id, round(2 * score / top + CASE WHEN lang = 'en' THEN 0.5 ELSE 0 END + CASE WHEN source = 'src0' THEN 0.25 ELSE 0 END, 6) AS score FROM b JOIN m USING (query_id) JOIN documents USING (doc_id)""")
def doc_index_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = r.bm25(docs, ["doc_id"], _terms(spark))
    top = scored.groupBy("query_id").agg(F.max("score").alias("top"))
    signals = F.when(F.col("lang") == "en", 0.5).otherwise(0.0) + F.when(F.col("source") == "src0", 0.25).otherwise(0.0)
    return scored.join(r.small(top), "query_id").join(docs.select("doc_id", "lang", "source"), "doc_id").select("query_id", "doc_id", F.round(2 * F.col("score") / F.col("top") + signals, 6).alias("score"))


@query("like_fallback", "SELECT * FROM (SELECT doc_id, CAST(contains(lower(text), 'the') AS BIGINT) + CAST(contains(lower(text), 'which') AS BIGINT) + CAST(contains(lower(text), 'sich') AS BIGINT) AS hits FROM documents) WHERE hits > 0")
def like_fallback(spark, sf_dir):
    return r.like_hits(table(spark, sf_dir, "documents"), ["doc_id"], ["The", "which", "to", "sich"])


def _query_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


_DENSE = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    n AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS c FROM v q, v WHERE q.vec_id % 100 = 0),
    t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS INTEGER) AS rank FROM n)"""


@query("dense_topk", f"WITH {_DENSE} SELECT query_id, vec_id, rank, round(c, 6) AS score FROM t WHERE rank <= 30")
def dense_topk(spark, sf_dir):
    return r.dense(table(spark, sf_dir, "embeddings"), _query_vectors(spark, sf_dir)).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("rrf_fuse", f"""WITH {_DENSE}, x AS (SELECT query_id, vec_id, rank FROM t WHERE rank <= 30 UNION ALL
      SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY abs(query_id - vec_id), vec_id) AS INTEGER) FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY abs(query_id - vec_id), vec_id) <= 30),
    f AS (SELECT query_id, vec_id, sum(1.0 / (60 + rank)) AS score FROM x GROUP BY 1, 2)
    SELECT query_id, vec_id, round(score, 8) AS score FROM f""")
def rrf_fuse(spark, sf_dir):
    vectors, queries = table(spark, sf_dir, "embeddings"), _query_vectors(spark, sf_dir)
    return r.fuse([r.dense(vectors, queries), r.nearest_ids(vectors, queries)], ["vec_id"]).select("query_id", "vec_id", F.round("score", 8).alias("score"))


_LANE = "SELECT query_id, 'f' || CAST(doc_id % 20 AS VARCHAR) AS file, doc_id % 40 // 20 AS page, doc_id"


@query("hybrid_search", f"""WITH {_Q}, {_DENSE}, {_bm25_sql('documents', 'doc_id')},
    dn AS ({_LANE}, n_chars AS total_pages, rank FROM (SELECT CAST(query_id // 100 AS INTEGER) AS query_id, vec_id AS doc_id, rank FROM t WHERE rank <= 30 AND query_id IN (100, 200, 300)) JOIN documents USING (doc_id)),
    ln AS ({_LANE}, CAST(NULL AS BIGINT) AS total_pages, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM b) WHERE rank <= 30),
    dk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, file, page) AS place FROM (SELECT query_id, file, page, arg_min(doc_id, rank) AS doc_id, arg_min(total_pages, rank) AS total_pages, min(rank) AS first FROM dn GROUP BY 1, 2, 3)),
    lk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, file, page) AS place FROM (SELECT query_id, file, page, arg_min(doc_id, rank) AS doc_id, min(rank) AS first FROM ln GROUP BY 1, 2, 3)),
    fu AS (SELECT query_id, file, page, coalesce(dk.doc_id, lk.doc_id) AS doc_id, total_pages, round(coalesce(1.0 / (60 + dk.place), 0) + coalesce(1.0 / (60 + lk.place), 0), 9) AS score FROM dk FULL JOIN lk USING (query_id, file, page))
    SELECT query_id, file, page, doc_id, total_pages, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file, page) AS rank FROM fu) WHERE rank <= 6""")
def hybrid_search(spark, sf_dir):
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    wanted = vectors.filter("vec_id in (100, 200, 300)").select((F.col("vec_id") / 100).cast("int").alias("query_id"), F.col("embedding").alias("query"))
    place = lambda d: d.withColumn("file", F.concat(F.lit("f"), (F.col("doc_id") % 20).cast("string"))).withColumn("page", F.floor(F.col("doc_id") % 40 / 20))
    near = r.dense(vectors, wanted).withColumnRenamed("vec_id", "doc_id").join(docs.select("doc_id", F.col("n_chars").cast("long").alias("total_pages")), "doc_id")
    scored = r.bm25(docs, ["doc_id"], _terms(spark)).withColumn("score", F.round("score", 6))
    said = r.top_k(scored, "query_id", "score", ["doc_id"], r.CANDIDATES).withColumn("total_pages", F.lit(None).cast("long"))
    return r.hybrid(place(near), place(said), ["doc_id", "total_pages"])


@query("rank_normalised", "SELECT event_type, event_id, round(1 - (row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1) / count(*) OVER (PARTITION BY event_type), 6) AS share FROM events")
def rank_normalised(spark, sf_dir):
    return r.rank_normalised(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", "value", ["event_id"]).drop("value")


@query("neighbour_pages", f"""WITH {CHUNKS}, h AS (SELECT doc_id, page, CAST(1 + page % 3 AS DOUBLE) AS score FROM chunks WHERE contains(lower(text), 'which')),
    a AS (SELECT * FROM h UNION ALL SELECT doc_id, page, score FROM (SELECT doc_id, unnest([page - 1, page + 1]) AS page, score * 0.85 AS score FROM h) JOIN (SELECT doc_id, page FROM chunks) USING (doc_id, page))
    SELECT doc_id, page, round(max(score), 6) AS score FROM a GROUP BY 1, 2""")
def neighbour_pages(spark, sf_dir):
    found = chunks(spark, sf_dir)
    hits = found.filter(F.lower("text").contains("which")).select("doc_id", "page", (1 + F.col("page") % 3).cast("double").alias("score"))
    return r.neighbour_pages(hits, found.select("doc_id", "page")).withColumn("score", F.round("score", 6))


@query("role_quota", """WITH p AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events),
    f AS (SELECT *, CAST(k <= CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 7 WHEN 'purchase' THEN 3 ELSE 0 END AS INTEGER) AS first FROM p)
    SELECT event_id, event_type, CASE WHEN first = 1 THEN 'quota' ELSE 'fill' END AS picked_as FROM f ORDER BY first DESC, value DESC, event_id LIMIT 20""")
def role_quota(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return r.role_quota(rows, "event_type", "value", ["event_id"], {"click": 2, "view": 7, "purchase": 3}, 20).drop("value")


@query("source_blend", "SELECT event_id, round(value / 100 + CASE WHEN event_type = 'view' THEN 0.30 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 0.10 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 0.05 ELSE 0 END, 6) AS score FROM events ORDER BY score DESC, event_id LIMIT 50")
def source_blend(spark, sf_dir):
    bonus = sum((F.when(c, w).otherwise(0.0) for c, w in ((F.col("event_type") == "view", 0.30), (F.col("user_id") % 2 == 0, 0.10), (F.col("event_id") % 5 == 0, 0.05))), F.lit(0.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") / 100 + bonus, 6).alias("score")).orderBy(F.desc("score"), "event_id").limit(50)


@query("scope_filter", f"WITH {CHUNKS} SELECT doc_id, count(*) AS n FROM chunks WHERE project_id = 'src0' AND corpus = 'en' AND page IN (0, 1) GROUP BY doc_id")
def scope_filter(spark, sf_dir):
    return r.scoped(chunks(spark, sf_dir), "src0", "en", page=[0, 1]).groupBy("doc_id").agg(F.count("*").alias("n"))


_CENTRE = """v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS u, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    c AS (SELECT label, i, avg(u[i]) AS x FROM v, range(1, 65) t(i) GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY i) AS centroid FROM c GROUP BY 1)"""


@query("centroids", f"WITH {_CENTRE} SELECT label, round(list_dot_product(centroid, list_transform(range(1, 65), lambda i: CAST(i AS DOUBLE))) / sqrt(list_dot_product(centroid, centroid)), 6) AS mark FROM m")
def centroids(spark, sf_dir):
    centre = r.centroids(table(spark, sf_dir, "embeddings"), "label")
    weights = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    return centre.select("label", F.round(r.dot(F.col("centroid"), weights), 6).alias("mark"))


@query("assign_nearest_055", f"""WITH {_CENTRE}, s AS (SELECT vec_id, m.label, list_cosine_similarity(e, centroid) AS c FROM v, m), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS k FROM s)
    SELECT vec_id, CASE WHEN c >= 0.55 THEN label END AS assigned, round(c, 6) AS similarity FROM t WHERE k = 1""")
def assign_nearest_055(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return r.nearest(vectors, r.centroids(vectors, "label"), "label")


_INDEX_TEXT = "CASE doc_id % 4 WHEN 0 THEN 'Audit overview' WHEN 1 THEN 'Notice of variation' WHEN 2 THEN 'Reply confirmed' ELSE 'Site diary' END || chr(10) || text"


def _any(words, column="lower(text)"):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_INDEX = f"""x AS (SELECT doc_id, source || '.pdf' AS file_name, {_INDEX_TEXT} AS text FROM documents),
    q(query_id, term) AS (VALUES (0, 'variation'), (0, 'the')), {_bm25_sql('x', 'doc_id')},
    g AS (SELECT x.doc_id, file_name, text, coalesce(score / max(score) OVER (), 0) AS lexical, {_any(di.MAP_TERMS)} AS is_map, {_any(di.PRIMARY_TERMS)} AS prime, row_number() OVER (PARTITION BY sha256(text) ORDER BY file_name, x.doc_id) AS k FROM x LEFT JOIN b ON b.doc_id = x.doc_id)"""


@query("document_index", f"""WITH {_INDEX} SELECT doc_id, file_name, CASE WHEN is_map THEN 'map' WHEN prime THEN 'primary' ELSE 'corroborator' END AS role, score FROM (
    SELECT *, round(2 * lexical + CASE WHEN split_part(text, chr(10), 1) = 'Notice of variation' THEN 2 ELSE 0 END + CASE WHEN is_map THEN 0.5 WHEN prime THEN 1.5 ELSE 0 END
      + CASE WHEN contains(lower(text), 'idiot') THEN 1 ELSE 0 END + CASE WHEN {_any(di.CORROBORATION_TERMS)} THEN 1 ELSE 0 END + CASE WHEN {_any(di.COUNTER_TERMS)} THEN 1 ELSE 0 END + CASE WHEN k > 1 THEN -1.5 ELSE 0 END, 6) AS score FROM g) WHERE score > 0""")
def document_index(spark, sf_dir):
    heads = F.element_at(F.array(*(F.lit(h) for h in ("Audit overview", "Notice of variation", "Reply confirmed", "Site diary"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".pdf")).alias("file_name"), F.concat(heads, F.lit("\n"), "text").alias("text"), F.lit(0).alias("ocr_pages"), F.lit(1).alias("total_pages"))
    return di.ranked(di.records(docs), di.Topic("notice of variation", ("variation", "the"), parties=("idiot",)))


def _density_sql(rows: str = "embeddings", before: str = "", first: tuple[float, ...] = density.LEVELS) -> str:
    """The clusters of a view's vectors by a search among all pairs: components of each level by recursion, then the masses level by level."""
    n = len(first)
    ctes = [f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM {rows}), nodes AS (SELECT min(vec_id) AS node, count(*) AS weight, e FROM v GROUP BY e),
    near AS (SELECT * FROM (SELECT a.node AS a, b.node AS b, b.weight, greatest(1 - list_cosine_similarity(a.e, b.e), 0) AS d, row_number() OVER (PARTITION BY a.node ORDER BY greatest(1 - list_cosine_similarity(a.e, b.e), 0), b.node) AS k FROM nodes a JOIN nodes b ON a.node <> b.node) WHERE k <= {density.NEAR}),
    core AS (SELECT node AS a, CASE WHEN weight > {density.SAMPLES} THEN 0 ELSE far END AS core FROM nodes LEFT JOIN (SELECT a, min(d) AS far FROM (SELECT near.a, near.d, sum(near.weight) OVER (PARTITION BY near.a ORDER BY d, b) + nodes.weight - 1 AS others FROM near JOIN nodes ON nodes.node = near.a) WHERE others >= {density.SAMPLES} GROUP BY a) f ON f.a = node WHERE weight > {density.SAMPLES} OR far IS NOT NULL),
    m AS (SELECT near.a, near.b, greatest(d, x.core, y.core) AS d FROM near JOIN core x ON x.a = near.a JOIN core y ON y.a = near.b),
    e AS (SELECT a, b, d FROM m UNION SELECT b, a, d FROM m)"""]
    for i, far in enumerate(first):
        nearer = f" - {1 / first[i + 1]!r}" if i + 1 < n else ""
        ctes.append(f"""r{i}(a, b) AS (SELECT node, node FROM nodes UNION SELECT r{i}.a, e.b FROM r{i} JOIN e ON e.a = r{i}.b AND e.d <= {far}), p{i} AS (SELECT a AS node, min(b) AS part FROM r{i} GROUP BY a),
    h{i} AS (SELECT part, sum(weight) * ({1 / far!r}{nearer}) AS mass FROM p{i} JOIN nodes USING (node) GROUP BY part HAVING sum(weight) >= {density.FEWEST})""")
        if not i:
            ctes.append("s0 AS (SELECT part, mass AS own, 0.0 AS below FROM h0)")
        else:
            ctes.append(f"""f{i} AS (SELECT p{i}.part AS up, count(*) AS n, sum(own) AS one, sum(below) AS under, sum(greatest(own, below)) AS best FROM s{i - 1} s JOIN p{i} ON p{i}.node = s.part GROUP BY 1),
    s{i} AS (SELECT part, mass + CASE WHEN n = 1 THEN one ELSE 0 END AS own, CASE WHEN n = 1 THEN under ELSE coalesce(best, 0) END AS below FROM h{i} LEFT JOIN f{i} ON up = part)""")
    picks = " ".join(f"LEFT JOIN (SELECT node, p{i}.part FROM p{i} JOIN s{i} ON s{i}.part = p{i}.part WHERE own >= below) k{i} ON k{i}.node = nodes.node" for i in range(n))
    return f"WITH RECURSIVE {before}{', '.join(ctes)} SELECT vec_id, coalesce({', '.join(f'k{i}.part' for i in reversed(range(n)))}) AS cluster FROM v JOIN nodes ON v.e = nodes.e {picks}"


@query("vector_clusters", _density_sql())
def vector_clusters(spark, sf_dir):
    return density.density_clusters(table(spark, sf_dir, "embeddings"))


#: Distances between customers' profiles, nearer than those of texts: beyond the last one they are all alike.
_NEAR = (0.05, 0.1, 0.2, 0.25, 0.3)


@query("profile_clusters", _density_sql("profiles", f"{PROFILES}, ", _NEAR))
def profile_clusters(spark, sf_dir):
    """Customers who order alike, and those like nobody; neighbours are exact up to 2,048 customers, as blocks are that long."""
    return density.density_clusters(profiles(spark, sf_dir).select("vec_id", "embedding"), _NEAR, block=2048)


@query("term_scores", "SELECT p_type, CASE WHEN lower(p_type) = 'econ' THEN 1.0::DOUBLE WHEN starts_with(lower(p_type), 'econ') THEN 0.75 WHEN contains(lower(p_type), 'econ') THEN 0.5 ELSE 0.0 END AS score, count(*) AS n FROM part GROUP BY 1")
def term_scores(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type", r.term_score(F.lower("p_type"), F.lit("econ")).alias("score")).agg(F.count("*").alias("n"))
