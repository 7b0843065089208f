"""Text retrieval: chunks, tokens, postings, BM25, dense search, fusion and quotas.

Queries are a table (``query_id``, terms or vector), so one job ranks for any
number of them; the chunks are read once.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import ship
from orrery.storage import stash

# Okapi's constants and the fusion's.
K1, B = 1.2, 0.75
RRF_K = 60
CANDIDATES, FINAL = 30, 6
#: Query terms and vectors go to every task; more than these many rows take a shuffled join.
SMALL = 50_000
#: Bytes at most of such a table, by the size of its first rows.
SMALL_BYTES = 64_000_000
#: Vectors and queries of a block, queries of a block that are looked at together, and the error of products that decide what is looked at anew.
ROW_BLOCK, QUERY_BLOCK, AT_ONCE, MARGIN = 8_192, 8_192, 256, 1e-9
#: Query terms that a filter names one by one.
LISTED = 1_000


def windows(docs: DataFrame, size: int, stride: int) -> DataFrame:
    """Chunks of ``size`` characters, one every ``stride``, until the text is covered; ``page`` counts from 0."""
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - (size - stride)) / F.lit(float(stride)))).cast("int")
    pages = docs.filter("text is not null").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))))
    return pages.withColumn("text", F.substring(F.col("text"), (F.col("page") * stride + 1).cast("int"), F.lit(size)))


def tokens(text: Column) -> Column:
    """Words of a-z and 0-9 in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")


def stem(word: Column) -> Column:
    """A plural's likely singular: -ies to -y, -es after s, sh, ch, x or z, else -s but not -ss."""
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(F.left(word, n - 3), F.lit("y")))
        .when(word.rlike("(ss|sh|ch|x|z)es$") & (n > 4), F.left(word, n - 2))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 3), F.left(word, n - 1))
        .otherwise(word)
    )


def fits(frame: DataFrame) -> bool:
    """Whether a table has at most SMALL rows and, by the size of their values, SMALL_BYTES, so that it may be broadcast."""
    size = F.length(F.to_json(F.struct(*frame.columns)))
    rows, chars = frame.limit(SMALL + 1).agg(F.count("*"), F.sum(size)).first()
    return rows <= SMALL and (chars or 0) <= SMALL_BYTES


def small(frame: DataFrame) -> DataFrame:
    """Marks a table for broadcast if it :func:`fits`."""
    return F.broadcast(frame) if fits(frame) else frame


def postings(docs: DataFrame, key: list[str]) -> DataFrame:
    """``term, tf, dl`` of each document: the layout to store when many queries follow."""
    words = docs.select(*key, tokens(F.col("text")).alias("w"))
    return words.select(*key, F.size("w").cast("long").alias("dl"), F.explode("w").alias("term")).groupBy(*key, "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: list[str], queries: DataFrame) -> DataFrame:
    """Okapi scores of documents for ``queries(query_id, term)``.

    Texts are read and cut into words once: of each, its length and the words
    that a query asks for go to a slim table, which all that follows reads.
    """
    terms = queries.select("query_id", "term").distinct()
    asked = [r["term"] for r in terms.select("term").distinct().limit(LISTED + 1).collect()]
    words = docs.select(*key, tokens(F.col("text")).alias("w"))
    kept = F.filter("w", lambda x: x.isin(asked)) if len(asked) <= LISTED else F.col("w")
    slim = stash(words.select(*key, F.size("w").cast("long").alias("dl"), kept.alias("w")), "bm25-words")
    n, average = slim.agg(F.count("*"), F.avg("dl")).first()
    found = slim.select(*key, "dl", F.explode("w").alias("term"))
    if len(asked) > LISTED:
        found = found.join(small(terms.select("term").distinct()), "term")
    found = found.groupBy(*key, "dl", "term").agg(F.count("*").alias("tf"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    facts = terms.join(df, "term")  # a row for each term of each query
    idf = F.ln(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(average or 1.0))))
    scored = found.join(small(facts), "term")
    return scored.groupBy("query_id", *key).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, group: str, score: str, ties: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each group with ``rank`` from 1; each task keeps its own k first."""
    window = Window.partitionBy(group).orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def dense(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """For each of ``queries(query_id, query)`` the ``k`` rows of ``vectors(vec_id, embedding)`` of the largest cosine.

    The stated queries meet all rows, in blocks of both as matrices; of a block,
    the best k of each query go on.
    """

    def pick(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        ids, size = rows["vec_id"].to_numpy(), rows["v"].map(lambda v: -1 if v is None else len(v)).to_numpy()
        first, out = np.lexsort((ids,)), []
        for n, group in asked.groupby(asked["v"].map(lambda v: -1 if v is None else len(v))):
            like = np.flatnonzero(size == n) if n >= 0 else np.array([], int)
            unlike = first[size[first] != n][:k] if n >= 0 else first[:k]  # no cosine; they come last
            held = np.stack(rows["v"].to_numpy()[like]) if len(like) else np.zeros((0, max(n, 0)))
            for at in range(0, len(group), AT_ONCE):
                some = group.iloc[at : at + AT_ONCE]
                near = np.stack(some["v"].to_numpy()) @ held.T if len(like) else np.zeros((len(some), 0))
                near[np.isnan(near)] = np.inf
                least = np.partition(near, -k, axis=1)[:, -k] - MARGIN if near.shape[1] > k else np.full(len(some), -np.inf)
                for query, v, row, low in zip(some["query_id"], some["v"], near, least, strict=True):
                    best = np.flatnonzero(row >= low)
                    score = np.zeros(len(best))
                    for d in range(max(n, 0)):  # added up in order, as dot() does, so equal vectors have equal scores
                        score += held[best, d] * v[d]
                    order = np.lexsort((ids[like[best]], -np.where(np.isnan(score), np.inf, score)))[:k]
                    found = np.concatenate([ids[like[best[order]]], ids[unlike]])
                    out.append((np.full(len(found), query), found, np.concatenate([score[order], np.full(len(unlike), np.nan)]), np.arange(len(found)) < len(order)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 4
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "alike"), columns, strict=True)))

    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), unit(c)).alias("v")
    near = _blocks(vectors.select("vec_id", whole(F.col("embedding"))), queries.select("query_id", whole(F.col("query"))), pick, "query_id long, vec_id long, score double, alike boolean")
    return top_k(near.select("query_id", "vec_id", F.when(F.col("alike"), F.coalesce("score", F.lit(float("nan")))).alias("score")), "query_id", "score", ["vec_id"], k)


def nearest_ids(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """For each ``query_id`` of ``queries`` the ``k`` rows of ``vectors(vec_id)`` whose ids are nearest, of two as near the smaller first."""

    def pick(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        ids, wanted, out = np.sort(rows["vec_id"].to_numpy()), asked["query_id"].to_numpy(), []
        for at in range(0, len(wanted) if len(ids) else 0, AT_ONCE):
            some = wanted[at : at + AT_ONCE, None]
            place = np.searchsorted(ids, some) + np.arange(-k, k)
            there = (place >= 0) & (place < len(ids))
            found = ids[place.clip(0, len(ids) - 1)]
            order = np.argsort(np.where(there, np.abs(found - some), np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
            kept = np.take_along_axis(there, order, 1)
            out.append((np.broadcast_to(some, kept.shape)[kept], np.take_along_axis(found, order, 1)[kept]))
        return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out] or [[]]), "vec_id": np.concatenate([o[1] for o in out] or [[]])})

    near = _blocks(vectors.select("vec_id").filter("vec_id is not null"), queries.select("query_id").filter("query_id is not null"), pick, "query_id long, vec_id long")
    return top_k(near.withColumn("near", -F.abs(F.col("query_id") - F.col("vec_id"))), "query_id", "near", ["vec_id"], k)


def _blocks(rows: DataFrame, queries: DataFrame, pick: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``pick`` takes of each block of rows with each block of queries."""
    ship(rows.sparkSession)
    n, m = max(1, ceil(rows.count() / ROW_BLOCK)), max(1, ceil(queries.count() / QUERY_BLOCK))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    own = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    left, right = rows.withColumns({"i": own("vec_id", n), "j": every(m)}), queries.withColumns({"i": every(n), "j": own("query_id", m)})
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(pick, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; -1 when the lengths differ or one is zero."""
    length = lambda v: F.sqrt(dot(v, v))
    return F.when((F.size(a) == F.size(b)) & (length(a) > 0) & (length(b) > 0), dot(a, b) / (length(a) * length(b))).otherwise(F.lit(-1.0))


def fuse(lanes: list[DataFrame], key: list[str], boost: Column | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of lanes of ``query_id, key.., rank`` (from 1); a key in several lanes adds up.

    ``boost`` (over the fused columns) adds at most half of what a first place gives.
    """
    rows = lanes[0].select("query_id", *key, "rank")
    for lane in lanes[1:]:
        rows = rows.unionByName(lane.select("query_id", *key, "rank"))
    fused = rows.groupBy("query_id", *key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    return fused if boost is None else fused.withColumn("score", F.col("score") + F.least(boost, F.lit(0.5 / (k + 1))))


def hybrid(dense_hits: DataFrame, lexical_hits: DataFrame, meta: list[str], boost: DataFrame | None = None, k: int = FINAL) -> DataFrame:
    """Fused ranking of two lanes of ``query_id, file, page, rank, meta..``, one row for each file and page.

    Of the hits of a lane on one page the first counts, and places are counted
    anew; facts that one lane lacks come from the other. ``boost(query_id,
    doc_id, boost)``, from 0 to 1, adds at most half of what a first place gives.
    """
    keys = ["query_id", "file", "page"]

    def lane(hits: DataFrame, name: str) -> DataFrame:
        first = hits.groupBy(*keys).agg(F.min(F.struct("rank", *meta)).alias("h")).select(*keys, "h.*")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "file", "page"))
        return first.withColumn("rank", place).select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in ("rank", *meta)))

    both = lane(dense_hits, "d").join(lane(lexical_hits, "l"), keys, "full_outer")
    part = lambda c: F.coalesce(1 / (RRF_K + F.col(c)), F.lit(0.0))
    fused = both.select(*keys, *(F.coalesce(f"d_{c}", f"l_{c}").alias(c) for c in meta), (part("d_rank") + part("l_rank")).alias("score"))
    if boost is not None:
        fused = fused.join(boost, ["query_id", "doc_id"], "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0)) * 0.5 / (RRF_K + 1)).drop("boost")
    return top_k(fused.withColumn("score", F.round("score", 9)), "query_id", "score", ["file", "page"], k)


def rank_normalised(lanes: DataFrame, lane: str, score: str, ties: list[str]) -> DataFrame:
    """Scores of a lane replaced by (n - place) / n."""
    window = Window.partitionBy(lane)
    place = F.row_number().over(window.orderBy(F.desc(score), *ties)) - 1
    return lanes.withColumn("share", F.round(1 - place / F.count("*").over(window), 6))


def neighbour_pages(hits: DataFrame, pages: DataFrame, damp: float = 0.85) -> DataFrame:
    """Hits ``doc_id, page, score`` and the pages beside them at a damped score; the larger score of a page stays."""
    beside = hits.select("doc_id", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("page"), (F.col("score") * damp).alias("score"))
    known = beside.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    return hits.select("doc_id", "page", "score").unionByName(known).groupBy("doc_id", "page").agg(F.max("score").alias("score"))


def role_quota(rows: DataFrame, role: str, score: str, ties: list[str], quotas: dict[str, int], total: int) -> DataFrame:
    """The best rows of each role up to its quota, then the best of the rest up to ``total``."""
    place = F.row_number().over(Window.partitionBy(role).orderBy(F.desc(score), *ties))
    limit = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in quotas.items() for x in p)), F.col(role)), F.lit(0))
    # no row beyond a role's first `total` can be taken, so the last window sees few rows
    few = rows.withColumn("_place", place).filter(F.col("_place") <= total).withColumn("_first", (F.col("_place") <= limit).cast("int"))
    best = few.orderBy(F.desc("_first"), F.desc(score), *ties).limit(total)
    return best.withColumn("picked_as", F.when(F.col("_first") == 1, "quota").otherwise("fill")).drop("_place", "_first")


def like_hits(docs: DataFrame, key: list[str], words: list[str], most: int = 8) -> DataFrame:
    """Documents by the number of distinct query words (3 letters or more, the first few) that the text contains."""
    kept = list(dict.fromkeys(w.lower() for w in words if len(w) >= 3))[:most]
    hits = sum((F.lower("text").contains(w).cast("long") for w in kept), F.lit(0).cast("long"))
    return docs.select(*key, hits.alias("hits")).filter("hits > 0")


def term_score(word: Column, term: Column) -> Column:
    """How well a word meets a term: exact 1, prefix 0.75, a common start of five letters 0.7, part 0.5."""
    return (
        F.when(word == term, 1.0)
        .when(word.startswith(term) | term.startswith(word), 0.75)
        .when((F.length(word) >= 5) & (F.length(term) >= 5) & (F.left(word, F.lit(5)) == F.left(term, F.lit(5))), 0.7)
        .when(word.contains(term) | term.contains(word), 0.5)
        .otherwise(0.0)
    )


def scoped(rows: DataFrame, project: str | None, corpus: str | None = None, **fields: list) -> DataFrame:
    """Rows of one project (and corpus) with fields in given lists; without a project there are none."""
    if not project:
        return rows.filter(F.lit(False))
    unknown = set(fields) - set(rows.columns)
    if unknown:
        raise ValueError(f"unknown scope {sorted(unknown)}")
    out = rows.filter(F.col("project_id") == project)
    out = out.filter(F.col("corpus") == corpus) if corpus else out
    for name, values in fields.items():
        out = out.filter(F.col(name).isin(values))
    return out


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """The mean of each group's unit vectors, as a unit vector."""
    sums = vectors.select(group, F.posexplode(unit(F.col("embedding"))).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return sums.groupBy(group).agg(unit(ordered).alias("centroid"))


def nearest(vectors: DataFrame, centres: DataFrame, group: str, least: float = 0.55) -> DataFrame:
    """Each vector's nearest centre, or none under ``least``; ties go to the smaller name."""
    met = vectors.select("vec_id", "embedding").join(small(centres))
    scored = met.select("vec_id", F.struct(cosine(F.col("embedding"), F.col("centroid")).alias("c"), (-F.col(group)).alias("neg")).alias("s"))
    best = scored.groupBy("vec_id").agg(F.max("s").alias("s"))
    return best.select("vec_id", F.when(F.col("s.c") >= least, -F.col("s.neg")).alias("assigned"), F.round("s.c", 6).alias("similarity"))
