"""Review of documents, evidence packs and batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import ship

# Limits of an evidence pack.
BUDGET, FILE_SHARE, FLOOR, SATURATION, THIN = 240_000, 0.25, 0.35, 25, 8


def relevance(text: Column, words: list[str], issues: list[str] = (), has_deadline: Column | None = None) -> Column:
    """0.15 a word, 0.25 an issue and 0.15 for a deadline, at most 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = sum((low.contains(w.lower()).cast("double") * 0.15 for w in words), F.lit(0.0)) + sum((low.contains(i.lower()).cast("double") * 0.25 for i in issues), F.lit(0.0))
    if has_deadline is not None:
        score = score + has_deadline.cast("double") * 0.15
    return F.round(F.least(score, F.lit(1.0)), 6)


def key_score(type_weight: Column, issues: Column, hits: Column, chars: Column, deadlines: Column, amounts: Column, refs: Column) -> Column:
    """Weight of a document as a key document: type, breadth and density of issues, deadlines, money, references."""
    breadth, density = F.least(issues / 5, F.lit(1.0)), F.least(hits * 1000 / F.greatest(chars, F.lit(1)) / 10, F.lit(1.0))
    flags = [(deadlines > 0, 0.1), (amounts > 0, 0.1), (refs > 0, 0.05)]
    return F.round(F.least(0.25 * type_weight + 0.3 * breadth + 0.2 * density + sum((c.cast("double") * w for c, w in flags), F.lit(0.0)), F.lit(1.0)), 6)


def review_gate(scored: DataFrame, labels: DataFrame, high: float = 0.7, least_accuracy: float = 0.8) -> DataFrame:
    """Accuracy of the scores on human labels, the share that is labelled, and whether the scores may be applied to all."""
    joined = scored.join(labels, "doc_id", "left")
    right = ((F.col("score") >= high).cast("int") == F.col("label")).cast("double")
    row = joined.agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.round(F.avg(right), 6).alias("accuracy"))
    return row.withColumn("apply_all", (F.coalesce("accuracy", F.lit(0.0)) >= least_accuracy) & (F.col("labelled") * 2 >= F.col("n")))


def evidence_pack(passages: DataFrame, budget: int = BUDGET, floor: float = FLOOR, share: float = FILE_SHARE, saturation: int = SATURATION) -> DataFrame:
    """Picks each request's passages greedily by score until its budget of characters is used.

    ``passages(request, file, passage, score, chars, facets array<string>)``.
    Scores under ``floor`` times the best are out; a file takes at most
    ``share`` of the budget; after ``saturation`` picks in a row without a new
    facet the pack is full; facets still missing then take their best passage,
    above the floor or not, while the budget lasts. Order: score, then file,
    then passage. A pick depends on all before it, so each request's passages
    are one group, in the memory of one task.

    Returns ``request, file, passage, pick`` in order of picks.
    """
    ship(passages.sparkSession)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["score", "file", "passage"], ascending=[False, True, True], kind="stable").to_dict("records")
        used, by_file, seen, stale, picks = 0, {}, set(), 0, []
        best = rows[0]["score"] if rows else 0.0

        def take(r: dict) -> bool:
            nonlocal used
            if used + r["chars"] > budget or by_file.get(r["file"], 0) + r["chars"] > share * budget:
                return False
            used += r["chars"]
            by_file[r["file"]] = by_file.get(r["file"], 0) + r["chars"]
            seen.update(r["facets"])
            picks.append(r)
            return True

        rest = []
        for r in rows:
            if r["score"] < floor * best or stale >= saturation:
                rest.append(r)
                continue
            new = set(r["facets"]) - seen
            if take(r):
                stale = 0 if new else stale + 1
        for r in rest:
            if set(r["facets"]) - seen:
                take(r)
        return pd.DataFrame([(r["request"], r["file"], r["passage"], i) for i, r in enumerate(picks)], columns=["request", "file", "passage", "pick"])

    return passages.groupBy("request").applyInPandas(pack, "request long, file long, passage long, pick long")


def described(passages: DataFrame, by: list[str]) -> DataFrame:
    """Facts about a pack: distinct files (``documents``) and doc_ids (``fragments``), passages and their characters.

    A file has many doc_ids, so the first two differ; empty names count as none.
    """
    named = lambda c: F.count_distinct(F.nullif(F.col(c).cast("string"), F.lit("")))
    return passages.groupBy(*by).agg(named("file_name").alias("documents"), named("doc_id").alias("fragments"), F.count("*").alias("passages"), F.coalesce(F.sum(F.length("excerpt")), F.lit(0)).cast("long").alias("chars"))


def size_batches(rows: DataFrame, group: str, order: list[str], size: str, most: int = 80_000, overhead: int = 160) -> DataFrame:
    """Numbers rows into consecutive batches of at most ``most`` characters with an overhead for each row.

    A batch begins where the one before is full, so each group is folded in
    order; one group is one file's or request's rows.
    """
    ship(rows.sparkSession)
    kept = rows.select(group, *order, size)

    def fold(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values(order, kind="stable")
        batch, used, out = 0, 0, []
        for n in parts[size]:
            if used and used + n + overhead > most:
                batch, used = batch + 1, 0
            used += n + overhead
            out.append(batch)
        return parts.assign(batch=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields) + ", batch long"
    return kept.groupBy(group).applyInPandas(fold, schema)


def verdict(facets_missing: Column, failed_batches: Column, events: Column) -> Column:
    """``partial`` if a facet has nothing, a batch failed or the record is thin."""
    return F.when((facets_missing > 0) | (failed_batches > 0) | (events < THIN), "partial").otherwise("complete")

