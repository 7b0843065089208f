"""From raw documents to packed sequences: quality, exact copies, near copies, secrets, packing.

Each stage takes what its predecessor kept, as written to Parquet and read
again, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import collapse_space, fresh, id_mod, row_key, table, without
from orrery.llm.exact_dedup import exact_groups
from orrery.llm.minhash import near_duplicates
from orrery.llm.packing import pack_documents
from orrery.llm.quality import fit, score
from orrery.llm.secret_scan import mask_secrets
from orrery.storage import stash

#: The score at and over which a document is kept.
QUALITY = 0.7
#: Near copies: percent of shared five-word shingles.
NEAR = 80

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    It learns from labelled rows that are not held out, as the query does.
    """
    held_out = F.coalesce(id_mod("doc_id", 4) == 2, F.lit(False))
    weights = fit(docs, table(spark, sf_dir, "labels"), train_on=~held_out)
    (quality,) = fresh(docs, "_quality")
    return score(docs, weights, quality).filter(F.col(quality) >= QUALITY).drop(quality)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the one with the smallest doc_id."""
    groups = stash(exact_groups(docs).withColumn("key", row_key(F.col("text_sha256"))), "pipeline-exact")
    gone = groups.filter("not kept")
    twice = stash(gone.filter("doc_id <=> keep_id").select("key").distinct(), "pipeline-twice")
    key = row_key(F.sha2(collapse_space(F.col("text")).cast("binary"), 256))
    return without(docs, key, gone.filter("not doc_id <=> keep_id").select("key").distinct(), twice)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest doc_id.

    Rows are told apart by id and text: where a class has several rows of its
    smallest id, the least key of id and text stays. Of a class without any id
    one row stays; texts without words all stay.
    """
    judged = stash(near_duplicates(docs, NEAR).select(F.col("row_key").alias("key"), "class", "kept"), "pipeline-near")
    kept = judged.filter("kept and class is not null")
    first = kept.groupBy("class").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = stash(first, "pipeline-several")
    others = kept.join(first, "class").filter("key <> first").select("key")
    gone = stash(judged.filter("not kept").select("key").unionByName(others).distinct(), "pipeline-gone")
    return without(docs, row_key(F.md5(F.coalesce("text", F.lit("")))), gone, first.select(F.col("first").alias("key")))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 2048 tokens."""
    return pack_documents(docs, 2048, memo=150_000, batch_bytes=1_000_000)  # the workers have served other stages before


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
