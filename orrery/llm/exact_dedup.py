"""Exact dedup: Golomb-coded fingerprint exchange, duplicate bitmaps, byte verification of suspects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import collapse_space, ready, sieve, sifted
from orrery.storage import discard, stash

FP_BITS = 48
#: Rows that one sending partition holds, and fingerprints that one owner decodes, about.
ROWS_PER_PART = 1_000_000
ROWS_PER_OWNER = 4_000_000
LEAST_PARTS, LEAST_OWNERS = 256, 16


def golomb_encode(values: np.ndarray, spread: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct integers below ``spread`` as a Golomb-Rice code of their gaps.

    Returns the number of low bits, the unary stream of the quotients and the
    fixed-width stream of the remainders; two streams decode without a loop.
    """
    n = len(values)
    if n == 0:
        return 0, b"", b""
    low = max(0, int(spread // n).bit_length() - 1)
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(0))
    high = gaps >> low
    unary = np.zeros(int(high.sum()) + n, dtype=np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    bits = ((gaps[:, None] >> np.arange(low, dtype=np.int64)) & 1).astype(np.uint8)
    return low, np.packbits(unary).tobytes(), np.packbits(bits.ravel()).tobytes()


def golomb_decode(n: int, low: int, unary: bytes, rest: bytes) -> np.ndarray:
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, dtype=np.uint8)))[:n]
    gaps = np.diff(ones, prepend=-1).astype(np.int64) - 1 << low
    if low:
        bits = np.unpackbits(np.frombuffer(rest, dtype=np.uint8), count=n * low).reshape(n, low)
        gaps += bits.astype(np.int64) @ (np.int64(1) << np.arange(low, dtype=np.int64))
    return np.cumsum(gaps)


def _send(owners: int):
    """For one partition's fingerprints: a coded message to each owner, with a bit for those seen twice here."""
    span = -(-(1 << FP_BITS) // owners)

    def run(part: pa.Table) -> pa.Table:
        values, counts = np.unique(part["fp"].to_numpy(), return_counts=True)
        edges = np.searchsorted(values, np.arange(owners + 1, dtype=np.int64) * span)
        out = {k: [] for k in ("part", "owner", "n", "low", "unary", "rest", "twice")}
        me = part["part"][0].as_py()
        for o in np.flatnonzero(np.diff(edges)):
            own, often = values[edges[o] : edges[o + 1]] - o * span, counts[edges[o] : edges[o + 1]] > 1
            low, unary, rest = golomb_encode(own, span)
            for k, v in zip(out, (me, int(o), len(own), low, unary, rest, np.packbits(often).tobytes()), strict=True):
                out[k].append(v)
        return pa.table(out, schema=MESSAGE)

    return run


MESSAGE = pa.schema([("part", pa.int32()), ("owner", pa.int32()), ("n", pa.int32()), ("low", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary()), ("twice", pa.binary())])
REPLY = pa.schema([("part", pa.int32()), ("owner", pa.int32()), ("n", pa.int32()), ("dup", pa.binary())])


def _answer(messages: pa.Table) -> pa.Table:
    """An owner decodes all messages of its range and replies to each with a bitmap of the duplicates."""
    rows = messages.to_pylist()
    sets = [golomb_decode(r["n"], r["low"], r["unary"], r["rest"]) for r in rows]
    twice = [np.unpackbits(np.frombuffer(r["twice"], dtype=np.uint8), count=r["n"]).astype(bool) for r in rows]
    every, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dup = counts > 1
    dup[where[np.concatenate(twice)]] = True
    flags = np.split(dup[where], np.cumsum([len(s) for s in sets])[:-1])
    return pa.table({"part": [r["part"] for r in rows], "owner": [r["owner"] for r in rows], "n": [r["n"] for r in rows], "dup": [np.packbits(f).tobytes() for f in flags]}, schema=REPLY)


def _mark(rows: pa.Table, replies: pa.Table) -> pa.Table:
    """A partition's rows with ``suspect``, read from the owners' bitmaps in the order it sent its fingerprints."""
    flags = np.zeros(0, dtype=bool)
    got = sorted(replies.to_pylist(), key=lambda r: r["owner"])
    if got:
        flags = np.concatenate([np.unpackbits(np.frombuffer(r["dup"], dtype=np.uint8), count=r["n"]).astype(bool) for r in got])
    if not rows.num_rows:
        return rows.append_column("suspect", pa.array([], pa.bool_()))
    _, where = np.unique(rows["fp"].to_numpy(), return_inverse=True)
    return rows.append_column("suspect", pa.array(flags[where]))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of equal texts over all rows of ``docs(doc_id, text)``.

    Texts are equal when the same after each run of ASCII white space becomes
    one space; null counts as empty. Of a group the row with the smallest doc_id
    stays; null ids come last, and of rows that repeat that id one stays.
    Other columns of the input are not looked at; an empty table gives an empty
    result.

    Partitions of fingerprints send sorted Golomb-coded hashes to owners of hash
    ranges, get bitmaps of the duplicates back, and only rows so marked have
    their texts shuffled: those are grouped by their bytes, after each task has
    merged its own copies, so that a text with a third of all rows arrives as
    one row a task.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256, row_no``; row_no
    is unique.
    """
    ready(docs.sparkSession)
    norm = collapse_space(F.col("text"))
    sha = F.sha2(norm.cast("binary"), 256)
    fp = F.conv(F.substring(sha, 1, FP_BITS // 4), 16, 10).cast("long")
    first = docs.select("doc_id", sha.alias("hex"), fp.alias("fp")).select("doc_id", F.unhex("hex").alias("sha"), "fp", F.monotonically_increasing_id().alias("row_no"))
    slim = stash(first, "exact-slim")
    n = slim.count()
    parts, owners = max(LEAST_PARTS, -(-n // ROWS_PER_PART)), max(LEAST_OWNERS, -(-n // ROWS_PER_OWNER))
    held = slim.withColumn("part", F.pmod(F.xxhash64("row_no"), F.lit(parts)).cast("int"))
    sent = held.select("part", "fp").groupBy("part").applyInArrow(_send(owners), "part int, owner int, n int, low int, unary binary, rest binary, twice binary")
    replies = sent.groupBy("owner").applyInArrow(_answer, "part int, owner int, n int, dup binary")
    marked = held.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_mark, "doc_id long, sha binary, fp long, row_no long, part int, suspect boolean")
    marked = stash(marked.select("doc_id", "sha", "fp", "row_no", "suspect"), "exact-marked")
    discard(slim)

    suspects = marked.filter("suspect")
    bitmap = sieve(suspects.select("fp"), "fp", suspects.count())
    texts = docs.select("doc_id", norm.alias("norm")).select("doc_id", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("hex"))
    texts = sifted(texts.withColumn("fp", F.conv(F.substring("hex", 1, FP_BITS // 4), 16, 10).cast("long")), "fp", bitmap)
    same = texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    same = same.filter("group_size > 1").select(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "keep_id", "group_size")
    same = stash(same, "exact-groups")

    # by hash and id together, so that a large group is spread by its ids
    least = same.select(F.col("sha").alias("same_sha"), "keep_id")
    holders = suspects.join(least, (F.col("sha") == F.col("same_sha")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stays = holders.groupBy("sha").agg(F.min("row_no").alias("stay_no"))
    verdict = stash(same.join(stays, "sha"), "exact-verdict")
    judged = suspects.join(verdict, "sha", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row_no") == F.col("stay_no"), F.lit(True)).alias("kept"),
        "sha",
        "row_no",
    )
    alone = marked.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", "row_no")
    out = alone.unionByName(judged)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "row_no")
