"""Embedding near-dedup: randomised-rotation binary codes, unbiased estimates with bounds, exact recomputation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import ready, whole_groups
from orrery.operators.components import connected_components
from orrery.storage import stash

#: Vectors at the limit may share no group of signs with at most this probability.
MISS = 1e-9
#: Half-width of the confidence interval in standard deviations of the estimate.
SIGMAS = 6.0
#: Vectors of a bucket that one task compares with as many others.
BLOCK = 512
#: Rows of buckets looked at together, pairs of them told apart at a time, and pairs estimated at a time.
ROWS, PAIRS, EXACT = 4096, 1 << 18, 1 << 12


def shape(n: int, limit: float) -> tuple[int, int]:
    """Bits of a group and number of groups for ``n`` vectors.

    A group has about log2(n) bits, so unrelated vectors rarely meet however
    many there are; vectors at the limit agree on a sign with probability
    1 - angle / pi, which gives the groups needed for MISS.
    """
    bits = max(16, math.ceil(math.log2(max(2, n))))
    agree = (1 - math.acos(limit) / math.pi) ** bits
    groups = math.ceil(math.log(MISS) / math.log1p(-agree)) if agree < 1 else 1
    return bits, -(-groups // 8) * 8


@lru_cache(maxsize=4)
def rotation(dim: int, code: int) -> np.ndarray:
    """The first ``dim`` columns of a random rotation of ``code`` dimensions: vectors count as padded with zeros."""
    q, r = np.linalg.qr(np.random.default_rng(97).standard_normal((max(code, dim), dim)))
    return (q * np.sign(np.diag(r)))[:code]


def encode(unit: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors, the signs of their rotated coordinates and the correction factor of each.

    The factor is the inner product of the rotated vector with its code as a
    unit vector; dividing an inner product with the code by it is unbiased.
    """
    turned = unit @ rotation(unit.shape[1], code).T
    return turned >= 0, np.abs(turned).sum(axis=1) / np.sqrt(code)


def estimate(with_code: np.ndarray, factor: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased inner products of coded vectors with rotated ones, and their half-widths.

    ``with_code`` holds the products of the signs of the one, as 1 and -1, with
    the rotated other.
    """
    return with_code / (np.sqrt(code) * factor), SIGMAS * np.sqrt(np.maximum(0.0, 1 - factor**2)) / (factor * np.sqrt(code - 1))


def _rows(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _codes(bits: int, groups: int):
    """Packed signs, correction factor and group words of each vector; vectors of one batch may differ in length."""
    powers = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            words = np.zeros((len(lists), groups), dtype=np.int64)
            short = np.uint64 if bits > 32 else np.uint32 if bits > 16 else np.uint16
            factor, code = np.zeros(len(lists)), np.zeros((len(lists), groups * bits // 8), dtype=np.uint8)
            for dim in {len(v) for v in lists}:
                at = [i for i, v in enumerate(lists) if len(v) == dim]
                signs, factor[at] = encode(_unit(np.array([lists[i] for i in at], dtype=np.float64)), groups * bits)
                words[at] = signs.reshape(len(at), groups, bits) @ powers
                code[at] = np.packbits(signs, axis=1)
            flat = pa.ListArray.from_arrays(np.arange(len(lists) + 1, dtype=np.int32) * groups, words.ravel())
            raw = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.record_batch([batch.column(0), pa.array(factor), raw(code), raw(words.astype(short)), flat], names=["node", "factor", "code", "words", "keys"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaling by the largest component first keeps tiny and huge ones from under- or overflowing."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _partners(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by block pair and side, each row's partners: the places [from, to).

    Within one block these are the rows after it; across two blocks, the rows
    of the other side, for rows of the first side.
    """
    n, side, at = rows.num_rows, rows["side"].to_numpy().astype(bool), np.arange(rows.num_rows)
    change = np.ones(n, dtype=bool)
    change[1:] = False
    for k in ("bucket", "left", "right"):
        c = rows[k].to_numpy()
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(change)
    group = np.cumsum(change) - 1
    end = np.concatenate([starts[1:], [n]])[group]
    first = starts[group] + np.bincount(group, ~side).astype(np.int64)[group]  # of the second side
    inside = rows["left"].to_numpy() == rows["right"].to_numpy()
    return np.where(inside, at + 1, first), np.where(side & ~inside, np.where(inside, at + 1, first), end)


def _pairs(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a row and a partner, about PAIRS at a time."""
    many = end - begin
    total = np.cumsum(many)
    at = 0
    while at < len(many):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        own = np.repeat(np.arange(at, stop), many[at:stop])
        yield own, np.arange(len(own)) - np.repeat(total[at:stop] - many[at:stop] - total[at] + many[at], many[at:stop]) + begin[own]
        at = stop


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places, the smallest place that the pairs connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(limit: float, bits: int, groups: int):
    """Counts of links, and edges that span them, of many blocks of buckets at a time.

    Of the pairs in a block, those that met in an earlier group of signs are
    left to it; of the others, estimates rule out what they can and the rest is
    recomputed.
    """
    code = groups * bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ("bucket", "left", "right"), ROWS):
            n, group = rows.num_rows, rows["grp"].to_numpy()
            words = np.frombuffer(b"".join(rows["words"].to_pylist()), dtype=np.uint64 if bits > 32 else np.uint32 if bits > 16 else np.uint16).reshape(n, groups)
            ids, many, factor = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["factor"].to_numpy()
            packed, vectors, dims, tag = rows["code"], rows["embedding"], rows["dim"].to_numpy(), rows["tag"].to_numpy()
            links, ends = np.zeros(n, dtype=np.int64), []
            for a, b in _pairs(*_partners(rows)):
                earlier = (tag[a] != tag[b]) | (dims[a] != dims[b])  # strangers whose buckets' names are equal by chance
                for g in range(groups):
                    live = np.flatnonzero(~earlier & (group[a] > g))
                    if not len(live):
                        break
                    earlier[live] = words[a[live], g] == words[b[live], g]
                a, b = a[~earlier], b[~earlier]
                for dim in np.unique(dims[a]):
                    p, q = a[dims[a] == dim], b[dims[a] == dim]
                    used, where = np.unique(np.concatenate([p, q]), return_inverse=True)
                    i, j = where[: len(p)], where[len(p) :]
                    unit = _unit(_rows(vectors.take(pa.array(used))))
                    good = _alike(unit, np.frombuffer(b"".join(packed.take(pa.array(used)).to_pylist()), dtype=np.uint8).reshape(len(used), -1), factor[used], i, j, code, limit)
                    p, q = p[good], q[good]
                    links += np.bincount(p, many[q], n).astype(np.int64) + np.bincount(q, many[p], n).astype(np.int64)
                    ends.append((p, q))
            a, b = (np.concatenate([e[k] for e in ends]) if ends else np.zeros(0, dtype=np.int64) for k in (0, 1))
            root = _least(n, a, b)
            found, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
            if len(found):
                node = pa.array(np.concatenate([ids[joined], ids[found]]))
                other = pa.array(np.concatenate([ids[root[joined]], ids[found]]), mask=np.arange(len(joined) + len(found)) >= len(joined))
                yield pa.record_batch([node, other, pa.array(np.concatenate([np.zeros(len(joined), np.int64), links[found]]))], names=["node", "other", "links"])

    return run


def _alike(unit: np.ndarray, packed: np.ndarray, factor: np.ndarray, i: np.ndarray, j: np.ndarray, code: int, limit: float) -> np.ndarray:
    """Which of the pairs ``i``, ``j`` of unit vectors are at or over the limit."""
    out = np.zeros(len(i), dtype=bool)
    turn = rotation(unit.shape[1], code).T.astype(np.float32)
    for k in range(0, len(i), EXACT):
        p, q = i[k : k + EXACT], j[k : k + EXACT]
        a, p = np.unique(p, return_inverse=True)
        b, q = np.unique(q, return_inverse=True)
        signs = np.where(np.unpackbits(packed[a], axis=1, count=code).astype(bool), np.float32(1), np.float32(-1))
        turned = unit[b].astype(np.float32) @ turn
        value, width = estimate(np.einsum("ij,ij->i", signs[p], turned[q]), factor[a][p], code)
        maybe = np.flatnonzero(value + width >= limit)
        exact = np.einsum("ij,ij->i", unit[a[p[maybe]]], unit[b[q[maybe]]])
        out[k + maybe[exact >= limit]] = True
    return out


def near_vectors(vectors: DataFrame, limit: float = 0.98) -> DataFrame:
    """Links and classes of near-equal vectors among all rows of ``vectors(vec_id, embedding, label)``.

    Two vectors of one non-null label and one length are linked when their
    cosine in double precision is ``limit`` or more. Vectors equal component by
    component under one label collapse into one node first. Each node gets the
    signs of a random rotation as its code; nodes of a label that share a group
    of signs meet in a bucket, cut into blocks so that no task holds more than
    two of them. There the codes' unbiased estimates of the inner products, with
    their correction factors and confidence bounds, rule out pairs, and all
    others are recomputed exactly. A pair counts in the first bucket that holds
    both. A link is missed if its vectors share no group or the estimate is off
    by SIGMAS deviations (each about 1e-9).

    Null, empty or zero vectors, vectors with null or non-finite components and
    rows with a null label link with nothing. Rows that repeat a vec_id count as
    vectors of their own. A null vec_id counts as a vector; it is never the
    smallest of a class that has another, and kept where it is in none. Other columns are not looked at; an
    empty table gives an empty result.

    Returns ``vec_id, n_links, component_id, kept``.
    """
    ready(vectors.sparkSession)
    vec = F.col("embedding")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
    sound = F.coalesce(F.col("label").isNotNull() & (F.size(vec) > 0) & fine, F.lit(False))
    named = F.concat_ws(",", F.col("label").cast("string"), F.transform(vec, lambda x: (x + F.lit(0).cast("float")).cast("string")))
    rows = vectors.select("vec_id", "label", "embedding", F.when(sound, F.sha2(named.cast("binary"), 256)).alias("same"))
    rows = stash(rows.withColumn("node", F.when(F.col("same").isNotNull(), F.xxhash64("same"))), "vec-rows")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = stash(nodes, "vec-nodes")
    bits, groups = shape(nodes.count(), limit)
    coded = nodes.select("node", "embedding").mapInArrow(_codes(bits, groups), "node long, factor double, code binary, words binary, keys array<long>")
    coded = stash(coded, "vec-codes")

    place = nodes.select("node", "label", F.size("embedding").alias("dim"))
    slim = coded.join(place, "node").select("node", "label", "dim", F.posexplode("keys").alias("grp", "word"))
    slim = slim.select("node", "grp", F.xxhash64("label", "dim", "grp", "word").alias("bucket"))
    full = slim.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    held = stash(slim.join(full, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")), "vec-buckets")
    # block i meets each block j >= i once
    left = held.select("node", "grp", "bucket", F.col("block").alias("left"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("right"), F.lit(False).alias("side"))
    right = held.filter("block > 0").select("node", "grp", "bucket", F.explode(F.expr("sequence(0L, block - 1)")).alias("left"), F.col("block").alias("right"), F.lit(True).alias("side"))
    keys = ("bucket", "left", "right")
    whole = nodes.select("node", "copies", "embedding", F.size("embedding").alias("dim"), F.xxhash64(F.lit(1), "label").alias("tag")).join(coded.drop("keys"), "node")
    met = left.unionByName(right).join(whole, "node").repartition(*keys).sortWithinPartitions(*keys, "side")
    found = stash(met.mapInArrow(_compare(limit, bits, groups), "node long, other long, links long"), "vec-links")

    label = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")), "vec-components")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = nodes.select("node", "copies", "least_id").join(links, "node", "left").join(label, "node", "left")
    facts = stash(facts.select("node", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "vec-facts")
    least = facts.groupBy("component").agg(F.min("least_id").alias("component_id"))
    facts = stash(facts.join(least, "component").select("node", "n_links", "component_id"), "vec-classes")
    out = rows.select("vec_id", "node").join(facts, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
