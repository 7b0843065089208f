"""Near-duplicate documents: b-bit MinHash candidates, exact links, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import grouped_rows, ready, row_key, settled, sieve, sifted
from orrery.llm.shingles import mix, shared, shingle_set
from orrery.operators.components import connected_components
from orrery.storage import discard, stash

#: A pair at a Jaccard similarity of 0.80 shares no band with probability (1 - 0.80 ** 6) ** 48 = 5e-7; 1.4e-10 at 0.85.
BANDS, ROWS = 48, 6
HASHES = BANDS * ROWS
#: Minima whose low bits the signature keeps, and how many bits of each, one bit plane a bit.
KEPT, BITS = 256, 2
WORDS = KEPT // 64
#: An estimate may fall this many standard errors short before a pair is given up.
SIGMAS = 5.0
#: Rows of a bucket that one task compares with as many others.
BLOCK = 256

_rng = np.random.default_rng(11)
_MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def least_matches(similarity: float) -> int:
    """The number of equal b-bit minima below which a pair cannot well be as similar as asked.

    Two minima agree when their elements are the same or, for different
    elements, by chance in 1 of 2**b cases; the count of agreements so has the
    mean (c + (1 - c) J) of all hashes with c = 2**-b.
    """
    chance = 2.0**-BITS
    p = chance + (1 - chance) * similarity
    return int(np.floor(KEPT * p - SIGMAS * np.sqrt(KEPT * p * (1 - p))))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits of the minima (BITS planes of WORDS 64-bit words) and one hash for each band of whole minima."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 1024):
            np.minimum(least, (x[i : i + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
        low = (least[:KEPT] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        planes = np.concatenate([np.packbits((low >> np.uint32(b)).astype(np.uint8) & 1) for b in range(BITS)])
        bands = mix((least.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return planes.view(np.int64), bands.view(np.int64)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        count, key, sig, bands = [], [], [], []
        for text in texts:
            s = shingle_set(text.as_py())
            planes, band = signature(s)
            count.append(len(s))
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sig.append(planes)
            bands.append(band)
        n = batch.num_rows
        lists = lambda rows, width: pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, np.concatenate(rows) if rows else np.zeros(0, np.int64))
        columns = [*batch.columns[:2], pa.array(count, pa.int64()), pa.array(key, pa.binary()), lists(sig, BITS * WORDS), lists(bands, BANDS)]
        yield pa.record_batch(columns, names=["doc_id", "row_key", "n_shingles", "set_key", "sig", "bands"])


def matches(a: str, b: str) -> Column:
    """Equal b-bit minima of two packed signatures, by bit counts."""
    planes = [[p * WORDS + w for p in range(BITS)] for w in range(WORDS)]
    unequal = [F.expr("bit_count(" + " | ".join(f"({a}[{i}] ^ {b}[{i}])" for i in word) + ")") for word in planes]
    return F.lit(KEPT) - sum(unequal[1:], unequal[0])


def _alike(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def _confirm(percent: int):
    """Keeps the pairs whose full shingle sets are similar enough; rows come by leader, whose set is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, None
        for batch in batches:
            keep = []
            lead, texts, own = batch.column(0), batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for i in range(batch.num_rows):
                if (a := lead[i].as_py()) != held or mine is None:
                    held, mine = a, shingle_set(texts[i].as_py())
                other = shingle_set(own[i].as_py())
                keep.append(_alike(shared(mine, other), len(mine), len(other), percent))
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch([out.column(0), out.column(1)], names=["a", "b"])

    return run


def _near(sig_m: np.ndarray, comp_m: np.ndarray, sig_r: np.ndarray, comp_r: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of a block are of different components and, by bit counts, may be similar enough."""
    unequal = np.zeros((len(sig_r), len(sig_m)), dtype=np.uint16)
    for w in range(WORDS):
        x = np.zeros(unequal.shape, dtype=np.int64)
        for p in range(BITS):
            x |= sig_r[:, None, p * WORDS + w] ^ sig_m[None, :, p * WORDS + w]
        unequal += np.bitwise_count(x.view(np.uint64))
    return (KEPT - unequal.astype(np.int32) >= least) & (comp_r[:, None] != comp_m[None, :])


def _block(rows: pa.Table) -> tuple[np.ndarray, ...]:
    side = rows["side"].to_numpy().astype(bool)
    sig = rows["sig"].combine_chunks().flatten().to_numpy().reshape(-1, BITS * WORDS)
    return side, sig, rows["comp"].to_numpy(), rows["id"].to_numpy()


def _involved(least: int):
    """Of each block, the rows that take part in a pair worth an exact look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped_rows(batches, ("bkey", "mblk", "rblk")):
            side, sig, comp, _ = _block(rows)
            near = _near(sig[~side], comp[~side], sig[side], comp[side], least)
            keep = np.zeros(len(side), dtype=bool)
            keep[np.flatnonzero(side)] = near.any(axis=1)
            keep[np.flatnonzero(~side)] = near.any(axis=0)
            if keep.any():
                yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _across(least: int, percent: int):
    """Exact links across components within a block, as a spanning set of edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped_rows(batches, ("bkey", "mblk", "rblk")):
            side, sig, comp, ids = _block(rows)
            texts = rows["text"].cast(pa.binary()).to_pylist()
            m, r = np.flatnonzero(~side), np.flatnonzero(side)
            near = _near(sig[m], comp[m], sig[r], comp[r], least)
            sets = {int(i): shingle_set(texts[i]) for i in np.flatnonzero(np.bincount(np.concatenate([m[near.any(axis=0)], r[near.any(axis=1)]]), minlength=len(side)))}
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            edges = []
            for j, row in enumerate(near):
                for i in np.flatnonzero(row):
                    p, q = int(r[j]), int(m[i])
                    a, b = find(int(comp[p])), find(int(comp[q]))
                    if a != b and _alike(shared(sets[p], sets[q]), len(sets[p]), len(sets[q]), percent):
                        root[a] = b
                        edges.append((int(ids[q]), int(ids[p])))
            if edges:
                yield pa.record_batch([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Classes of near copies among all rows of ``docs(doc_id, text)``.

    A row's set holds the distinct shingles of five words of its text (A-Z
    lower-cased, words are runs of anything but ASCII white space; fewer words
    are one shingle). Rows are linked where 100 * intersection >= percent *
    union of the full sets, and classes are the connected components of these
    links. A node is a distinct set, named by the number of one of its rows, so
    a doc_id that comes with several texts is a node for each.

    1. Every text gets a b-bit signature and band hashes; equal sets collapse.
    2. Each member of a band's bucket is a candidate of the bucket's smallest
       node; packed signatures pick each node's best such leader and the pair
       is confirmed on full sets. That is linear in a bucket's size.
    3. In buckets that still hold several components, rows outside the largest
       one meet all rows block by block: bit counts find the pairs across
       components that may be similar, full sets decide. A bucket of one
       component, as large as it may be, is not looked at again.

    A pair that reaches the limit is missed only if it shares no band or its
    estimate is off by SIGMAS standard errors, each below 1e-6.

    Null or empty texts and texts without words link with nothing; their
    ``class`` is null. ``component_id`` is the smallest doc_id of the class; rows
    without a doc_id link like others but never name a class that has an id, and
    are kept only where no row of the class has one. Rows that repeat an id and
    its text share one verdict. Other columns are not looked at; an empty table
    gives an empty result.

    Returns ``doc_id, n_shingles, component_id, kept, row_key, class``: the
    last two name the row (id and text) and its class.
    """
    ready(docs.sparkSession)
    least = least_matches(percent / 100)
    named = docs.select("doc_id", row_key(F.md5(F.coalesce("text", F.lit("")))).alias("row_key"), "text")
    prints = named.mapInArrow(settled(_prints), "doc_id long, row_key string, n_shingles long, set_key binary, sig array<long>, bands array<long>")
    prints = stash(prints.withColumn("node", F.monotonically_increasing_id()), "near-prints")
    sets = prints.filter("n_shingles > 0").groupBy("set_key").agg(F.min("node").alias("node"), F.min("doc_id").alias("least_id"))
    sets = stash(sets, "near-sets")
    one = stash(prints.select("node", "row_key", "sig", "bands").join(sets.select("node"), "node", "left_semi"), "near-nodes")
    signs = one.select(F.col("node").alias("id"), "sig")

    bucket = one.select(F.col("node").alias("id"), F.explode("bands").alias("bkey"))
    lead = bucket.groupBy("bkey").agg(F.min("id").alias("leader"), F.count("*").alias("size")).filter("size > 1").drop("size")
    member = stash(bucket.join(lead.repartition("bkey"), "bkey"), "near-members")
    pairs = member.filter("id <> leader").select("id", "leader").distinct()
    lead_signs = signs.select(F.col("id").alias("leader"), F.col("sig").alias("lead_sig"))
    scored = pairs.join(signs, "id").join(lead_signs, "leader").withColumn("same", matches("sig", "lead_sig")).filter(F.col("same") >= least)
    best = scored.groupBy("id").agg(F.max(F.struct("same", (-F.col("leader")).alias("neg"))).alias("top")).select("id", (-F.col("top.neg")).alias("leader"))
    best = stash(best, "near-best")

    def texts_of(ids: DataFrame) -> DataFrame:
        """Texts of nodes, read by the key of the row that stands for each."""
        keys = stash(one.select(F.col("node").alias("id"), "row_key").join(ids, "id", "left_semi"), "near-keys")
        found = sifted(named.select("row_key", "text"), "row_key", sieve(keys, "row_key", keys.count()))
        return found.groupBy("row_key").agg(F.first("text").alias("text")).join(keys, "row_key").select("id", "text")

    wanted = best.select("id").unionByName(best.select(F.col("leader").alias("id"))).distinct()
    texts = stash(texts_of(wanted), "near-texts")
    paired = best.join(texts.select("id", F.col("text").alias("own")), "id")
    paired = paired.join(texts.select(F.col("id").alias("leader"), "text"), "leader").select("leader", "id", "text", "own")
    star = stash(paired.mapInArrow(settled(_confirm(percent)), "a long, b long"), "near-star")
    discard(texts)

    label = connected_components(star, "near-first")
    member = member.select("bkey", "id").join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    share = member.groupBy("bkey", "comp").agg(F.count("*").alias("n"))
    mixed = share.groupBy("bkey").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("comps")).filter("comps > 1")
    mixed = mixed.select("bkey", F.col("main.comp").alias("main"), F.ceil(F.col("size") / BLOCK).alias("nm"), F.ceil((F.col("size") - F.col("main.n")) / BLOCK).alias("nr"))
    inner = member.join(mixed.repartition("bkey"), "bkey").join(signs, "id").withColumn("h", F.xxhash64("id"))
    every = inner.select("bkey", "id", "sig", "comp", F.pmod("h", "nm").alias("mblk"), F.explode(F.expr("sequence(0L, nr - 1)")).alias("rblk"), F.lit(False).alias("side"))
    rest = inner.filter("comp <> main").select("bkey", "id", "sig", "comp", F.explode(F.expr("sequence(0L, nm - 1)")).alias("mblk"), F.pmod("h", "nr").alias("rblk"), F.lit(True).alias("side"))
    keys = ("bkey", "mblk", "rblk")
    blocks = every.unionByName(rest).repartition(*keys).sortWithinPartitions(*keys)
    doubt = stash(blocks.mapInArrow(settled(_involved(least)), "bkey long, id long, sig array<long>, comp long, mblk long, rblk long, side boolean"), "near-doubt")
    held = doubt.join(texts_of(doubt.select("id").distinct()), "id").repartition(*keys).sortWithinPartitions(*keys)
    cross = stash(held.mapInArrow(settled(_across(least, percent)), "a long, b long"), "near-cross")

    label = connected_components(star.unionByName(cross), "near-last")
    classes = stash(sets.join(label, "node", "left").select("set_key", "least_id", F.coalesce("component", "node").alias("class")), "near-labels")
    named_by = classes.groupBy("class").agg(F.min("least_id").alias("component_id"))
    classes = stash(classes.join(named_by, "class").select("set_key", "class", "component_id"), "near-classes")  # so that the join below has no aggregate in it and a hot set can be split
    out = prints.select("doc_id", "row_key", "n_shingles", "set_key").join(classes, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "row_key", "class")
