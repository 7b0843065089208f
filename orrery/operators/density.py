"""Density clusters of vectors with noise: neighbour graph, mutual reachability, components by level, excess of mass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.components import connected_components
from orrery.operators.retrieval import cosine, small
from orrery.session import ship
from orrery.storage import discard, stash

#: Cosine distances at which components are taken, from fine to coarse; the last is the coarsest at which vectors still belong together.
LEVELS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.45)
#: Fewest vectors of a cluster, the neighbour whose distance makes a vector's core distance, and fewest vectors to cluster at all.
FEWEST, SAMPLES, LEAST = 3, 2, 5
# Fixed value: the least cosine with an old centre to keep its id.
KEEP_ID = 0.6
#: Orders of random sign codes in which neighbours are sought, vectors compared with one another at a time, and neighbours kept.
ORDERS, BLOCK, NEAR = 8, 1024, 16
#: Rows of a range of codes.
RANGE = 100_000


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of each length, with their places."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, flat[(ends[at] - n)[:, None] + np.arange(n)]


def neighbours(units: DataFrame, orders: int = ORDERS, block: int = BLOCK, near: int = NEAR) -> DataFrame:
    """``a, b, d``: for each vector of ``units(node, unit)`` its nearest others by cosine distance, at most ``near``.

    Vectors are sorted by a code of 64 random signs, and each is compared with
    those of its length in its block of ``block`` rows, blocks overlapping by half; neighbours
    that one order parts meet in another. So work is n times block times orders,
    however the vectors lie, and no group grows. Up to ``block`` vectors the
    neighbours are exact; beyond, a true one is missed at times (README).
    """
    ship(units.sparkSession)
    ranges = max(1, -(-units.count() // RANGE))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())])

    def coded(order: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                signs = np.zeros((batch.num_rows, 64), dtype=bool)
                for at, x in _matrices(batch.column(1)):
                    signs[at] = x @ np.random.default_rng(order).standard_normal((x.shape[1], 64)) > 0
                yield pa.record_batch([*batch.columns, pa.array([r.tobytes() for r in np.packbits(signs, axis=1)], pa.binary())], names=["node", "unit", "code"])

        return run

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        every = rows["node"].to_numpy()
        for at, x in _matrices(rows["unit"].combine_chunks()):
            d = np.maximum(1 - x @ x.T, 0.0)
            np.fill_diagonal(d, np.inf)
            ids, k = every[at], min(near, len(at) - 1)
            best = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), dtype=int)
            row = np.repeat(np.arange(len(ids)), k)
            yield pa.record_batch([ids[row], ids[best.ravel()], d[row, best.ravel()]], schema=schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = None, False
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            fresh |= batch.num_rows > 0
            while held.num_rows >= block:
                yield from compared(held.slice(0, block))
                held, fresh = held.slice(block // 2), held.num_rows > block
        if held is not None and held.num_rows and fresh:
            yield from compared(held)

    found = None
    for order in range(orders):
        dealt = units.mapInArrow(coded(order), "node long, unit array<double>, code binary").repartitionByRange(ranges, "code", "node").sortWithinPartitions("code", "node")
        pairs = dealt.select("node", "unit").mapInArrow(blocks, "a long, b long, d double")
        found = pairs if found is None else found.unionByName(pairs)
    # a pair's distance differs in its last bits from block to block, so a neighbour is told by its node and counts once
    once = found.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"))
    nearest = F.slice(F.array_sort(F.collect_list(F.struct("d", "b"))), 1, near)
    return once.groupBy("a").agg(nearest.alias("near")).select("a", F.explode("near").alias("n")).select("a", "n.b", "n.d")


def reachability(nodes: DataFrame, found: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``a, b, d``: neighbours by mutual reachability, the greatest of their distance and both core distances.

    A core distance is that to the ``samples``-th other vector, where a node of
    ``nodes(node, weight)`` stands for ``weight`` equal ones; nodes with fewer
    others around them have no core distance and no edges.
    """
    ordered = Window.partitionBy("a").orderBy("d", "b")
    weighed = found.join(nodes.select(F.col("node").alias("b"), "weight"), "b").withColumn("others", F.sum("weight").over(ordered))
    own = nodes.select(F.col("node").alias("a"), (F.col("weight") - 1).alias("copies"))
    far = weighed.join(own, "a").filter(F.col("others") + F.col("copies") >= samples).groupBy("a").agg(F.min("d").alias("core"))
    core = own.join(far, "a", "left").select("a", F.when(F.col("copies") >= samples, 0.0).otherwise(F.col("core")).alias("core")).filter("core is not null")
    core = stash(core, "density-core")
    other = core.select(F.col("a").alias("b"), F.col("core").alias("core_b"))
    met = found.join(core, "a").join(other, "b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("d", "core", "core_b").alias("d")).groupBy("a", "b").agg(F.min("d").alias("d"))


def _by_level(nodes: DataFrame, edges: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """``node, level, part``: each node's component at each level; components of one level are the nodes of the next."""
    part = stash(nodes.select("node", F.col("node").alias("part")), "density-part")
    out = None
    for level, most in enumerate(levels):
        least = levels[level - 1] if level else -1.0
        name = lambda side, p=part: p.select(F.col("node").alias(side), F.col("part").alias(f"part_{side}"))
        new = edges.filter((F.col("d") > least) & (F.col("d") <= most)).join(name("a"), "a").join(name("b"), "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
        moved = connected_components(new, "density-level").select(F.col("node").alias("part"), "component")
        part = stash(part.join(moved, "part", "left").select("node", F.coalesce("component", "part").alias("part")), "density-part")
        at = part.select("node", F.lit(level).alias("level"), "part")
        out = at if out is None else out.unionByName(at)
    return out


def density_clusters(vectors: DataFrame, levels: tuple[float, ...] = LEVELS, fewest: int = FEWEST, samples: int = SAMPLES, **search: int) -> DataFrame:
    """``vec_id, cluster``: the density cluster of each row of ``vectors(vec_id, embedding)``, named by its smallest vec_id; noise has none.

    Components of the graph of mutual reachability are taken at each of
    ``levels``. One of at least ``fewest`` vectors goes on as the same cluster
    while the level grows, until it meets another one. It weighs its vectors
    times the stretch of 1 / distance that it lives through; where two meet, the
    whole is kept if it weighs at least as much as the best of its parts, and
    else the parts. Vectors in no cluster kept are noise, as are null and zero
    vectors, those with a null or non-finite part, and all if fewer than LEAST
    can be clustered. Equal vectors count as often as they occur; rows without
    vec_id are left out, a repeated one keeps its first vector in order.

    Neighbours come of sorted orders (:func:`neighbours`) and components of
    joins, so no group of vectors is held in one task.
    """
    rows = vectors.filter("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    sound = rows.filter(F.coalesce(F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0), F.lit(False))).select("vec_id", numbers.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    named = stash(sound.withColumn("unit", F.transform("v", lambda x: x / length)).select("vec_id", "unit", F.xxhash64("unit").alias("h")), "density-units")
    nodes = stash(named.groupBy("h", "unit").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "density-nodes")
    if named.count() < LEAST:
        return rows.select("vec_id", F.lit(None).cast("long").alias("cluster"))
    found = stash(neighbours(nodes.select("node", "unit"), **search), "density-near")
    edges = stash(reachability(nodes.select("node", "weight"), found, samples), "density-edges")
    parts = stash(_by_level(nodes, edges, levels), "density-levels")
    heavy = parts.join(nodes.select("node", "weight"), "node").groupBy("level", "part").agg(F.sum("weight").alias("weight"), F.min("node").alias("least")).filter(F.col("weight") >= fewest)
    heavy = stash(heavy, "density-parts")
    chosen, own = None, None
    for level, far in enumerate(levels):
        mass = F.col("weight") * (1 / far - (1 / levels[level + 1] if level + 1 < len(levels) else 0.0))
        here = heavy.filter(F.col("level") == level).select("part", "least", mass.alias("mass"))
        if own is None:
            here = here.withColumns({"own": F.col("mass"), "below": F.lit(0.0)})
        else:  # a part's finer parts are those whose smallest node it holds
            up = parts.filter(F.col("level") == level).select(F.col("node").alias("least"), F.col("part").alias("parent"))
            finer = own.join(up, "least").groupBy("parent").agg(F.count("*").alias("n"), F.sum("own").alias("one"), F.sum("below").alias("under"), F.sum(F.greatest("own", "below")).alias("best"))
            here = here.join(finer, here["part"] == finer["parent"], "left")
            single = F.col("n") == 1
            here = here.select("part", "least", (F.col("mass") + F.when(single, F.col("one")).otherwise(0.0)).alias("own"), F.when(single, F.col("under")).otherwise(F.coalesce("best", F.lit(0.0))).alias("below"))
        own = stash(here.select("part", "least", "own", "below"), "density-mass")
        kept = own.filter("own >= below").select(F.lit(level).alias("level"), "part", "least")
        chosen = kept if chosen is None else chosen.unionByName(kept)
    placed = parts.join(chosen, ["level", "part"]).groupBy("node").agg(F.max_by("least", "level").alias("cluster"))
    of = named.join(nodes.select("h", "unit", "node"), ["h", "unit"]).join(placed, "node").select("vec_id", "cluster")
    discard(found)
    return rows.select("vec_id").join(of, "vec_id", "left")


def kept_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new_cluster, cluster``: a new centre takes the id of the old one nearest to it at KEEP_ID or more; both are small tables of ``cluster, centroid``."""
    a, b = old.select(F.col("cluster").alias("old"), F.col("centroid").alias("oc")), new.select(F.col("cluster").alias("new_cluster"), "centroid")
    met = b.join(small(a)).withColumn("c", cosine(F.col("oc"), F.col("centroid"))).filter(F.col("c") >= KEEP_ID)
    best = met.groupBy("new_cluster").agg(F.max_by("old", "c").alias("cluster"))
    return b.select("new_cluster").join(best, "new_cluster", "left")
