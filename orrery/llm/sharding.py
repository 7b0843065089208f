"""Sharding: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import gapless_rank
from orrery.storage import stash

#: Keys are 60-bit fingerprints of the text, so groups have an even, total order.
KEY_BITS = 60
#: Cells that one round may return to the driver, whatever the corpus.
CELLS = 1 << 14


def _tight(starts: np.ndarray, ends: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Greedy cuts when every cell is atomic: the index of the first cell after each shard."""
    cuts, at = [], 0
    for _ in range(shards):
        begun = starts[at] if at < len(starts) else ends[-1]
        at = int(np.searchsorted(ends, begun + capacity, side="right"))
        cuts.append(at)
    return cuts


def _loose(starts: np.ndarray, ends: np.ndarray, atomic: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Greedy positions in bytes when a cell of several groups may be cut anywhere: no true greedy gets further."""
    out, at = [], 0
    for _ in range(shards):
        goal = at + capacity
        i = int(np.searchsorted(ends, goal, side="right"))
        if i < len(ends) and atomic[i]:
            goal = int(starts[i])
        at = min(max(at, goal), int(ends[-1]))
        out.append(at)
    return out


def _least(low: int, high: int, feasible) -> int:
    """The smallest feasible capacity in [low, high], by bisection; ``high`` is feasible."""
    while low < high:
        mid = (low + high) // 2
        if feasible(mid):
            high = mid
        else:
            low = mid + 1
    return low


def _even(starts: np.ndarray, ends: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Cuts under a feasible capacity, each as near as it can be to an equal share of what is left.

    The plain greedy fills every shard but the last, which then runs short.
    """
    edges = np.append(starts, ends[-1])
    last = [len(starts)]  # last[k]: the first cell from which k shards can take the rest
    for _ in range(shards):
        last.append(int(np.searchsorted(edges, edges[last[-1]] - capacity, side="left")))
    cuts, at = [], 0
    for left in range(shards, 1, -1):
        goal = edges[at] + (edges[-1] - edges[at]) // left
        low, high = max(at, last[left - 1]), int(np.searchsorted(ends, edges[at] + capacity, side="right"))
        i = int(np.searchsorted(edges, goal))
        i -= int(i > 0 and goal - edges[i - 1] < edges[i] - goal)
        at = min(max(i, low), high)
        cuts.append(at)
    return cuts


def minimax_cuts(rows: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, list[int], int]:
    """The least capacity, the key at which each shard but the first begins, and the number of rows.

    ``rows`` has ``key`` (KEY_BITS bits; one value is one atomic group) and
    ``size``. The order of the groups is the order of their keys. The search is
    exact and needs no list of groups: the key range is held as cells with their
    sums. Taking cells as divisible or as atomic bounds the answer and every cut
    from both sides; only cells between the bounds are divided further, so a few
    rounds of at most ``cells`` rows each reach single groups at every place
    where a cut can fall.
    """
    depth = cells.bit_length() - 1
    total_rows = 0
    known: list[tuple[int, int, bool, int]] = []  # first key, bytes, atomic, depth
    open_cells: list[int] | None = None
    known_depth = 0
    while True:
        cell = F.shiftright("key", KEY_BITS - depth).alias("cell")
        part = rows.select("key", "size", cell)
        if open_cells is not None:
            spark = rows.sparkSession
            wanted = spark.createDataFrame([(c,) for c in open_cells], "parent long")
            part = part.withColumn("parent", F.shiftright("key", KEY_BITS - known_depth)).join(F.broadcast(wanted), "parent", "left_semi")
        got = part.groupBy("cell").agg(F.sum("size"), F.min("key"), F.max("key"), F.count("*")).collect()
        if open_cells is None:
            total_rows = sum(r[4] for r in got)
        else:
            gone = {c << (KEY_BITS - known_depth) for c in open_cells}
            known = [k for k in known if not (k[0] in gone and k[3] == known_depth)]
        known += [(r[0] << (KEY_BITS - depth), r[1], r[2] == r[3] or depth == KEY_BITS, depth) for r in got]
        known.sort()
        if not known:
            return 0, [1 << KEY_BITS] * (shards - 1), 0
        sizes = np.array([k[1] for k in known], dtype=np.int64)
        atomic = np.array([k[2] for k in known])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        total = int(ends[-1])
        floor = max(-(-total // shards), int(sizes[atomic].max(initial=0)))
        low = _least(floor, total, lambda c: _loose(starts, ends, atomic, shards, c)[-1] >= total)
        high = _least(low, total, lambda c: _tight(starts, ends, shards, c)[-1] >= len(known))
        near = _tight(starts, ends, shards, low)[:-1]
        far = _loose(starts, ends, atomic, shards, high)[:-1]
        doubt = np.zeros(len(known), dtype=bool)
        for first, last in zip(near, far, strict=True):
            begin = int(starts[first]) if first < len(known) else total
            doubt |= ~atomic & (ends > begin) & (starts <= last)
        if not doubt.any():
            cuts = _even(starts, ends, shards, high)
            return high, [known[i][0] if i < len(known) else 1 << KEY_BITS for i in cuts], total_rows
        # the shallowest doubtful level is divided; deeper ones wait for their own round
        level = min(known[i][3] for i in np.flatnonzero(doubt))
        chosen = [i for i in np.flatnonzero(doubt) if known[i][3] == level]
        open_cells = [known[i][0] >> (KEY_BITS - level) for i in chosen]
        known_depth = level
        depth = min(KEY_BITS, level + max(1, (cells // len(chosen)).bit_length() - 1))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Deals all rows of ``docs(doc_id, text)`` into ``shards`` shards of near equal bytes.

    A row's size is the UTF-8 length of its text plus 1. Rows with equal texts
    are one atomic group and stay together; groups stand in the order of a
    60-bit fingerprint of the text (two texts that share one travel together),
    and each shard is a contiguous run of them whose largest byte sum is the
    smallest possible.

    Null text: size 1, grouped with the empty text. Null or repeated doc_id: kept,
    each row gets its own slot. Other columns of the input are not looked at.
    An empty table gives an empty result; with fewer groups than shards some
    shards stay empty. A group larger than a shard's share has a shard to itself
    as far as the order allows.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    """
    text = F.coalesce("text", F.lit(""))
    base = stash(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).alias("key"),
        ),
        "shard-base",
    )
    _, cuts, n = minimax_cuts(base, shards)
    shard = sum((F.col("key") >= F.lit(c)).cast("int") for c in cuts) if cuts else F.lit(0)
    dealt = base.withColumn("shard", shard.cast("int"))
    out = gapless_rank(dealt, ["shard"], F.xxhash64("doc_id", "key"), [F.col("doc_id"), F.col("key")], n, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
