"""Prefix trie of conversations: each family builds a small trie, and only combined family nodes meet for the whole one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import ready, settled
from orrery.storage import discard, stash

#: Conversations whose ids agree but for this many last values are a family.
FAMILY = 100
#: A conversation begins with fewer turns of its family's base than this.
HEADS = 6
#: Turns of a conversation that one task takes at most, and rows of a range of turns.
SEGMENT, RANGE_ROWS = 512, 100_000
#: Ids whose list is one string.
LISTED = 10_000

_NODES = "base long, seg long, key binary, parent binary, depth long, chars long, n long, least long, ends array<long>"
_TAILS = "base long, seg long, conv long, key binary"
_MASK = (1 << 128) - 1


def turns(conversations: DataFrame) -> DataFrame:
    """``conv, pos, size, turn_hash, chars``: each turn's place from 0 in its conversation, and that conversation's turns.

    Turns are ordered by number, null first; those of one number by the hash of
    role and text. Rows are dealt by ranges of that order, so a conversation
    with any share of all rows is numbered by many tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("turn_hash"), F.length(text).cast("long").alias("chars"))
    ranges = max(4, -(-rows.count() // RANGE_ROWS))
    numbered = rows.withColumn("_no", F.monotonically_increasing_id())  # parts what is equal in all else
    dealt = stash(numbered.repartitionByRange(ranges, "conv", F.col("turn").asc_nulls_first(), "turn_hash", "_no").withColumn("part", F.spark_partition_id()), "trie-turns")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("conv", "part").count().select("conv", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"), F.sum("count").over(Window.partitionBy("conv")).alias("size"))
    inner = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "turn_hash", "_no"))
    return dealt.withColumn("inner", inner).join(first, ["conv", "part"]).select("conv", (F.col("first") + F.col("inner") - 1).alias("pos"), "size", "turn_hash", "chars")


def _base(conv: str = "conv") -> Column:
    return F.col(conv) - F.col(conv) % FAMILY


def _taken(conv: str = "conv") -> Column:
    """How many turns of its base a conversation begins with, at most."""
    return F.crc32(F.col(conv).cast("string").cast("binary")) % HEADS


def _tagged(turn_hash: bytes, depth: int) -> int:
    """A turn at its depth as a number of 120 bits; a node is the sum of those on its way from the root."""
    return int.from_bytes(hashlib.sha256(turn_hash + depth.to_bytes(8, "big")).digest()[:15], "big")


def _sums(turn_hash: Column, depth: Column) -> list[Column]:
    """The same number as three of 40 bits, whose sums over a conversation of 2^23 turns stay whole."""
    digest = F.sha2(F.concat(turn_hash, F.unhex(F.lpad(F.hex(depth), 16, "0"))), 256)
    return [F.sum(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 10).cast("long")) for k in range(3)]


def _key(total: int) -> bytes:
    return (total & _MASK).to_bytes(16, "big")


ROOT = _key(0)


def _segments(own: DataFrame, heads: DataFrame, segment: int) -> DataFrame:
    """``base, seg, head, conv, sum1, sum2, sum3``: for each family's segment its base's first turns, and for each conversation
    that goes on in the segment the sums of the turns before."""
    shared = own.groupBy("base", "seg").count().drop("count").join(heads, "base", "left").withColumns({"conv": F.lit(None).cast("long"), **{f"sum{k}": F.lit(None).cast("long") for k in (1, 2, 3)}})
    long = own.filter(F.col("size") > segment)
    taken = F.least("taken", F.coalesce(F.size("head"), F.lit(0)))
    placed = long.join(heads, "base", "left").withColumn("hb", taken)
    depth = F.col("pos") - F.col("taken") + F.col("hb") + 1
    kept = placed.filter("pos >= taken").groupBy("base", "conv", "seg").agg(*(s.alias(f"s{k}") for k, s in zip((1, 2, 3), _sums(F.col("turn_hash"), depth), strict=True)))
    front = placed.filter("pos = 0").select("base", "conv", F.lit(-1).cast("long").alias("seg"), F.explode(F.slice("head", F.lit(1), F.col("hb"))).alias("h"))
    front = front.groupBy("base", "conv", "seg").agg(*(s.alias(f"s{k}") for k, s in zip((1, 2, 3), _sums(F.col("h.turn_hash"), F.col("h.pos") + 1), strict=True)))
    earlier = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = front.unionByName(kept).select("base", "seg", "conv", *(F.sum(f"s{k}").over(earlier).alias(f"sum{k}") for k in (1, 2, 3)))
    return shared.unionByName(carried.filter("seg > 0").withColumn("head", F.lit(None).cast(heads.schema["head"].dataType)))


def _family(rows: pa.Table, sides: pa.Table, segment: int) -> tuple[dict, list]:
    """The trie of a family's segment, as key -> [parent, depth, chars, n, least, ends], and the last keys of conversations that go on."""
    head, carry = [], {}
    for r in sides.to_pylist():
        if r["conv"] is None:
            head = sorted(r["head"] or [], key=lambda h: h["pos"])
        else:
            carry[r["conv"]] = ((r["sum1"] or 0) << 80) + ((r["sum2"] or 0) << 40) + (r["sum3"] or 0)
    nodes: dict[bytes, list] = {}
    tails = []

    def visit(key: bytes, parent: bytes | None, depth: int, chars: int, conv: int) -> None:
        if (node := nodes.get(key)) is None:
            nodes[key] = [parent, depth, chars, 1, conv, []]
        else:
            node[3] += 1
            node[4] = min(node[4], conv)

    rows = rows.sort_by([("conv", "ascending"), ("pos", "ascending")])
    names = ("conv", "pos", "size", "taken", "turn_hash", "chars")
    columns = [rows[c].to_pylist() for c in names]
    total, depth, key, now = 0, 0, ROOT, None
    for conv, pos, size, taken, turn_hash, chars in zip(*columns, strict=True):
        borrowed = min(taken, len(head))
        if conv != now:
            now = conv
            if pos:  # the conversation goes on from an earlier segment
                total, depth = carry[conv], pos - taken + borrowed
                key = _key(total)
            else:
                total, depth, key = 0, 0, ROOT
                visit(key, None, 0, 0, conv)
                for h in head[:borrowed]:
                    depth += 1
                    total += _tagged(h["turn_hash"], depth)
                    key, parent = _key(total), key
                    visit(key, parent, depth, h["chars"], conv)
        if pos >= taken:
            depth += 1
            total += _tagged(turn_hash, depth)
            key, parent = _key(total), key
            visit(key, parent, depth, chars, conv)
        if pos + 1 == size or (pos == 0 and size <= taken):
            nodes[key][5].append(conv)
        elif (pos + 1) % segment == 0:
            tails.append((conv, key))
    return nodes, tails


def _kept(own: DataFrame) -> DataFrame:
    """The turns that a rebuilt conversation keeps of its own, and its first one in any case: it tells that there is one."""
    return own.filter("pos >= taken or pos = 0")


def _tries(own: DataFrame, sides: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """All families' nodes, and the last nodes of conversations that go on in a later segment."""

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        base, seg = (left[c][0].as_py() for c in ("base", "seg"))
        nodes, tails = _family(left, right, segment)
        out = [{"base": base, "seg": seg, "key": k, "parent": p, "depth": d, "chars": c, "n": n, "least": m, "ends": e or None, "tail": None} for k, (p, d, c, n, m, e) in nodes.items()]
        out += [{"base": base, "seg": seg, "key": k, "parent": None, "depth": None, "chars": None, "n": None, "least": None, "ends": None, "tail": conv} for conv, k in tails]
        return pa.Table.from_pylist(out, schema=schema)

    schema = pa.schema([("base", pa.int64()), ("seg", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.list_(pa.int64())), ("tail", pa.int64())])
    both = own.toDF(*own.columns).groupBy("base", "seg").cogroup(sides.groupBy("base", "seg")).applyInArrow(build, f"{_NODES}, tail long")
    both = stash(both, "trie-families")
    return both.filter("tail is null").drop("tail"), both.filter("tail is not null").select("base", "seg", F.col("tail").alias("conv"), "key")


def _subtrees(rows: DataFrame, tails: DataFrame) -> DataFrame:
    """``key, saved, leaves``: for each node of a family's segment, what its subtree there adds to the whole trie's.

    Each node counts where its smallest member is, once; what a conversation
    adds beyond its segment comes in at the last node in ``tails(base, seg,
    key, saved, leaves)``.
    """
    schema = pa.schema([("key", pa.binary()), ("saved", pa.int64()), ("leaves", pa.int64())])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.sort_by([("depth", "descending")])
        keys, parents = rows["key"].to_pylist(), rows["parent"].to_pylist()
        sums = {k: [s, x] for k, s, x in zip(keys, rows["saved"].to_pylist(), rows["leaves"].to_pylist(), strict=True)}
        for k, s, x in zip(*(right[c].to_pylist() for c in ("key", "saved", "leaves")), strict=True):
            sums[k][0] += s
            sums[k][1] += x
        for k, p in zip(keys, parents, strict=True):
            if (above := sums.get(p)) is not None:
                above[0] += sums[k][0]
                above[1] += sums[k][1]
        return pa.table([keys, [sums[k][0] for k in keys], [sums[k][1] for k in keys]], schema=schema)

    return rows.toDF(*rows.columns).groupBy("base", "seg").cogroup(tails.groupBy("base", "seg")).applyInArrow(add, "key binary, saved long, leaves long")


def _later(counted: DataFrame, tails: DataFrame) -> DataFrame:
    """What the segments behind each tail hold of nodes whose smallest member is the tail's conversation."""
    totals = counted.filter("own").groupBy("base", F.col("least").alias("conv"), "seg").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    both = totals.withColumn("key", F.lit(None).cast("binary")).unionByName(tails.selectExpr("base", "conv", "seg", "0L as saved", "0L as leaves", "key"))
    behind = Window.partitionBy("conv").orderBy(F.col("seg").desc()).rangeBetween(Window.unboundedPreceding, -1)
    summed = both.select("base", "seg", "key", *(F.coalesce(F.sum(c).over(behind), F.lit(0)).alias(c) for c in ("saved", "leaves")))
    return summed.filter("key is not null")


def _listed(nodes: DataFrame) -> DataFrame:
    """``key, ends_sha256``: hash of the ids of conversations that end at a node, ascending and comma-joined.

    Ids are joined in stretches of LISTED values; a node's stretches stream
    through one hash, which a hash of a text in order cannot do otherwise.
    """
    ids = nodes.select("key", F.explode("ends").alias("id"))
    parts = ids.groupBy("key", F.floor(F.col("id") / LISTED).alias("stretch")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != now:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.record_batch(list(zip(*out, strict=True)) or [[], []], schema=schema)
        if state is not None:
            yield pa.record_batch([[now], [state.hexdigest()]], schema=schema)

    return parts.repartition("key").sortWithinPartitions("key", "stretch").mapInArrow(settled(digest), "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The trie of all rebuilt conversations of ``conversations(conv_id, turn, role, text)``, a row for each node.

    A conversation c is rebuilt from the first turns of its family's base (the
    id with c modulo 100 taken off; as many as crc32 of c modulo 6) and its own
    behind that number. Equal beginnings of rebuilt conversations share a node.

    Families are grouped by base and build their tries alone; texts stay where
    they are, as hashes and lengths are enough. Nodes of all families meet by
    their key, a 120-bit sum over the turns on the way from the root. What each
    node's subtree holds is summed in the family of the node's smallest member
    and then over the families. Conversations of over ``segment`` turns, which is at
    least HEADS, are worked in segments, with the sums before and behind carried
    over.

    Rows without conv_id belong to no conversation. Null role or text is empty,
    a null turn comes first, turns of one number are ordered by hash, and a
    repeated row is a turn of its own. Other columns are not looked at. An empty
    table has no node, not even a root.

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.
    """
    ready(conversations.sparkSession)
    own = stash(turns(conversations).withColumns({"base": _base(), "taken": _taken(), "seg": F.floor(F.col("pos") / segment)}), "trie-own")
    heads = own.filter(f"conv = base and pos < {HEADS - 1}").groupBy("base").agg(F.array_sort(F.collect_list(F.struct("pos", "turn_hash", "chars"))).alias("head"))
    nodes, tails = _tries(_kept(own), _segments(own, stash(heads, "trie-heads"), segment), segment)
    merged = nodes.groupBy("key").agg(F.sum("n").alias("n_all"), F.min("least").alias("conv_id"), F.first("parent").alias("parent"), F.first("depth").alias("depth"))
    merged = stash(merged, "trie-merged")
    children = merged.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    whole = stash(merged.join(children, "key", "left").na.fill(0, ["n_children"]), "trie-whole")
    discard(merged)
    met = nodes.select("base", "seg", "key", "parent", "depth", "chars", "least").join(whole.select("key", "n_all", "conv_id", "n_children"), "key")
    owned = F.col("least") == F.col("conv_id")
    counted = met.select("base", "seg", "key", "parent", "depth", "least", owned.alias("own"), F.when(owned, (F.col("n_all") - 1) * F.col("chars")).otherwise(F.lit(0)).alias("saved"), (owned & (F.col("n_children") == 0)).cast("long").alias("leaves"))
    counted = stash(counted, "trie-counted")
    sums = _subtrees(counted, _later(counted, tails)).groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    above = whole.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = whole.join(sums, "key").join(_listed(nodes.filter("ends is not null")), "key", "left").join(above, "parent", "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))
    return out.select("conv_id", "depth", "parent_conv_id", F.col("n_all").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
