"""What several operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.session import ship
from orrery.storage import discard, stash

#: Words are runs of anything but ASCII white space.
SPACE_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Rows in an Arrow batch: some texts are very long, so batches are kept short.
BATCH_ROWS = 256
#: The sieve's words of 64 bits: at most 16 MB, whatever the corpus.
SIEVE_MAX_WORDS = 1 << 21


def ready(spark: SparkSession) -> None:
    """Sends the package to the Python workers and keeps their Arrow batches small enough for long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collapse_space(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty.

    A lone space is its own replacement, so the pattern passes over it.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def id_mod(col: str, m: int) -> Column:
    """crc32 of the id written in decimal, modulo ``m``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % m


def row_key(text_hash: Column) -> Column:
    """Names a row by its id and its text's hash: a repeated doc_id may come with several texts."""
    return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_hash)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Names like those asked for that no column of ``frame`` has, whatever its case."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def fitting(rows: DataFrame, order: list[str], bytes_most: int, each: str | None = None, each_most: int = 0) -> list:
    """A bounded sample's rows on the driver: whole texts of at most ``bytes_most`` bytes in all.

    ``rows`` is a sample of a bounded number of rows with a ``text``; it is
    written once, so that sizes alone can settle which rows come over. They are
    taken in the order given, at most ``each_most`` of each value of ``each``; a
    text that does not fit is passed over and shorter ones may follow.
    """
    held = stash(rows.withColumn("_no", F.monotonically_increasing_id()), "fit-sample")
    names = [*order, *([each] if each else [])]
    facts = held.select("_no", *names, F.coalesce(F.octet_length("text"), F.lit(0)).alias("_size")).collect()
    left, taken, chosen = bytes_most, {}, []
    for r in sorted(facts, key=lambda r: tuple(r[k] for k in order)):
        value = r[each] if each else None
        if r["_size"] <= left and (not each or taken.get(value, 0) < each_most):
            left -= r["_size"]
            taken[value] = taken.get(value, 0) + 1
            chosen.append(r["_no"])
    got = held.filter(F.col("_no").isin(chosen)).drop("_no").collect() if chosen else []
    discard(held)
    return sorted(got, key=lambda r: tuple(r[k] for k in order))


def gapless_rank(rows: DataFrame, within: list[str], spread: Column, order: list[Column], n_rows: int, rank: str) -> DataFrame:
    """Adds ``rank``: 0, 1, 2, ... within each value of ``within``, in no set order.

    Each class is cut into enough salted pieces for a piece to fit a task; the
    pieces' counts give each piece its first rank. So a class that holds a third
    of all rows, or all of them, is still numbered by many tasks.
    """
    salts = max(32, -(-n_rows // 50_000))
    rows = rows.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    keys = [*within, "_salt"]
    before = Window.partitionBy(*within).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.join(first, keys).withColumn(rank, F.col("_first") + inner - 1).drop("_first", "_salt")


def sieve(ids: DataFrame, key: str, expected: int) -> DataFrame:
    """A bitmap of hashed keys as ``word, bits``: a superset test of bounded size.

    At 16 bits for each expected key it lets about one stranger in sixteen pass;
    it never exceeds ``SIEVE_MAX_WORDS`` rows, so it may be broadcast at any
    scale. Beyond some ten million keys it lets more strangers pass, which costs
    shuffled bytes and never changes a result: an exact join follows.
    """
    words = 1 << 10
    while words < SIEVE_MAX_WORDS and words * 64 < 16 * expected:
        words *= 2
    h = F.xxhash64(F.col(key))
    spark = ids.sparkSession
    spark.conf.set("spark.sql.broadcastTimeout", "3600")
    out = ids.select(F.pmod(F.shiftright(h, 6), F.lit(words)).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) as int))").alias("bit"))
    out = out.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out._sieve_words = words
    return out


def sifted(rows: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """Rows whose key the bitmap may hold."""
    (maybe,) = fresh(rows, "_maybe")
    return _tested(rows, key, bitmap, maybe).filter(F.col(maybe)).drop(maybe)


def _tested(rows: DataFrame, key: str, bitmap: DataFrame, maybe: str) -> DataFrame:
    word, bits = fresh(rows, "_word", "_bits")
    h = F.xxhash64(F.col(key))
    at = rows.withColumn(word, F.pmod(F.shiftright(h, 6), F.lit(bitmap._sieve_words)))
    bit = F.expr(f"shiftrightunsigned(`{bits}`, cast(pmod(xxhash64(`{key}`), 64) as int)) & 1L") == 1
    got = at.join(F.broadcast(bitmap.select(F.col("word").alias(word), F.col("bits").alias(bits))), word, "left").withColumn(maybe, F.coalesce(bit, F.lit(False)))
    return got.drop(word, bits)


def rows_with(rows: DataFrame, key: Column, keys: DataFrame, stay: bool) -> DataFrame:
    """Rows whose key is in ``keys(key)`` (``stay``) or is not; a null key is in no table.

    The sieve settles nearly all rows where they are read, so only rows that it
    lets pass are shuffled for the exact join.
    """
    name, maybe = fresh(rows, "_key", "_maybe")
    keys = keys.select(F.col("key").alias(name))
    tested = _tested(rows.withColumn(name, key), name, sieve(keys, name, keys.count()), maybe)
    if stay:
        out = tested.filter(F.col(maybe)).join(keys, name, "left_semi")
    else:
        out = tested.filter(~F.col(maybe)).unionByName(tested.filter(F.col(maybe)).join(keys, name, "left_anti"))
    return out.select(rows.columns)


def without(rows: DataFrame, key: Column, gone: DataFrame, once: DataFrame) -> DataFrame:
    """``rows`` without those whose key is in ``gone(key)``, and one only of those with a key in ``once(key)``."""
    left = rows_with(rows, key, gone, stay=False)
    if once.isEmpty():
        return left
    (name,) = fresh(rows, "_key")
    single = rows_with(left, key, once, stay=True).withColumn(name, key).dropDuplicates([name]).select(rows.columns)
    return rows_with(left, key, once, stay=False).unionByName(single)


_kept: dict = {}


def kept(name, make: Callable):
    """The one large object, such as a tokenizer with what it remembers, that a worker keeps for the tasks that follow."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def settle(own: bool = False) -> None:
    """Drops what another operator has left in this worker (unless ``own``) and gives freed memory back to the machine."""
    if not own:
        _kept.clear()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def settled(run: Callable, own: bool = False) -> Callable:
    """A worker's function over batches that begins and ends with :func:`settle`; ``own`` keeps the large object for the next task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(own)
        try:
            yield from run(batches)
        finally:
            settle(own)

    return task


def grouped_rows(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key of a stream sorted by ``keys``; one key is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for begin, end in zip(edges, edges[1:], strict=False):
            now = tuple(c[begin] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` rows of a stream sorted by ``keys``, none of which cuts the rows of a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < size:
            continue
        rows = pa.Table.from_batches(held)
        change = np.zeros(rows.num_rows, dtype=bool)
        for k in keys:
            c = rows[k].to_numpy()
            change[1:] |= c[1:] != c[:-1]
        cut = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if cut:
            yield rows.slice(0, cut)
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def larger(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Joins short batches until the text column holds about ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column(column).nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if held and any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
