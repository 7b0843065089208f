"""Where passages stand in texts, changed words allowed: seeds of rare words, then an alignment of the words around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.retrieval import fits
from orrery.session import ship
from orrery.storage import stash

# Fixed value: the share of a passage's words that must be there.
LEAST = 0.75
#: Words of a text that go together to an alignment.
BLOCK = 256
_JOINT = "\x1f"


def words(text: Column) -> Column:
    """The words of a text between white space (space, tab to return), lower case."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _edits(size: Column, least: float) -> Column:
    return F.floor(size * (1 - least) + 1e-9).cast("int")


def align(passage: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """``edits, start, end`` of the window of ``text`` with the fewest word edits to ``passage``: of several the first start, then the first end.

    One row of the table of edits a passage word; each cell holds its edits and
    the start it came from in one number, so the least keeps both.
    """
    unit = np.int64(len(text) + 2)
    steps = np.arange(len(text) + 1, dtype=np.int64) * unit
    row = np.arange(len(text) + 1, dtype=np.int64)
    for word in passage:
        below = row + unit
        below[1:] = np.minimum(below[1:], row[:-1] + np.where(text == word, 0, unit))
        row = np.minimum.accumulate(below - steps) + steps
    end = int(row.argmin())
    return int(row[end] // unit), int(row[end] % unit), end


def _seeds(passages: DataFrame, least: float) -> DataFrame:
    """``passage, key, at, size, edits, q`` of ``passages(passage, ws)``: runs of ``q`` words that do not overlap, one more at least than edits are allowed.

    An edit touches one run, so one is left whole in every window that is near enough.
    """
    sized = passages.select("passage", "ws", F.size("ws").alias("size"), _edits(F.size("ws"), least).alias("edits"))
    length = F.least(F.floor(F.col("size") / (F.col("edits") + 1)).cast("int"), F.lit(3))
    cut = sized.withColumn("q", length)
    starts = F.sequence(F.lit(0), F.floor(F.col("size") / F.col("q")).cast("int") - 1)
    return cut.select("passage", "size", "edits", "q", F.explode(F.transform(starts, lambda i: F.struct((i * F.col("q")).alias("at"), F.array_join(F.slice("ws", i * F.col("q") + 1, F.col("q")), _JOINT).alias("key")))).alias("s")).select("passage", "size", "edits", "q", "s.at", "s.key")


def _runs(blocks: DataFrame, lengths: list[int]) -> DataFrame:
    """``text_id, copy, pos, key`` of the runs of the given lengths that begin in a block, ``pos`` being their place in the text."""
    n = F.greatest(F.size("ws"), F.lit(1))
    following = F.arrays_zip(F.col("ws").alias("w1"), F.slice("ws", 2, n).alias("w2"), F.slice("ws", 3, n).alias("w3"))
    words = blocks.select("text_id", "copy", "block", F.posexplode(following).alias("at", "w")).filter(F.col("at") < BLOCK)
    last = {q: F.col(f"w.w{q}") for q in (1, 2, 3)}
    run = lambda q: F.when(last[q].isNotNull(), F.concat_ws(_JOINT, *(last[i] for i in range(1, q + 1))))
    pos = (F.col("block") * BLOCK + F.col("at")).cast("int").alias("pos")
    return words.select("text_id", "copy", pos, F.explode(F.array(*map(run, lengths))).alias("key")).filter("key is not null")


def find_passages(texts: DataFrame, passages: DataFrame, least: float = LEAST) -> DataFrame:
    """``passage_id, text_id, place, words, likeness``: the window of each text that is most like a passage, at ``least`` or more.

    ``texts(text_id, text)`` and ``passages(passage_id, passage)``; likeness is 1
    less the words to change, drop or add over the passage's words, ``place`` the
    window's first word (from 0) and ``words`` its length; of several windows the
    first, of those the shortest. Exact: no window is missed, whole texts are
    read, and ``least`` is 0.5 or more. Null, empty and blank texts and passages
    have no rows; equal passages have the same ones; a row without id is left
    out, of an id that comes again each text is searched and the best window kept.

    A passage is cut into runs of one to three words, which are sought in all
    texts: where they are known to fit a broadcast, the texts' runs do not move;
    beyond that both sides have plain exchanges, so a frequent run can be split.
    Where one of a passage's rarest runs is, of which it takes one more than
    edits are allowed, the blocks of words around it go to an alignment with the
    passage. What meets in a task is a passage's length, not a text's.
    """
    if not 0.5 <= least <= 1:
        raise ValueError("likeness is 0.5 to 1")
    ship(texts.sparkSession)
    known = passages.filter("passage_id is not null").select("passage_id", words(F.col("passage")).alias("ws")).filter(F.size("ws") > 0).select("passage_id", "ws", F.sha2(F.array_join("ws", _JOINT), 256).alias("passage"))
    kinds = stash(known.groupBy("passage").agg(F.any_value("ws").alias("ws")), "passages")
    rows = texts.filter("text_id is not null").select("text_id", words(F.col("text")).alias("ws"), F.sha2("text", 256).alias("copy")).filter(F.size("ws") > 0)
    blocked = rows.select("text_id", "copy", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / BLOCK).cast("int")), lambda b: F.struct(b.alias("block"), F.slice("ws", b * BLOCK + 1, F.lit(BLOCK + 2)).alias("ws")))).alias("b")).select("text_id", "copy", "b.block", "b.ws")
    blocks = stash(blocked, "passage-blocks")  # a block has the first two words of the next, so each run is in one
    seeds = stash(_seeds(kinds, least), "passage-seeds")
    runs = _runs(blocks, sorted(r["q"] for r in seeds.select("q").distinct().collect()) or [1])
    asked = seeds.select("key").distinct()
    found = runs.join(F.broadcast(asked), "key", "left_semi") if fits(asked) else runs.repartition("key").join(asked.repartition("key"), "key", "left_semi")
    hits = stash(found, "passage-hits")
    often = hits.groupBy("key").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("passage").orderBy(F.coalesce("n", F.lit(0)), "at")
    chosen = seeds.join(often, "key", "left").withColumn("rank", F.row_number().over(rarest)).filter("rank <= edits + 1 and n is not null")
    wide = F.col("edits") + 1  # diagonals that go to one alignment
    met = hits.repartition("key").join(chosen.select("key", "passage", "at", "size", "edits").repartition("key"), "key")
    places = met.select("passage", "text_id", "copy", "size", "edits", F.floor((F.col("pos") - F.col("at")) / wide).cast("int").alias("band")).distinct()
    first = F.greatest(F.col("band") * wide - F.col("edits"), F.lit(0))
    until = F.col("band") * wide + F.col("edits") + F.col("size") + F.col("edits")
    spans = places.filter(until > 0).select("passage", "text_id", "copy", first.alias("first"), until.alias("until"), F.explode(F.sequence(F.floor(first / BLOCK).cast("int"), F.floor((until - 1) / BLOCK).cast("int"))).alias("block"))
    said = blocks.select("text_id", "copy", "block", F.array_join(F.slice("ws", 1, BLOCK), " ").alias("said"))  # half as large as the words one by one
    parts = spans.repartition("text_id", "copy", "block").join(said.repartition("text_id", "copy", "block"), ["text_id", "copy", "block"]).withColumn("ws", F.split("said", " "))
    inner = F.col("first") - F.col("block") * BLOCK
    clipped = parts.withColumn("ws", F.slice("ws", F.greatest(inner, F.lit(0)) + 1, F.greatest(F.least(F.col("until") - F.col("block") * BLOCK, F.lit(BLOCK)) - F.greatest(inner, F.lit(0)), F.lit(0))))
    window = clipped.groupBy("passage", "text_id", "copy", "first", "until").agg(F.array_sort(F.collect_list(F.struct("block", "ws"))).alias("parts")).select("passage", "text_id", "first", F.flatten(F.col("parts.ws")).alias("around"))
    pairs = window.repartition("passage").join(kinds.repartition("passage"), "passage").select("passage", "text_id", "first", "ws", "around")
    id_type = texts.schema["text_id"].dataType.simpleString()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for want, around in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                codes = pd.factorize(np.array(want + around, dtype=object))[0]
                found.append(align(codes[: len(want)], codes[len(want) :]))
            edits, start, end = (pa.array([f[k] for f in found], pa.int32()) for k in range(3))
            sizes = batch.column(3).value_lengths().cast(pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), sizes, edits, start, end], names=["passage", "text_id", "first", "size", "edits", "start", "end"])

    scored = pairs.mapInArrow(aligned, f"passage string, text_id {id_type}, first int, size int, edits int, start int, end int").filter(F.col("edits") <= _edits(F.col("size"), least))
    best = scored.groupBy("passage", "text_id").agg(F.min(F.struct("edits", (F.col("first") + F.col("start")).alias("place"), (F.col("end") - F.col("start")).alias("words"), "size")).alias("b"))
    return known.select("passage_id", "passage").distinct().join(best, "passage").select("passage_id", "text_id", "b.place", "b.words", F.round(1 - F.col("b.edits") / F.col("b.size"), 6).alias("likeness"))
