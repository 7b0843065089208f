"""Language ID: a blended-spectrum string kernel with Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import fitting, ready

#: Byte n-grams of these lengths, each hashed into its own share of PLACES.
SPECTRUM = (1, 2, 3, 4)
PLACES = 1 << 14
#: Rows to learn from at most for each language, rows in all (but one of each language at least), landmarks (likewise).
ROWS_PER_LANG, FIT_ROWS, LANDMARKS = 400, 6_000, 384
#: Bytes of text to learn from at most, in whole texts.
FIT_BYTES = 60_000_000
RIDGE = 1e-2
#: Texts in one matrix product.
BATCH = 128
#: Bytes of a text worked on at a time; all of it is worked on.
SLICE = 1 << 20


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # normalised presence rows of the landmark texts, float32
    weights: np.ndarray  # landmarks x languages


def presence(text: str) -> np.ndarray:
    """Which hashed n-grams of a whole text there are: the feature map of the presence kernel.

    Letters count in lower case; everything that is no letter is one space, so
    numbers, marks and layout say nothing about the language.
    """
    raw = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(_ASCII)
    data = np.frombuffer(b" " + " ".join(raw.split()).encode("utf-8", "replace") + b" ", dtype=np.uint8).astype(np.uint32)
    share = PLACES // len(SPECTRUM)
    seen = np.zeros(PLACES, dtype=bool)
    for begin in range(0, len(data), SLICE):
        part = data[begin : begin + SLICE + max(SPECTRUM) - 1]
        gram = np.zeros(len(part), dtype=np.uint32)
        for k in range(max(SPECTRUM)):
            if len(part) <= k:
                break
            gram = (gram[: len(part) - k] << np.uint32(8)) | part[k:]
            if k + 1 in SPECTRUM:
                i = SPECTRUM.index(k + 1)
                seen[(gram * np.uint32(0x9E3779B1) >> np.uint32(32 - (share - 1).bit_length())) + np.uint32(i * share)] = True
    return seen


_ASCII = {i: (chr(i) if chr(i).isalpha() else " ") for i in range(128)}


def _normal(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def train(rows: list[tuple[str, str]]) -> Model:
    """Landmarks dealt evenly to the languages, then ridge regression on the Nyström features of all rows.

    With K the kernel among landmarks and C that of rows with landmarks, the
    features are C K^-1/2; the weights fold K^-1/2 in, so a score is one product
    with the kernel row.
    """
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((0, PLACES), np.float32), np.zeros((0, 0), np.float32))
    x = np.stack([presence(t) for t, _ in rows])
    y = np.array([langs.index(lang) for _, lang in rows])
    each = max(1, LANDMARKS // len(langs))
    marks = _normal(x[np.concatenate([np.flatnonzero(y == i)[:each] for i in range(len(langs))])])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    feature = np.concatenate([(_normal(x[i : i + BATCH]) @ marks.T).astype(np.float64) @ root for i in range(0, len(x), BATCH)])
    goal = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weigh = (len(y) / (len(langs) * np.bincount(y, minlength=len(langs))))[y][:, None]  # rare languages count as much
    solve = np.linalg.solve(feature.T @ (feature * weigh) + RIDGE * len(y) * np.eye(feature.shape[1]) / 100, feature.T @ (goal * weigh))
    return Model(langs, marks, (root @ solve).astype(np.float32))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and a score from 0 to 1 of each text, by one product with the landmarks and one with the weights for a batch."""
    letters = [t is not None and any(map(str.isalpha, t)) for t in texts]
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    at = [i for i, x in enumerate(letters) if x and model.langs]
    for k in range(0, len(at), BATCH):
        part = at[k : k + BATCH]
        value = (_normal(np.stack([presence(texts[i]) for i in part])) @ model.landmarks.T) @ model.weights
        best = value.argmax(axis=1)
        sure = np.exp(4.0 * (value - value.max(axis=1, keepdims=True)).astype(np.float64))
        sure = 1.0 / sure.sum(axis=1)
        for i, b, s in zip(part, best, sure, strict=True):
            names[i], scores[i] = model.langs[b], s
    return names, scores


def fit(docs: DataFrame, train_on: Column | None = None, per_lang: int = ROWS_PER_LANG, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """Learns from a bounded sample of rows with a language, chosen by a hash of the id.

    Each language gets ``per_lang`` rows, fewer where there are so many
    languages that ``rows`` in all would be passed, and one at least; texts are
    whole and of ``size`` bytes in all at most. Every language is learned. The
    languages' counts give each a rate, so a rare language is learned from all
    of its rows.
    """
    known = docs.select("doc_id", "text", "lang").filter("lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    if train_on is not None:
        known = known.filter(train_on)
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return train([])
    each = max(1, min(per_lang, rows // len(counts)))
    rate = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], min(1.0, (1.25 * each + 8) / r["count"]))))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    picked = known.filter(draw < F.try_element_at(rate, F.col("lang"))).withColumn("draw", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("hash", F.xxhash64("doc_id", "text"))
    picked = picked.dropDuplicates(["lang", "hash"])  # a row that is repeated without end is one
    # every language's first rows come before any language's second ones, so that the bound on bytes leaves none out
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "hash"))
    got = fitting(picked.withColumn("turn", turn), ["turn", "draw", "lang", "hash"], size, "lang", each)
    return train([(r["text"], r["lang"]) for r in got if any(map(str.isalpha, r["text"]))])


def languages(docs: DataFrame, held_out: Column) -> DataFrame:
    """Predicts the language of every whole text of ``docs(doc_id, text, lang)``, learning from rows that are not held out.

    A text that is null or has no letter is ``und`` with score 0; so is every
    text if there is nothing to learn from. Ties go to the first language in
    order. Null or repeated doc_id: predicted row by row. An empty table gives
    an empty result.

    Returns ``doc_id, held_out, lang_pred, score``.
    """
    spark = docs.sparkSession
    ready(spark)
    model = spark.sparkContext.broadcast(fit(docs, ~held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            names, scores = predict(known, batch.column(2).to_pylist())
            yield pa.record_batch([*batch.columns[:2], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
