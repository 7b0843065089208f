"""Toxicity: a linear classifier of character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import fitting, ready, settle

#: Lengths of the n-grams, and places that they are hashed into.
GRAMS = (3, 4, 5)
PLACES = 1 << 20
#: Code points hashed together.
BLOCK = 1 << 18
#: Labelled rows to learn from at most, half of them of either label, and bytes of whole texts: the driver holds them.
FIT_ROWS, FIT_BYTES = 6_000, 60_000_000
#: An n-gram counts if so many of the texts learned from have it.
LEAST = 3
#: Passes over the texts, and how much their mean loss weighs against the weights' size.
PASSES, COST = 8, 30.0
#: Characters that part words: white space, controls and all other ASCII characters but letters and digits.
_PARTS = np.array([not chr(c).isalnum() for c in range(128)])


@dataclass
class Model:
    """What each place adds to the log-odds, and the log-odds of a text without any known n-gram."""

    weights: np.ndarray
    bias: float


def places(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Places of the distinct n-grams of a whole text in lower case, where each run of characters that part words is one space.

    ``seen`` is scratch memory of PLACES booleans, all false, and is given back
    so; a text is looked at in blocks, each behind the last characters of the one
    before, so what is made of them does not grow with its length.
    """
    low = (text or "").lower()
    held = np.full(1, 32, dtype=np.uint64)
    for at in range(0, len(low), BLOCK):
        codes = np.frombuffer(low[at : at + BLOCK].encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        codes[_PARTS[np.minimum(codes, 127).astype(np.intp)] & (codes < 128)] = 32
        codes = np.concatenate([held, codes, np.full(int(at + BLOCK >= len(low)), 32, dtype=np.uint64)])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        held = codes[-(GRAMS[-1] - 1) :]
        gram = codes
        for n in range(2, GRAMS[-1] + 1):
            gram = gram[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :] if len(codes) >= n else gram[:0]
            if n in GRAMS:
                mixed = (gram ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                seen[(mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found.astype(np.int32)


def ratios(found: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each place the log of its share among texts of label 1 over that among the others, with one text of each added.

    Places that fewer than LEAST texts have get 0 and so do not count.
    """
    counts = [np.zeros(PLACES), np.zeros(PLACES)]
    for at, y in zip(found, labels, strict=True):
        counts[int(y)][at] += 1
    clean, toxic = (c + 1 for c in counts)
    ratio = np.log(toxic / (2 + (labels == 1).sum())) - np.log(clean / (2 + (labels == 0).sum()))
    return np.where(counts[0] + counts[1] >= LEAST, ratio, 0.0)


def _ascended(dual: float, margin: float, norm: float, most: float) -> float:
    """The value between 0 and ``most`` at which log(b / (most - b)) + margin + (b - dual) * norm is 0, by guarded Newton steps."""
    b = dual
    for _ in range(8):
        value = math.log(b / (most - b)) + margin + (b - dual) * norm
        moved = b - value / (most / (b * (most - b)) + norm)
        b = b / 10 if moved <= 0 else (b + 9 * most) / 10 if moved >= most else moved
        b = min(max(b, most * 1e-9), most * (1 - 1e-9))
    return b


def train(rows: list[tuple[str | None, int]], odds: float | None = None, passes: int = PASSES, cost: float = COST) -> Model:
    """A logistic regression with squared weights as penalty over the scaled n-grams, by coordinate ascent in the dual.

    Each text has one dual value between 0 and ``cost`` over the number of
    texts; Newton steps in it move the weights along the text's n-grams. ``odds`` are those of label 1
    among all labelled rows: where the sample has others, the bias is moved.
    With texts of one label only, or none, every text gets that label's share.
    """
    labels = np.array([y for _, y in rows])
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    if not n1 or not n0:
        return Model(np.zeros(PLACES, np.float32), math.log((n1 + 0.5) / (n0 + 0.5)))
    seen = np.zeros(PLACES, dtype=bool)
    found = [places(t, seen) for t, _ in rows]
    ratio = ratios(found, labels)
    kept = np.flatnonzero(ratio)
    number = np.full(PLACES, -1, dtype=np.int32)
    number[kept] = np.arange(len(kept), dtype=np.int32)
    for i, at in enumerate(found):
        found[i] = number[at[ratio[at] != 0]]
    scale, weights = ratio[kept], np.zeros(len(kept))
    most = cost / len(rows)
    bias, dual = math.log(n1 / n0), np.full(len(rows), most * 1e-3)
    sign = np.where(labels == 1, 1.0, -1.0)
    norms = [float(scale[at] @ scale[at]) + 1.0 for at in found]
    for i, at in enumerate(found):
        weights[at] += sign[i] * dual[i] * scale[at]
        bias += sign[i] * dual[i]
    order = np.random.default_rng(11)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            at, a = found[i], dual[i]
            x = scale[at]
            margin = sign[i] * (float(weights[at] @ x) + bias)
            b = _ascended(a, margin, norms[i], most)
            dual[i] = b
            weights[at] += sign[i] * (b - a) * x
            bias += sign[i] * (b - a)
    if odds:
        bias += math.log(odds) - math.log(n1 / n0)
    out = np.zeros(PLACES, np.float32)
    out[kept] = weights * scale
    return Model(out, bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_on: Column | None = None, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """Learns from at most ``rows`` labelled rows for which ``train_on`` holds, half of them of either label at most.

    Rows are chosen by a hash of the id, and their whole texts have ``size``
    bytes in all at most; one that does not fit is passed over. Null labels are
    not used; of labels that differ for one id the greatest counts, of several
    texts of one id the first in order. The odds are those of all labelled rows.
    """
    named = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")).filter("doc_id is not null")
    if train_on is not None:
        named = named.filter(train_on)
    counts = {r["_label"]: r["count"] for r in named.groupBy("_label").count().collect()}
    half = rows // 2
    chosen = None
    for value in (0, 1):
        part = named.filter(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label"))
    sample = sample.withColumn("_draw", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    data = fitting(sample, ["_draw", "doc_id"], size)
    odds = counts[1] / counts[0] if counts.get(0) and counts.get(1) else None
    return train([(r["text"], int(r["_label"])) for r in data], odds)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text as ``column``; all other columns are kept.

    The sum of the weights of a text's distinct n-grams (4 MB, broadcast). Null
    and empty texts have none, so they get the bias.
    """
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        settle()
        known, seen = sent.value, np.zeros(PLACES, dtype=bool)
        for part in texts:
            odds = [known.bias + float(known.weights[places(t, seen)].sum(dtype=np.float64)) for t in part]
            yield pd.Series(1 / (1 + np.exp(-np.clip(odds, -35, 35))), dtype="float64")
        settle()

    return docs.withColumn(column, probability("text"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """Scores every row of ``docs(doc_id, text)`` with a model learned from labelled rows that are not held out.

    Null or repeated doc_id: scored row by row. Ties at the threshold count as
    toxic. An empty table gives an empty result; without any label the score is
    0.5.

    Returns ``doc_id, held_out, score, predicted``.
    """
    model = fit(docs, labels, train_on=~held_out)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
