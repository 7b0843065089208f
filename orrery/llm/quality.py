"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import fitting, ready, settle

#: Weights of the model; features are hashed into this many places.
PLACES = 1 << 18
#: Labelled rows to learn from at most: they are held in the driver's memory.
FIT_ROWS = 6_000
#: Bytes of text to learn from at most, in whole texts, for the same reason.
FIT_BYTES = 60_000_000
PASSES = 3
MEMO = 150_000

#: A token is a run of letters and digits or a run of other marks.
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_DIGIT = re.compile(r"[0-9]+")


@dataclass
class Settings:
    """FTRL-proximal's learning rates and penalties."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.5


def _codes(token: str) -> tuple[int, int]:
    """Hashes of a token's surface (lower case, digits as one) and of its shape (kind of characters, case, length class)."""
    if token[0].isalnum() or token[0] == "_":
        kind = "A" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "n" if token.isdigit() else "a"
        shape = f"\x01{kind}{min(len(token), 24) // 4}"
    else:
        shape = f"\x02{token[:4]}"
    return zlib.crc32(_DIGIT.sub("0", token.lower()).encode()), zlib.crc32(shape.encode())


def _spread(h: np.ndarray, salt: int) -> np.ndarray:
    x = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)


def features(text: str | None, memo: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a whole text's hashed word 1- and 2-grams, over surfaces and over shapes.

    A gram counts with the logarithm of its share of the text, and each of the
    two streams with unit length, so long and short texts are alike. A token
    said again at once and one said again two words later are grams of their
    own.
    """
    words = _TOKEN.findall(text) if text else []
    if not words:
        return np.zeros(1, dtype=np.int64), np.ones(1)
    if len(memo) > MEMO:
        memo.clear()
    for w in set(words).difference(memo):
        memo[w] = _codes(w)
    pair = np.array([memo[w] for w in words], dtype=np.uint64)
    surface, shape = pair[:, 0], pair[:, 1]
    one = np.uint64(1)
    again = [np.full(int((surface[k:] == surface[:-k]).sum()), 77 + k, dtype=np.uint64) for k in (1, 2) if len(words) > k]
    two = [(s[:-1] * np.uint64(0x100000001B3) + (s[1:] << one)) for s in (surface, shape)]
    with np.errstate(over="ignore"):
        streams = [
            np.concatenate([_spread(surface, 1), _spread(two[0], 2)]),
            np.concatenate([_spread(shape, 3), _spread(two[1], 4), *(_spread(a, 5) for a in again)]),
        ]
    places, values = [np.zeros(1, dtype=np.int64)], [np.ones(1)]
    for s in streams:
        at, count = np.unique(s.astype(np.int64) % (PLACES - 1) + 1, return_counts=True)
        weight = np.log1p(count * (64.0 / len(words)))
        places.append(at)
        values.append(weight / np.linalg.norm(weight))
    return np.concatenate(places), np.concatenate(values)


def train(rows: list[tuple[str | None, int]], settings: Settings, passes: int = PASSES) -> np.ndarray:
    """Weights after per-coordinate FTRL-proximal updates, in the rows' order."""
    z, n = np.zeros(PLACES), np.zeros(PLACES)
    memo: dict[str, tuple[int, int]] = {}
    seen = [(*features(t, memo), float(y)) for t, y in rows]

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= settings.l1, 0.0, -(zs - np.sign(zs) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2))

    for _ in range(passes):
        for at, x, y in seen:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(PLACES)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_on: Column | None = None, rows: int = FIT_ROWS, size: int = FIT_BYTES, settings: Settings | None = None) -> np.ndarray:
    """Learns from at most ``rows`` labelled rows of ``docs`` for which ``train_on`` holds, chosen by a hash of the id.

    The sample is a bounded top-k by hash, so it does not depend on how rows
    are dealt; its texts are whole and of ``size`` bytes in all at most, and one
    that does not fit is passed over. Rows whose label is null or that have
    none are not used; of labels that differ for one id the greatest counts, of
    several texts of one id the first in order.
    """
    named = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label")).filter("doc_id is not null")
    if train_on is not None:
        named = named.filter(train_on)
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label"))
    sample = sample.withColumn("_draw", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    data = fitting(sample, ["_draw", "doc_id"], size)
    return train([(r["text"], int(r["_label"])) for r in data], settings or Settings())


def score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text as ``column``; all other columns are kept.

    A sparse dot product of a text's features with the weights (1 MB, broadcast).
    Null and empty texts have the bias as their only feature.
    """
    ready(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        settle()
        w, memo = model.value.astype(np.float64), {}
        for part in texts:
            dots = [w[place] @ value for place, value in (features(t, memo) for t in part)]
            yield pd.Series(1 / (1 + np.exp(-np.clip(dots, -35, 35))), dtype="float64")
        memo.clear()
        settle()

    return docs.withColumn(column, probability("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """Scores every row of ``docs(doc_id, text)`` with a model learned from labelled rows that are not held out.

    Null or repeated doc_id: scored row by row. Ties at the threshold count as
    accepted. An empty table gives an empty result; without any label the score
    is 0.5.

    Returns ``doc_id, held_out, score, predicted``.
    """
    weights = fit(docs, labels, train_on=~held_out)
    scored = score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
