"""LM scoring: masked pseudo-likelihood under a bidirectional window network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import larger, ready
from orrery.llm.shingles import hashes
from orrery.storage import stash

#: The most frequent words are outputs of the network's first level; the next ones are in classes of EACH words, dealt by rank; one output is for all others.
HEADS, CLASSES, EACH = 31, 32, 128
FIRST, WORDS = HEADS + CLASSES + 1, HEADS + CLASSES * EACH
#: Inputs: 0 beyond the text's ends, the words above, and hash places for all others.
HASHED = 256
INPUTS = 1 + WORDS + HASHED
#: Words looked at on each side of the masked one, and hidden units.
SIDE, HIDDEN = 2, 16
#: Rounds of training; each learns from every word.
ROUNDS = 1
#: Windows in one step, learning rate, and tokens scored at a time.
STEP, RATE, BLOCK = 4096, 0.15, 2048
#: Rows of one class in a product of the second level.
TILE = 16
#: Bytes of text put together for one call.
GATHER = 1_000_000
#: Parameters in one message, and partitions whose messages are averaged first.
CHUNK, FAN = 8192, 256
#: Places of the table of word counts: 16 for each kind of word up to 16 MB in all.
PLACES_LEAST, PLACES_MOST = 1 << 16, 1 << 24
#: Steps of a doubling in the table of word counts, and slices it is made in.
FINE, SLICES = 8, 256

_SHAPES = {"e": (2 * SIDE, INPUTS, HIDDEN), "a": (HIDDEN,), "o": (HIDDEN, FIRST), "c": (FIRST,), "p": (CLASSES, HIDDEN, EACH), "q": (CLASSES, EACH)}
_SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())
_AROUND = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)], dtype=np.int32)
_INPUT = np.arange(INPUTS)
_IN_CLASS = (_INPUT > HEADS) & (_INPUT <= WORDS)
#: Of each input, its output on the first level, its class and its place there (-1: none).
_ONE = np.where(_INPUT <= HEADS, np.maximum(_INPUT - 1, 0), np.where(_IN_CLASS, HEADS + (_INPUT - HEADS - 1) % CLASSES, FIRST - 1)).astype(np.int32)
_TWO = np.where(_IN_CLASS, (_INPUT - HEADS - 1) // CLASSES, -1).astype(np.int32)


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of a flat parameter vector."""
    out, at = {}, 0
    for k, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at : at + n].reshape(shape)
        at += n
    return out


class Vocabulary:
    """The corpus's words: the frequent ones by name, with their counts, and the counts of all others in a table.

    A place of the table holds the mean count of the words that hash there, as
    a power of two in steps of 1 / FINE; ``others`` is the sum of their counts.
    """

    def __init__(self, words: list[str], counts: np.ndarray, table: np.ndarray, others: float):
        self.words, self.counts, self.table, self.others = words, counts, table, others

    def codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's input and the log of its share of its output: 0 for a frequent word."""
        at = pc.index_in(words, value_set=pa.array(self.words, pa.string())).fill_null(-1).to_numpy()
        other = np.flatnonzero(at < 0)
        hashed = hashes(words)[other]
        codes, share = at + 1, np.zeros(len(at))
        codes[other] = 1 + WORDS + (hashed % np.uint64(HASHED)).astype(np.int32)
        mean = np.exp2(self.table[place_of(hashed, len(self.table))] / FINE)
        share[other] = np.log(np.maximum(mean, 1.0) / max(self.others, 1.0))
        return codes, share


def place_of(hashed: np.ndarray, places: int) -> np.ndarray:
    return ((hashed >> np.uint64(20)) % np.uint64(places)).astype(np.int64)


def start(known: Vocabulary) -> np.ndarray:
    """Parameters that give each word its frequency, whatever is around it."""
    rng = np.random.default_rng(23)
    net = {k: rng.normal(0, 0.1, s) if k in "eop" else np.zeros(s) for k, s in _SHAPES.items()}
    counts = np.ones(INPUTS)
    counts[1 : len(known.counts) + 1] += known.counts
    here = np.arange(1, WORDS + 1)
    first = np.bincount(_ONE[here], counts[here], FIRST)
    first[-1] += known.others + 1
    net["c"] = np.log(first / first.sum())
    inner = here[_TWO[here] >= 0]
    net["q"][_ONE[inner] - HEADS, _TWO[inner]] = np.log(counts[inner] / first[_ONE[inner]])
    return np.concatenate([p.ravel() for p in net.values()]).astype(np.float32)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, each word's place among them, and the number of words of each text.

    Words are in lower case, between white space; a null text has none.
    """
    clean = pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    lists = pc.utf8_split_whitespace(clean)
    words, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(clean, "").to_numpy(zero_copy_only=False)
    if blank.any():
        words, lengths = words.filter(pc.not_equal(words, "")), np.where(blank, 0, lengths)
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), lengths


class Windows:
    """The symbols around each position of several texts; beyond a text's ends there is symbol 0."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.at = (np.arange(len(ids)) + SIDE * np.repeat(np.arange(1, len(lengths) + 1), lengths)).astype(np.int32)
        self.padded = np.zeros(len(ids) + SIDE * (len(lengths) + 1), dtype=np.int32)
        self.padded[self.at] = ids

    def of(self, places: slice) -> np.ndarray:
        return self.padded[self.at[places][:, None] + _AROUND]


class Inner:
    """Rows of the second level, sorted by class and put into tiles of TILE rows of one class."""

    def __init__(self, goal: np.ndarray):
        rows = np.flatnonzero(_TWO[goal] >= 0)
        kind = _ONE[goal[rows]] - HEADS
        order = np.argsort(kind.astype(np.int16), kind="stable")
        self.rows, kind = rows[order], kind[order]
        self.slot = _TWO[goal[self.rows]]
        counts = np.bincount(kind, minlength=CLASSES)
        tiles = -(-counts // TILE)
        place = np.arange(len(rows)) - (np.cumsum(counts) - counts)[kind]
        self.tile, self.place = (np.cumsum(tiles) - tiles)[kind] + place // TILE, place % TILE
        self.kind = np.repeat(np.arange(CLASSES), tiles)  # of each tile

    def logits(self, net: dict[str, np.ndarray], hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.zeros((len(self.kind), TILE, HIDDEN), dtype=hidden.dtype)
        held[self.tile, self.place] = hidden[self.rows]
        out = held @ net["p"][self.kind]
        out += net["q"][self.kind][:, None, :]
        return held, out


def _hidden(net: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    total = net["e"][0][around[:, 0]] + net["a"]
    for k in range(1, 2 * SIDE):
        total += net["e"][k][around[:, k]]
    return np.tanh(total, out=total)


def log_probabilities(net: dict[str, np.ndarray], around: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Log of the probability that the network gives each masked symbol, from both sides: output, then place in its class.

    Logits are bounded by the parameters, as hidden units are by 1, so nothing overflows.
    """
    hidden = _hidden(net, around)
    logits = hidden @ net["o"]
    logits += net["c"]
    out = logits[np.arange(len(goal)), _ONE[goal]]
    out -= np.log(np.exp(logits, out=logits).sum(axis=1))
    inner = Inner(goal)
    if len(inner.rows):
        _, two = inner.logits(net, hidden)
        own = two[inner.tile, inner.place, inner.slot]
        out[inner.rows] += own - np.log(np.exp(two, out=two).sum(axis=2))[inner.tile, inner.place]
    return out


def gradient(net: dict[str, np.ndarray], around: np.ndarray, goal: np.ndarray) -> tuple[dict[str, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Of the mean negative log-probability of the masked symbols: by the parameters but "e", and by the rows of "e" that were used."""
    n, hidden = len(goal), _hidden(net, around)
    p = hidden @ net["o"]
    p += net["c"]
    np.exp(p, out=p)
    p /= n * p.sum(axis=1, keepdims=True)
    p[np.arange(n), _ONE[goal]] -= 1 / n
    out = {"o": hidden.T @ p, "c": p.sum(axis=0), "p": np.zeros_like(net["p"]), "q": np.zeros_like(net["q"])}
    back = p @ net["o"].T
    inner = Inner(goal)
    if len(inner.rows):
        held, two = inner.logits(net, hidden)
        np.exp(two, out=two)
        two /= n * two.sum(axis=2, keepdims=True)
        two[inner.tile, inner.place, inner.slot] -= 1 / n
        used = np.zeros(two.shape[:2], dtype=bool)
        used[inner.tile, inner.place] = True
        two[~used] = 0
        ends = np.concatenate([np.flatnonzero(np.diff(inner.kind, prepend=-1)), [len(inner.kind)]])
        for i, j in zip(ends[:-1], ends[1:], strict=True):
            mine = two[i:j].reshape(-1, EACH)
            out["p"][inner.kind[i]], out["q"][inner.kind[i]] = held[i:j].reshape(-1, HIDDEN).T @ mine, mine.sum(axis=0)
        back[inner.rows] += (two @ net["p"].transpose(0, 2, 1)[inner.kind])[inner.tile, inner.place]
    back *= 1 - hidden * hidden
    out["a"] = back.sum(axis=0)
    rows, units, sent = [], np.arange(HIDDEN), back.ravel()
    for k in range(2 * SIDE):
        used = np.zeros(INPUTS, dtype=bool)
        used[around[:, k]] = True
        used = np.flatnonzero(used)
        total = np.bincount((around[:, k, None] * HIDDEN + units).ravel(), sent, INPUTS * HIDDEN).reshape(INPUTS, HIDDEN)
        rows.append((used, total[used].astype(hidden.dtype)))
    return out, rows


class Trainer:
    """One partition's copy of the network, with a rate for each parameter that falls as its gradients add up."""

    def __init__(self, flat: np.ndarray):
        self.flat, self.total = flat.copy(), np.full_like(flat, 1e-6)

    def step(self, around: np.ndarray, goal: np.ndarray) -> None:
        net, total = unpack(self.flat), unpack(self.total)
        dense, rows = gradient(net, around, goal)
        for k, g in dense.items():
            total[k] += g * g
            g /= np.sqrt(total[k])
            g *= RATE
            net[k] -= g
        for k, (at, g) in enumerate(rows):
            total["e"][k][at] += g * g
            net["e"][k][at] -= RATE * g / np.sqrt(total["e"][k][at])


def _learn(shared):
    """Trains on a partition's words and sends the parameters, in chunks, with the number of windows they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = shared.value
        trainer, seen = Trainer(flat), 0
        for batch in larger(batches, 0, GATHER):
            words, at, lengths = tokens(batch.column(0))
            if not len(words):
                continue
            ids = known.codes(words)[0][at]
            windows = Windows(ids, lengths)
            seen += len(ids)
            for i in range(0, len(ids), STEP):
                trainer.step(windows.of(slice(i, i + STEP)), ids[i : i + STEP])
        if seen:
            part, chunks = TaskContext.get().partitionId() // FAN, range(0, _SIZE, CHUNK)
            columns = [pa.array([i // CHUNK for i in chunks], pa.int32()), pa.array([part] * len(chunks), pa.int32()), pa.array([seen] * len(chunks), pa.int64()), pa.array([trainer.flat[i : i + CHUNK].tobytes() for i in chunks], pa.binary())]
            yield pa.record_batch(columns, names=["chunk", "part", "seen", "weights"])

    return run


def _average(rows: pa.Table) -> pa.Table:
    """The mean of one chunk's messages, weighted by windows."""
    total, seen = 0.0, rows["seen"].to_numpy().astype(np.float64)
    for n, raw in zip(seen, rows["weights"], strict=True):
        total = total + n * np.frombuffer(raw.as_py(), dtype=np.float32).astype(np.float64)
    mean = (total / seen.sum()).astype(np.float32).tobytes()
    return pa.table({"chunk": [rows["chunk"][0].as_py()], "part": [rows["part"][0].as_py()], "seen": [int(seen.sum())], "weights": [mean]}, schema=pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("seen", pa.int64()), ("weights", pa.binary())]))


_MESSAGE = "chunk int, part int, seen long, weights binary"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in larger(batches, 0, 4 * GATHER):
        words, at, _ = tokens(batch.column(0))
        if len(words):
            yield pa.record_batch([words, pa.array(hashes(words).view(np.int64)), pa.array(np.bincount(at, minlength=len(words)), pa.int64())], names=["word", "hash", "n"])


def _slice(places: int):
    """A slice of the table of counts, from its places' sums of counts and numbers of words."""

    def run(rows: pa.Table) -> pa.Table:
        width = places // SLICES
        out = np.zeros(width, dtype=np.uint8)
        mean = rows["n"].to_numpy() / rows["types"].to_numpy()
        out[rows["place"].to_numpy() % width] = np.clip(np.rint(FINE * np.log2(mean)), 0, 255)
        return pa.table({"slice": pa.array([int(rows["slice"][0].as_py())], pa.int64()), "bytes": pa.array([out.tobytes()], pa.binary())})

    return run


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The corpus's words, counted over all texts; ties in order.

    The driver gets the WORDS most frequent ones and a table of counts whose
    size follows the number of kinds of words, up to PLACES_MOST bytes. Beyond,
    words that share a place share the mean of their counts.
    """
    counts = docs.select("text").mapInArrow(_counts, "word string, hash long, n long").groupBy("word", "hash").agg(F.sum("n").alias("n"))
    counts = stash(counts, "lm-words")
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    facts = counts.agg(F.count("*").alias("types"), F.sum("n").alias("n")).first()
    places = PLACES_LEAST
    while places < min(PLACES_MOST, 16 * facts["types"]):
        places *= 2
    place = F.shiftrightunsigned("hash", 20) % places
    last, n = (top[-1]["word"], top[-1]["n"]) if len(top) == WORDS else ("", 0)  # with fewer kinds of words, all are frequent
    others = counts.filter((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > last)))
    sums = others.groupBy(place.alias("place")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    pieces = sums.withColumn("slice", F.floor(F.col("place") / (places // SLICES))).groupBy("slice").applyInArrow(_slice(places), "slice long, bytes binary").collect()
    table = np.zeros(places, dtype=np.uint8)
    for r in pieces:
        table[r["slice"] * (places // SLICES) :][: places // SLICES] = np.frombuffer(r["bytes"], dtype=np.uint8)
    named = np.array([r["n"] for r in top], dtype=np.float64)
    return Vocabulary([r["word"] for r in top], named, table, float((facts["n"] or 0) - named.sum()))


def train(docs: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the network's parameters, learned from every word of ``docs``.

    In each round every partition trains a copy on all its words, and the
    copies are averaged by the windows they saw, in two levels; what moves
    grows with the partitions, what reaches the driver is one model of 1.4 MB
    and a vocabulary of bounded size.
    """
    spark = docs.sparkSession
    known = vocabulary(docs)
    flat = start(known)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((known, flat))
        sent = docs.select("text").mapInArrow(_learn(shared), _MESSAGE)
        means = sent.groupBy("chunk", "part").applyInArrow(_average, _MESSAGE).groupBy("chunk").applyInArrow(_average, _MESSAGE)
        got = {r["chunk"]: np.frombuffer(r["weights"], dtype=np.float32) for r in means.collect()}
        if got:
            flat = np.concatenate([got[i] for i in sorted(got)])
    return known, flat


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Scores every whole text of ``docs(doc_id, text)`` by its masked pseudo-likelihood.

    Each word is masked in turn and predicted from SIDE words on either side.
    ``pll`` is the sum of the logs of the words' conditional probabilities: the
    network's for its WORDS most frequent words and for all others together,
    times, for one of these, its share of them by its count. ``network_pll``
    leaves those shares out. Words are in lower case, between white space.

    Null, empty and blank texts: no tokens, score 0, no mean. Null or repeated
    doc_id: scored row by row. Other columns are not looked at; an empty table
    gives an empty result.

    Returns ``doc_id, n_tokens, pll, pll_per_token, network_pll``.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = shared.value
        net = unpack(flat)
        for batch in larger(batches, 1, GATHER):
            words, at, lengths = tokens(batch.column(1))
            codes, share = known.codes(words)
            ids = codes[at]
            windows = Windows(ids, lengths)
            logs = [log_probabilities(net, windows.of(slice(i, i + BLOCK)), ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
            logs = np.concatenate(logs).astype(np.float64) if logs else np.zeros(0)
            own = np.repeat(np.arange(len(lengths)), lengths)
            network, whole = (np.bincount(own, x, len(lengths)) for x in (logs, logs + share[at]))
            mean = pa.array(whole / np.maximum(lengths, 1), pa.float64(), mask=lengths == 0)
            yield pa.record_batch([batch.column(0), pa.array(lengths, pa.int64()), pa.array(whole, pa.float64()), mean, pa.array(network, pa.float64())], names=["doc_id", "n_tokens", "pll", "pll_per_token", "network_pll"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, pll double, pll_per_token double, network_pll double")
