"""Pattern packing: few-document length patterns fitted to the length histogram by non-negative least squares."""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm.bpe import byte_chars
from orrery.llm.common import gapless_rank, kept, larger, ready, settled
from orrery.storage import stash

VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker remembers (when there are so many, those not met again are forgotten), and bytes
#: of text encoded at a time. Both can be given smaller where a worker has less memory; ids stay the same.
MEMO, BATCH_BYTES = 500_000, 6_000_000
#: Steps of the least-squares fit.
STEPS = 300

#: A word that ends in one full stop or comma after a digit or a Latin letter that is one letter in lower
#: case and in composed form too (the dotted capital I is not): the split pattern cuts there.
_TAILED = r"(?s)^.*[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}][.,]$"


class WordIds:
    """Ids of whole texts from those of their words, each encoded once and remembered.

    The vocabulary lower-cases, drops white space, and its split pattern never
    takes any, so a text's ids are those of its words one after the other.
    Arrow's hash tables tell words apart, so Python sees the distinct words of a
    batch only; words of letters only skip the tokenizer's normaliser and go to
    its merges in bulk.
    """

    def __init__(self, state: str, memo: int = MEMO, words: int = BATCH_BYTES // 12):
        self.most, self.words = memo, words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(state)
        bare = json.loads(state) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.merges = Tokenizer.from_str(json.dumps(bare))
        chars = byte_chars()
        self.shown = {b: chars[b] for b in range(256) if chars[b] != chr(b) and b > 32}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, without an end mark."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        raw = coded.dictionary
        # what could be part of a special token is left alone; it would not be one in lower case
        special = pc.match_substring(raw, "<")
        tailed = pc.and_not(pc.match_substring_regex(raw, _TAILED), special)
        base = pc.if_else(special, raw, pc.ascii_lower(raw))
        base = pc.if_else(tailed, pc.utf8_slice_codeunits(base, 0, -1), base).dictionary_encode()
        entries = [*self._entries(base.dictionary.to_pylist()), *self._entries([".", ","]), b""]
        n = len(entries)
        tail = np.where(tailed.to_numpy(zero_copy_only=False), np.where(pc.ends_with(raw, ".").to_numpy(zero_copy_only=False), n - 3, n - 2), n - 1)
        index = coded.indices.to_numpy()
        parts = np.stack([base.indices.to_numpy()[index], tail[index]], axis=1).ravel() if len(index) else np.zeros(0, np.int64)

        size = np.fromiter(map(len, entries), dtype=np.int64, count=n) // 4
        store, first, out = np.frombuffer(b"".join(entries), dtype="<u4"), np.cumsum(size) - size, []
        for i in range(0, len(parts), self.words):
            at = parts[i : i + self.words]
            m = size[at]
            out.append(store[np.repeat(first[at] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))])
        ids = np.concatenate(out) if out else store[:0]
        ends = np.concatenate([[0], np.cumsum(size[parts])])[2 * (words.offsets.to_numpy() - words.offsets[0].as_py())]
        return [ids[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def _entries(self, words: list[str]) -> list[bytes]:
        if len(self.memo) > self.most:
            self.memo, self.old = {}, self.memo
        found = list(map(self.memo.get, words))
        new = []
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                if (ids := self.old.get(word)) is None:
                    new.append(word)
                else:
                    found[i] = self.memo[word] = ids
        if new:
            self._add(new)
            found = list(map(self.memo.get, words))
        return found

    def _add(self, words: list[str]) -> None:
        plain, rest = [], []
        for w in words:
            (plain if w.isalpha() and (w.isascii() or _composed(w)) else rest).append(w)
        for i in range(0, len(plain), 4000):
            if not self._add_plain(plain[i : i + 4000]):
                rest += plain[i : i + 4000]
        for word, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.memo[word] = np.array(got.ids, dtype="<u4").tobytes()

    def _add_plain(self, words: list[str]) -> bool:
        """Words of letters only in one call: each is one run of the pattern, so its last token alone has the word-end mark."""
        text = " ".join(words)
        text = text.lower() if text.isascii() else text.lower().encode().decode("latin-1").translate(self.shown)
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(words):
            return False
        raw, at = ids.tobytes(), 0
        for word, end in zip(words, ends.tolist(), strict=True):
            self.memo[word] = raw[at:end]
            at = end
        return True


def _composed(word: str) -> bool:
    """Whether lower-casing letter by letter leaves letters in composed form, as the normaliser's own result would be."""
    low = word.lower()
    return "\u03a3" not in word and low.isalpha() and unicodedata.is_normalized("NFC", word)


def _held(state: str, memo: int, words: int) -> WordIds:
    """A worker's encoder; one is kept for the tasks that follow."""
    return kept(("packing", zlib.crc32(f"{memo} {words} {state}".encode())), lambda: WordIds(state, memo, words))


def _pieces(state, most: int, end: int, memo: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _held(state.value, memo, size // 12)
        mark = np.array([end], dtype="<u4").tobytes()
        for batch in larger(batches, 1, size):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode(batch.column(1))):
                ids += mark
                for k, at in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[at : at + 4 * most]
                    for column, value in ((row, i), (piece, k), (start, at // 4), (length, len(part) // 4), (crc, zlib.crc32(part))):
                        column.append(value)
            columns = [pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int32())), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def patterns_of(most: int) -> np.ndarray:
    """All ways to fill a sequence of ``most`` tokens with one, two or three lengths, the largest first; 0 fills up."""
    out = [np.array([[most, 0, 0]])]
    if most > 1:
        low = np.arange(1, most // 2 + 1)
        out.append(np.stack([most - low, low, 0 * low], axis=1))
    for least in range(1, most // 3 + 1):
        mid = np.arange(least, (most - least) // 2 + 1)
        out.append(np.stack([most - least - mid, mid, np.full_like(mid, least)], axis=1))
    return np.concatenate(out)


def fit(histogram: np.ndarray, patterns: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring A x near the histogram in the least-squares sense.

    A has at most three entries a column, so products with it are gathers and
    bin counts. Accelerated projected gradient descent with restarts.
    """
    size = len(histogram)
    part = patterns
    goal = histogram.astype(np.float64).copy()
    goal[0] = 0

    def times(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(part[:, k], x, size) for k in range(3))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[part[:, 0]] + r[part[:, 1]] + r[part[:, 2]]

    probe = np.ones(len(part)) / np.sqrt(len(part))
    for _ in range(12):  # the largest eigenvalue of A'A, for the step
        probe = back(times(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    step = 1 / (1.05 * norm)
    x = np.zeros(len(part))
    y, pace, last = x, 1.0, np.inf
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(times(y) - goal))
        loss = float(((times(new) - goal) ** 2).sum())
        pace_new = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        if loss > last:
            y, pace = x, 1.0
            last = np.inf
            continue
        y, pace = new + (pace - 1) / pace_new * (new - x), pace_new
        x, last = new, loss
        if loss < 0.25:
            break
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and repeat counts that use up a histogram (index: length) exactly.

    Full pieces stand alone. Fitted patterns are rounded and taken, largest
    count first, as far as the lengths last; what is left is packed
    best-fit-decreasing in bulk: a length at a time goes to the open sequences
    with the least room that takes it.
    """
    most = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left[most]:
        out.append(((most,), int(left[most])))
        left[most] = 0
    if left.any():
        patterns = patterns_of(most)
        known = (left[patterns] > 0) | (patterns == 0)
        patterns = patterns[known.all(axis=1)]
        if len(patterns):
            x = fit(left, patterns)
            for i in np.argsort(-x, kind="stable"):
                times = int(round(x[i]))
                if times < 1:
                    break
                lengths = [int(v) for v in patterns[i] if v]
                need = {v: lengths.count(v) for v in lengths}
                times = min([times, *(int(left[v]) // c for v, c in need.items())])
                if times:
                    out.append((tuple(lengths), times))
                    for v, c in need.items():
                        left[v] -= c * times
    return out + _best_fit(left)


def _best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    most = len(left) - 1
    rooms: list[int] = []  # sorted room sizes that open sequences have
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [[lengths, count]]
    out: list[tuple[tuple[int, ...], int]] = []
    for length in range(most, 0, -1):
        todo = int(left[length])
        while todo:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fits = most // length  # new sequences, each filled with this length as often as it goes
                whole, rest = divmod(todo, fits)
                for times, each in ((whole, fits), (1 if rest else 0, rest)):
                    if times:
                        _open(rooms, open_, out, most - each * length, (length,) * each, times)
                todo = 0
                continue
            room = rooms[at]
            lengths, count = open_[room][-1]
            each = min(room // length, todo)
            take = min(count, todo // each)
            open_[room][-1][1] -= take
            if not open_[room][-1][1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            _open(rooms, open_, out, room - each * length, (*lengths, *(length,) * each), take)
            todo -= take * each
    return out + [(tuple(p), c) for some in open_.values() for p, c in some]


def _open(rooms: list[int], open_: dict[int, list[list]], out: list, room: int, lengths: tuple[int, ...], times: int) -> None:
    if not room:
        out.append((lengths, times))
        return
    if room not in open_:
        insort(rooms, room)
    open_[room].append([lengths, times])


def segments(packed: list[tuple[tuple[int, ...], int]], most: int) -> dict[str, np.ndarray]:
    """For each length, which ranks of its pieces go to which run of sequences at which offset, sorted by length and rank."""
    rows, used, base = [], np.zeros(most + 1, dtype=np.int64), 0
    for lengths, times in packed:
        offset = 0
        for v in lengths:
            rows.append((v, int(used[v]), base, offset))
            used[v] += times
            offset += v
        base += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


def pack_documents(docs: DataFrame, most: int = 2048, path: str | None = None, end: int = 0, memo: int = MEMO, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Packs the tokens of all rows of ``docs(doc_id, text)`` into few sequences of at most ``most`` tokens.

    A document is its text's ids and then ``end``; longer ones are cut into
    pieces of ``most``, the last may be shorter. The driver sees the histogram of
    piece lengths only (``most`` numbers) and makes a plan of patterns with
    repeat counts; the pieces of each length are then numbered, and a piece's
    number names its place. The plan's table is bounded by the number of patterns
    (some 350,000 at 2048), whatever the input.

    Null text: empty, so its one piece is ``end``. Null or repeated doc_id: kept
    as separate documents. Other columns are not looked at; an empty table gives
    an empty result.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    spark = docs.sparkSession
    ready(spark)
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        state = spark.sparkContext.broadcast(f.read())
    cut = docs.select("doc_id", "text").mapInArrow(settled(_pieces(state, most, end, memo, batch_bytes), own=True), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = stash(cut, "pack-pieces")
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    histogram = np.zeros(most + 1, dtype=np.int64)
    for r in counts:
        histogram[r["length"]] = r["n"]
    where = spark.sparkContext.broadcast(segments(plan(histogram), most))
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    ranked = gapless_rank(pieces, ["length"], F.xxhash64("doc_id", "piece", "ids_crc32"), order, int(histogram.sum()), "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = where.value
        width = int(at["rank"].max(initial=0)) + 1
        keys = at["length"] * width + at["rank"]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            i = np.searchsorted(keys, length * width + np.minimum(rank, width - 1), side="right") - 1
            sequence = at["base"][i] + rank - at["rank"][i]
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(at["offset"][i])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return ranked.mapInArrow(settled(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
