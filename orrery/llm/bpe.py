"""Byte-level BPE over Arrow batches: ids, offsets, and the way back to bytes."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from orrery.llm.common import kept, ready, settled

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces of text that a worker remembers the encoding of; forgotten together when full.
MEMO = 400_000
#: Ids sent on at a time.
SENT = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks, as the rank files have them."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(maxsize=1)
def byte_chars() -> tuple[str, ...]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves; the other bytes, in order,
    for the characters from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return tuple(chr(b) if b in plain else chr(next(others)) for b in range(256))


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token longer than a byte, in order of rank.

    A token's merge joins the two parts that are left when its bytes are merged
    by all lower ranks.
    """
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteCodec:
    """Encoder and decoder for one rank table.

    ``state`` is plain data, so that a task can build its own codec from what
    the driver has read; no executor opens the vocabulary file.
    """

    def __init__(self, state: str):
        chars = byte_chars()
        known = json.loads(state)
        back = {c: b for b, c in enumerate(chars)}
        tokens = [b""] * (max(known["vocab"].values()) + 1)
        for token, i in known["vocab"].items():
            tokens[i] = bytes(back[c] for c in token)
        self.table = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int32)
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        self.tokenizer = Tokenizer(models.BPE(vocab=known["vocab"], merges=[tuple(m) for m in known["merges"]]))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(known["pattern"]), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def state(path: str, pattern: str) -> str:
        ranks, chars = read_ranks(path), byte_chars()
        shown = lambda token: "".join(chars[b] for b in token)
        return json.dumps({"vocab": {shown(t): r for t, r in ranks.items()}, "merges": [[shown(a), shown(b)] for a, b in merges_of(ranks)], "pattern": pattern})

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text.

        The text is cut where the pattern cuts in any case; the tokenizers
        library encodes each piece once, and a bounded memo keeps its ids.
        """
        pieces, memo = cut(text), self.memo
        if len(memo) > MEMO:
            memo.clear()
        if new := list({p for p in pieces if p not in memo}):
            for piece, got in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                memo[piece] = array("i", got.ids).tobytes()
        return np.frombuffer(b"".join([memo[p] for p in pieces]), dtype=np.int32)

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters [start, end) that each id touches; ids that split a character all have that character's."""
        ends = np.cumsum(self.lengths[ids], dtype=np.int32)
        starts = ends - self.lengths[ids]
        if text.isascii():
            return starts, ends
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - 1  # of each byte
        return char[starts], char[ends - 1] + 1

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, by the reversed byte table; a character split over several ids is whole once its last byte is there."""
        many = self.lengths[ids]
        ends = np.cumsum(many)
        return self.table[np.repeat(self.starts[ids] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


def cut(text: str) -> list[str]:
    """Pieces whose encodings, put together, are that of the text.

    A cut before a lone space between two characters that are no white space
    is always a cut of the split pattern too: only its white space alternatives
    take a space after the first character, and these take nothing else.
    """
    if not text:
        return []
    parts = text.split(" ")
    out = [parts[0]]
    safe = bool(parts[0]) and not parts[0][-1].isspace()
    for p in parts[1:]:
        if safe and p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
        safe = bool(p) and not p[-1].isspace()
    return out


def _codec(state: str) -> ByteCodec:
    """A worker's codec; one is kept for the tasks that follow."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return kept(("bpe", hashlib.sha256(state.encode()).hexdigest()), lambda: ByteCodec(state))


def _state(spark, path: str, pattern: str):
    return spark.sparkContext.broadcast(ByteCodec.state(path, pattern))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Token ids of every whole text of ``docs(doc_id, text)`` with character offsets and decoded bytes.

    The vocabulary (a rank file read on the driver; a few MB, broadcast) is
    turned into merges for the tokenizers library, which encodes each match of
    ``pattern`` separately and knows no special tokens: their names in a text
    are ordinary text. Null text: no tokens. Null or repeated doc_id: kept as
    it is. An empty table gives an empty result.

    Returns ``doc_id, ids, starts, ends, decoded``.
    """
    ready(docs.sparkSession)
    state = _state(docs.sparkSession, path or public_tokenizers.path(RANKS), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(state.value)
        for batch in batches:
            begin, rows, held = 0, [], 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                ids = codec.encode(text)
                rows.append((ids, *codec.offsets(text, ids), codec.decode(ids)))
                held += len(ids)
                if held >= SENT or i == batch.num_rows - 1:  # ids and offsets take many times the text's size
                    ends = np.cumsum([0, *(len(r[0]) for r in rows)]).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(ends, np.concatenate([r[k] for r in rows])) for k in range(3)]
                    yield pa.record_batch([batch.column(0).slice(begin, len(rows)), *lists, pa.array([r[3] for r in rows], pa.binary())], names=["doc_id", "ids", "starts", "ends", "decoded"])
                    begin, rows, held = i + 1, [], 0

    return docs.select("doc_id", "text").mapInArrow(settled(run, own=True), "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded binary")


def encoding_digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of :func:`encode_documents`' ids and decoded bytes."""
    shown = F.array_join(F.col("ids").cast("array<string>"), " ")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return encode_documents(docs, path, pattern).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(shown).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))
