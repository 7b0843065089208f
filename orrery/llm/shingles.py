"""Sets of word shingles as sorted 64-bit hashes, without a loop over words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_CODE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes of a text worked on at a time; windows over the cuts are not lost.
SLICE = 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _series(base: int, size: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64."""
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSE = _series(_STEP, 2 * SLICE), _series(_BACK, 2 * SLICE)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(raw: bytes, width: int) -> Iterator[list[bytes]]:
    """The words of a text in runs of about SLICE bytes, each with the last ``width - 1`` words before it."""
    begin, before = 0, []
    while begin < len(raw):
        cut = _SPACE.search(raw, begin + SLICE)
        end = cut.start() if cut else len(raw)
        words = before + raw[begin:end].lower().split()
        begin = end
        if len(words) >= width or begin >= len(raw):
            yield words
            before = words[len(words) - width + 1 :]
        else:
            before = words


def _windows(words: list[bytes], width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, or of all words where they are fewer."""
    text = np.frombuffer(b" ".join(words), dtype=np.uint8)
    gaps = np.flatnonzero(text == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(text)]])
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    powers, inverse = (_POWERS, _INVERSE) if len(text) < len(_POWERS) else (_series(_STEP, len(text) + 1), _series(_BACK, len(text) + 1))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum(_CODE[text] * powers[: len(text)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_set(raw: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words of a UTF-8 text.

    A-Z are lower-cased and words are runs of anything but ASCII white space; a
    text of fewer words is one shingle, one without words has none. The words
    of a shingle count as joined by one space. A prefix sum of byte codes times
    powers of an odd number gives every window's hash at once; it is worked out
    slice by slice, so a very long text takes the memory of its set.
    """
    parts, many = [], False
    for words in _slices(raw or b"", width):
        if words and (len(words) >= width or not many):
            parts.append(_windows(words, width))
        many = many or len(words) >= width
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(np.concatenate(parts))


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string of an array without nulls, as that of a window of words."""
    size = len(words)
    if not size:
        return np.zeros(0, dtype=np.uint64)
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + size + 1]
    text = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    out = np.zeros(size, dtype=np.uint64)
    begin = 0
    while begin < size:
        stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + SLICE, side="right")) - 1)
        part, at = text[ends[begin] : ends[stop]], ends[begin : stop + 1] - ends[begin]
        powers, inverse = (_POWERS, _INVERSE) if len(part) < len(_POWERS) else (_series(_STEP, len(part) + 1), _series(_BACK, len(part) + 1))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_CODE[part] * powers[: len(part)], out=sums[1:])
            out[begin:stop] = mix((sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]])
        begin = stop
    return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
