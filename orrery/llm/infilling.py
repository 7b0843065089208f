"""Fill-in-middle: a rope over each text is split at two token ranks and its parts are joined again in another order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from orrery.llm.common import fresh, ready, settle, settled

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents in a hundred that are rearranged, and of these the ones in a hundred that begin with the suffix.
RATE, SPM = 50, 80
#: Units of a leaf, and code points looked at together when a text is cut into leaves.
LEAF_UNITS, BLOCK = 128, 1 << 20

#: A unit begins at the text's start and wherever white space follows something else.
_START = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")


@dataclass(frozen=True, slots=True)
class Rope:
    """A text as a tree: a leaf has a piece of whole units, an inner node two children; both cache their units and code points."""

    units: int
    chars: int
    piece: str = ""
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0)


def joined(left: Rope, right: Rope) -> Rope:
    """A rope of two others, which are shared and not copied."""
    if not left.chars or not right.chars:
        return left if left.chars else right
    return Rope(left.units + right.units, left.chars + right.chars, "", left, right)


def balanced(ropes: list[Rope]) -> Rope:
    """Joins neighbours until one rope is left, so that its height is the logarithm of their number."""
    while len(ropes) > 1:
        ropes = [joined(*ropes[i : i + 2]) if i + 1 < len(ropes) else ropes[i] for i in range(0, len(ropes), 2)]
    return ropes[0] if ropes else EMPTY


def rope(text: str) -> Rope:
    """The rope of a text: leaves end where a unit ends, and a unit is never cut."""
    starts, before = [np.zeros(1, dtype=np.int64)], True
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le"), dtype=np.uint32)
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        starts.append(np.flatnonzero(space & ~np.concatenate([[before], space[:-1]])) + at)
        before = bool(space[-1])
    if not text:
        return EMPTY
    units = np.concatenate(starts)
    cuts = [*units[::LEAF_UNITS].tolist(), len(text)]
    counts = [*[LEAF_UNITS] * (len(cuts) - 2), len(units) - LEAF_UNITS * (len(cuts) - 2)]
    return balanced([Rope(n, b - a, text[a:b]) for n, a, b in zip(counts, cuts, cuts[1:], strict=False)])


def split(tree: Rope, units: int) -> tuple[Rope, Rope]:
    """The first ``units`` units of a rope and the rest: one way down the tree, and one leaf that is cut."""
    if units <= 0:
        return EMPTY, tree
    if units >= tree.units:
        return tree, EMPTY
    if tree.left is None:
        cut = [m.start() for m in _START.finditer(tree.piece)][units - 1]
        return Rope(units, cut, tree.piece[:cut]), Rope(tree.units - units, tree.chars - cut, tree.piece[cut:])
    if units < tree.left.units:
        a, b = split(tree.left, units)
        return a, joined(b, tree.right)
    a, b = split(tree.right, units - tree.left.units)
    return joined(tree.left, a), b


def split_chars(tree: Rope, chars: int) -> tuple[Rope, Rope]:
    """The first ``chars`` code points of a rope and the rest; what is left of a cut unit counts as one on either side."""
    if chars <= 0:
        return EMPTY, tree
    if chars >= tree.chars:
        return tree, EMPTY
    if tree.left is None:
        pieces = tree.piece[:chars], tree.piece[chars:]
        return tuple(Rope(1 + len(_START.findall(p)), len(p), p) for p in pieces)
    if chars < tree.left.chars:
        a, b = split_chars(tree.left, chars)
        return a, joined(b, tree.right)
    a, b = split_chars(tree.right, chars - tree.left.chars)
    return joined(tree.left, a), b


def pieces(tree: Rope) -> Iterator[str]:
    """The leaves' pieces in order."""
    todo = [tree]
    while todo:
        node = todo.pop()
        if node.left is None:
            yield node.piece
        else:
            todo += [node.right, node.left]


def mark(text: str) -> Rope:
    return Rope(1, len(text), text)


def rearranged(tree: Rope, first: int, second: int, form: str) -> tuple[Rope, int, int]:
    """The rope with its middle, from unit ``first`` to ``second``, at the end, and the code points of prefix and middle."""
    head, suffix = split(tree, second)
    prefix, middle = split(head, first)
    if form == "psm":
        parts = [mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle]
    else:
        parts = [mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle]
    return balanced([p for p in parts if p.chars]), prefix.chars, middle.chars


def original(output: str, form: str) -> str:
    """The text that an output of a form was made from: its rope is split before and behind each mark."""
    if form == "plain":
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    rest, parts = rope(output), {}
    for m in reversed(order):  # from behind, so that the places before stay as they are
        rest, tail = split_chars(rest, output.index(m))
        parts[m] = split_chars(tail, len(m))[1]
    return "".join(pieces(balanced([p for p in (parts[PREFIX], parts[MIDDLE], parts[SUFFIX]) if p.chars])))


def draws(seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first groups of a hash of the seed and doc_id (null: no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with the text of each rearranged for filling in the middle.

    A text of n units (a run of white space with what follows it, or one at the
    text's end) is cut at two ranks between 0 and n; the middle goes to the end,
    behind prefix and suffix (``psm``) or suffix and prefix (``spm``). ``rate``
    in a hundred texts are rearranged, ``spm`` in a hundred of these begin with
    the suffix, and a hash of ``seed`` and doc_id decides. A text that is null
    (it counts as empty) or empty or has a mark in it stays ``plain``.

    Null doc_id: draws as for an id without digits; rows of one doc_id have the
    same draws. A text of one unit, however long, has an empty prefix, middle or
    suffix. All columns stay; an empty table gives an empty result.

    Adds ``units, form, output, prefix_chars, middle_chars`` (the last two null
    where plain), each with an underscore more where ``docs`` has a column of
    that name; :func:`added` tells the names.
    """
    ready(docs.sparkSession)
    names = added(docs)
    text, *chance = fresh(docs, "_text", "_h1", "_h2", "_h3", "_h4")
    rows = docs.withColumns({text: F.coalesce("text", F.lit("")), **dict(zip(chance, draws(seed), strict=True))})
    schema = StructType([*docs.schema.fields])
    for name, kind in zip(names, (LongType(), StringType(), StringType(), LongType(), LongType()), strict=True):
        schema = schema.add(name, kind)

    def one(t: str, h: tuple[int, ...]) -> tuple:
        tree = rope(t)
        if not t or any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
            return tree.units, "plain", t, None, None
        form = "spm" if h[3] % 100 < spm else "psm"
        out, prefix, middle = rearranged(tree, *sorted(x % (tree.units + 1) for x in h[:2]), form)
        return tree.units, form, "".join(pieces(out)), prefix, middle

    given_names, n = docs.columns, len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(k).to_pylist() for k in range(n, n + 5)]
            made = list(zip(*(one(t, h) for t, *h in zip(*given, strict=True)), strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([*batch.columns[:n], *(pa.array(m, k) for m, k in zip(made, kinds, strict=True))], names=[*given_names, *names])

    return rows.select(*(F.col(f"`{c}`") for c in (*docs.columns, text, *chance))).mapInArrow(settled(run), schema)


def added(docs: DataFrame) -> list[str]:
    """The names of the columns that :func:`fill_in_middle` adds to ``docs``."""
    return fresh(docs, "units", "form", "output", "prefix_chars", "middle_chars")


def restored(output: str, form: str) -> Column:
    """The texts that outputs of :func:`fill_in_middle` were made from, by the columns of output and form alone."""

    @F.pandas_udf("string")
    def back(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        settle()
        for outputs, forms in parts:
            yield pd.Series([original(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)
        settle()

    return back(output, form)
