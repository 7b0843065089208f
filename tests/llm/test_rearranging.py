"""Toxicity, fill-in-middle and the prefix trie against plain versions of them, with odd rows in every table."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import infilling, prefix_trie, queries, toxicity
from orrery.llm.common import id_mod

DATA = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " "), (4, "one"), (5, " a  b\t\nc "), (6, "has <P> in it"), (7, "<M"), (8, "word " * 60_000), (9, "x" * 300_000), (9, "é😀 日本 naïve  Ünï" * 50), (9, "é😀 日本 naïve  Ünï" * 50), (None, "no id at all here"), (None, None), *((i, f"text {i} of <S no mark > P> number {i}") for i in range(20, 60))]


# fill-in-middle


def plain_infilling(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", text, None, None
    a, b = sorted(x % (n + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def test_fill_in_middle(spark):
    docs = spark.createDataFrame([(i, t, "mine", 0.5) for i, t in ODD], "doc_id long, text string, form string, Units double")
    assert infilling.added(docs) == ["units_", "form_", "output", "prefix_chars", "middle_chars"]
    for rate in (50, 100):
        made = infilling.fill_in_middle(docs, rate=rate)
        rows = made.withColumn("back", infilling.restored("output", "form_")).collect()
        got = Counter((r.doc_id, r.text, r.units_, r.form_, r.output, r.prefix_chars, r.middle_chars) for r in rows)
        assert got == Counter((i, t, *plain_infilling(i, t, rate=rate)) for i, t in ODD)
        assert all(r.back == (r.text or "") and r.form == "mine" for r in rows)
        assert rate < 100 or {r.form_ for r in rows} == {"plain", "psm", "spm"}
    assert infilling.fill_in_middle(docs.limit(0)).count() == 0


@given(st.text(alphabet=" \t\nab<PSM>é😀", max_size=900), st.integers(0, 1 << 32), st.integers(0, 1 << 32), st.sampled_from(["psm", "spm"]))
@settings(max_examples=200, deadline=None)
def test_ropes_split_and_join(text, x, y, form):
    tree = infilling.rope(text)
    units = UNIT.findall(text)
    assert "".join(infilling.pieces(tree)) == text and (tree.units, tree.chars) == (len(units), len(text))
    a, b = sorted((x % (len(units) + 1), y % (len(units) + 1)))
    left, right = infilling.split(tree, a)
    assert "".join(infilling.pieces(left)) == "".join(units[:a]) and left.chars + right.chars == len(text)
    cut = x % (len(text) + 1)
    assert ["".join(infilling.pieces(p)) for p in infilling.split_chars(tree, cut)] == [text[:cut], text[cut:]]
    if text and not any(m in text for m in ("<P>", "<S>", "<M>")):
        out, prefix, middle = infilling.rearranged(tree, a, b, form)
        assert (prefix, middle) == (len("".join(units[:a])), len("".join(units[a:b])))
        assert infilling.original("".join(infilling.pieces(out)), form) == text


def test_leaves_hold_whole_units_over_blocks(monkeypatch):
    monkeypatch.setattr(infilling, "BLOCK", 7)
    text = "ab  cd\te" * 400 + "   "
    tree = infilling.rope(text)
    assert tree.units == len(UNIT.findall(text)) and "".join(infilling.pieces(tree)) == text


# prefix trie


def plain_trie(rows):
    """A row for each node, by listing every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [(t[3], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole = own.get(base, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    children = Counter(node[:-1] for node in members if node)
    saved, leaves = Counter(), Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
            leaves[node[:d]] += not children[node]
    return Counter(
        (min(who)[0], len(node), min(members[node[:-1]])[0] if node else None, len(who), children[node], leaves[node], saved[node], hashlib.sha256(",".join(str(c) for c, end in sorted(who) if end).encode()).hexdigest())
        for node, who in members.items()
    )


def conversations(seed: int, longest: int):
    rng = np.random.default_rng(seed)
    rows = [(None, 0, "user", "no id"), (7, None, None, None), (7, 1, "user", "same"), (7, 1, "user", "same"), (7, 1, "tool", "same"), (-205, 0, "user", "below"), (-200, 0, "user", "zero"), (-200, 1, "user", "below")]
    for c in [*range(100, 130), *range(205, 240), 300, 301, 20_000, 20_001, 3_000_000_000]:
        for t in range(rng.integers(1, longest + 1)):
            rows.append((c, t, "user" if t % 2 else "assistant", f"t{t}" if rng.random() < 0.9 else f"other {rng.integers(3)}"))
    return rows


@pytest.mark.parametrize(("longest", "segment"), [(8, 512), (40, 6)])
def test_prefix_trie(spark, longest, segment):
    rows = conversations(3, longest)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = prefix_trie.prefix_trie(frame, segment).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert Counter(map(tuple, got)) == plain_trie(rows)
    assert prefix_trie.prefix_trie(frame.limit(0)).count() == 0


def test_conversation_without_turns(spark):
    """Ids without a base keep only what lies behind their first turns, which may be nothing."""
    rows = [(c, 0, "user", "hi") for c in range(501, 512)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, prefix_trie.prefix_trie(frame).collect())) == plain_trie(rows)


# toxicity


def plain_places(text):
    """The distinct n-grams of a text as strings."""
    low = (text or "").lower()
    low = re.sub(r" +", " ", "".join(" " if ord(c) < 128 and not c.isalnum() else c for c in f" {low} "))
    return {low[i : i + n] for n in toxicity.GRAMS for i in range(len(low) - n + 1)} if text else set()


@pytest.mark.parametrize("block", [1 << 18, 16])
def test_ngrams_are_those_of_the_whole_text(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    seen = np.zeros(toxicity.PLACES, dtype=bool)
    for text in (None, "", "a", "Some   text, with!! MARKS\tand" + "  ..  " * 9 + "数字 12 naïve" * 3, "x"):
        assert len(toxicity.places(text, seen)) == len(plain_places(text))
        assert not seen.any()


def test_dual_ascent_finds_the_optimum():
    """At the weights found, the gradient of penalty and losses is next to nothing."""
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i)}{chr(97 + i)}" for i in range(12)]
    rows = [(" ".join(rng.choice(words, 4)), 0) for _ in range(60)] + [(" ".join([*rng.choice(words, 3), "grumpf"]), 1) for _ in range(20)]
    model = toxicity.train(rows, passes=300)
    seen = np.zeros(toxicity.PLACES, dtype=bool)
    found = [toxicity.places(t, seen) for t, _ in rows]
    labels = np.array([y for _, y in rows])
    scale = toxicity.ratios(found, labels)
    found = [at[scale[at] != 0] for at in found]
    w = np.divide(model.weights, scale, out=np.zeros(toxicity.PLACES), where=scale != 0)
    gradient = w.copy()
    for at, y in zip(found, labels, strict=True):
        sign = 1 if y else -1
        p = 1 / (1 + np.exp(sign * (w[at] @ scale[at] + model.bias)))
        gradient[at] -= toxicity.COST / len(rows) * sign * p * scale[at]
    assert np.abs(gradient).max() < 1e-3 and np.abs(w).max() > 0.1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(id_mod("doc_id", 3) == 1, F.lit(False))
    known = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter("toxic is not null")
    got = toxicity.toxicity_scores(known.select("doc_id", "text"), labels, held).join(known.select("doc_id", "text", "toxic"), "doc_id").filter("held_out").collect()
    words = re.compile(r"\b(idiot|clown|loser|moron|scum|trash|worthless|pathetic|disgusting|stupid)\b", re.IGNORECASE)
    rude = [r for r in got if words.search(r.text or "")]
    assert len(rude) > 50 and np.mean([r.predicted for r in rude]) >= 0.9
    assert np.mean([r.predicted for r in got if r.toxic == 0]) < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, score string, held_out int")
    labels = spark.createDataFrame([(i, i % 2, None if i == 24 else i % 2) for i in range(20, 60)] + [(None, 1, 1), (21, 0, 0)], "doc_id long, quality int, toxic int")
    held = F.coalesce(id_mod("doc_id", 3) == 1, F.lit(False))
    got = toxicity.toxicity_scores(docs, labels, held).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.limit(0), held).collect()} == {0.5}
    assert toxicity.toxicity_scores(docs.limit(0), labels, held).count() == 0
    kept = toxicity.score(docs, toxicity.train([]), "odds")
    assert kept.columns == [*docs.columns, "odds"] and kept.count() == len(ODD)


def test_queries_give_the_columns_asked_for(spark):
    want = {
        "op11_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        "op13_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    }
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, DATA)
        assert got.columns == columns and (name == "op13_prefix_trie" or got.count() == docs)
