"""Passages in texts against all windows."""

from __future__ import annotations

import random

import pytest

from orrery.operators import passages as p


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain(texts, passages, least):
    """The best of all windows of each text."""
    out = set()
    for k, passage in passages:
        want = (passage or "").lower().split()
        for t, text in texts:
            have = (text or "").lower().split()
            windows = [(distance(want, have[s:e]), s, e - s) for s in range(len(have)) for e in range(s, min(len(have), s + 2 * len(want)) + 1)] if want else []
            if windows and min(windows)[0] <= int(len(want) * (1 - least) + 1e-9):
                edits, s, n = min(windows)
                out.add((k, t, s, n, round(1 - edits / len(want), 6)))
    return out


@pytest.mark.parametrize("least", [0.75, 0.5, 1.0])
def test_windows_are_those_of_a_plain_search(spark, monkeypatch, least):
    """Changed, dropped and added words, at ends and between blocks, repeated words, copies and odd rows."""
    monkeypatch.setattr(p, "BLOCK", 8)
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(14)] + ["der"] * 6
    passages = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 4, 5, 7, 8, 13])))) for i in range(12)]
    passages += [(50, passages[0][1].upper()), (51, None), (52, " "), (53, "")]
    texts = [(100, None), (101, ""), (102, "der"), (103, "\t der\n der ")]
    for i in range(30):
        body = [r.choice(vocabulary) for _ in range(r.randint(1, 25))]
        said = passages[r.randrange(12)][1].split()
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(said) + 1)
            said[at : at + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 1)
        at = r.randint(0, len(body))
        texts.append((i, " ".join(body[:at] + said + body[at:])))
    got = p.find_passages(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(passages, "passage_id int, passage string"), least).collect()
    want = plain(texts, passages, least)
    assert len(got) == len(want) > 20 and {tuple(x) for x in got} == want


def test_tables_without_rows_and_with_odd_ones(spark):
    """No texts, no passages, ids that are null or come twice, and further columns of the same names."""
    texts = spark.createDataFrame([(1, "a b c d e", "x"), (1, "z a b c d e", "y"), (None, "a b c d", "z")], "text_id long, text string, passage string")
    passages = spark.createDataFrame([("p", "B c D", 1), (None, "a b", 2), ("p", "c d", 3)], "passage_id string, passage string, text_id int")
    assert {tuple(r) for r in p.find_passages(texts, passages).collect()} == {("p", 1, 1, 3, 1.0), ("p", 1, 2, 2, 1.0)}
    assert p.find_passages(texts.limit(0), passages).count() == p.find_passages(texts, passages.limit(0)).count() == 0
    with pytest.raises(ValueError, match="0.5"):
        p.find_passages(texts, passages, 0.4)
