"""The similarity join of names against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import fuzzy


@pytest.mark.parametrize("least", [80.0, 90.0])
def test_no_alike_pair_is_missed(spark, least):
    rng = np.random.default_rng(5)
    words = "north gate tower bridge plant water works steel block east annex and of".split()

    def name():
        text = " ".join(rng.choice(words, rng.integers(1, 5)))
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, len(text) + 1))
            text = text[:at] + str(rng.choice(list("abz-# 1"))) + text[at + int(rng.integers(0, 2)) :]
        return text

    odd = ["", " ", "--", "a", "b", "aa", "a-b", "North  GATE", "gate north"]
    left, right = ([name() for _ in range(200)] + odd for _ in range(2))
    sides = [spark.createDataFrame([(i, x) for i, x in enumerate([*side, None])], "i long, t string") for side in (left, right)]
    pair = fuzzy.token_set(F.col("a"), F.col("b")) + (F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))).cast("double") * 100
    named = lambda frame, c: frame.select(F.lower("t").alias(c)).distinct().filter(f"{c} <> ''")
    every = named(sides[0], "a").crossJoin(named(sides[1], "b")).withColumn("score", pair).filter(F.col("score") >= least)
    bare = lambda c: ~F.col(c).rlike(r"[\p{L}\p{N}]")
    want = {(r.a, r.b) for r in every.filter(~(bare("a") & bare("b")) | F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))).collect()}
    found = fuzzy.alike(*(named(s, "t") for s in sides), least)
    assert want <= {tuple(r) for r in found.collect()} and len(want) > 100
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    got = fuzzy.best_names(sides[0].select(F.col("i").alias("query_id"), F.col("t").alias("q")), sides[1].select(F.col("t").alias("name")), least, 10_000)
    assert {(r.query_id, r.name) for r in got.collect()} == {(i, n) for i, q in enumerate(left) for n in right if (q.lower(), n.lower()) in want}
    with pytest.raises(ValueError, match="75"):
        fuzzy.alike(*(named(s, "t") for s in sides), 60)


@pytest.mark.parametrize("k", [5, 40])
def test_numbered_names_meet_few_others(spark, k):
    """Names of one pattern, some twice, have the best of all pairs; far fewer than all pairs are built, and contained ones are found by a long part."""
    names = [f"Customer#{i:09d}" for i in range(0, 6000, 3)] + ["Customer#000000012", "CUSTOMER#000000012", None]
    asked = [f"Custmer {i:09d}" for i in range(0, 3000, 60)] + ["00012", "00599", "custmer 000000120", "zz", None]
    sides = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string"), spark.createDataFrame([(n,) for n in names], "name string")
    a, b = F.lower("q"), F.lower("name")
    every = sides[0].crossJoin(sides[1]).withColumn("score", fuzzy.token_set(a, b) + (a.contains(b) | b.contains(a)).cast("double") * 100).filter("score >= 80")
    want = {}
    for r in sorted(every.collect(), key=lambda r: (r.query_id, -r.score, r.name)):
        want.setdefault(r.query_id, []).append((r.name, r.score))
    got = {}
    for r in sorted(fuzzy.best_names(*sides, 80.0, k).collect(), key=lambda r: (r.query_id, r.place)):
        got.setdefault(r.query_id, []).append((r.name, r.score))
    assert got == {q: rows[:k] for q, rows in want.items()}
    texts = [f.select(F.lower(c).alias("t")).filter("t is not null").distinct() for f, c in zip(sides, ("q", "name"), strict=True)]
    assert fuzzy.alike(*texts, 88.0).count() < 0.1 * len(asked) * len(names)
