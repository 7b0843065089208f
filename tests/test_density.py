"""Density clusters on planted groups with noise, on odd vectors, and neighbours against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from orrery.operators import density


def planted(seed: int, groups: int, each: int, noise: int, dim: int = 32, spread: float = 0.04):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    rows = [(g * each + i, (centres[g] + spread * rng.standard_normal(dim)).tolist()) for g in range(groups) for i in range(each)]
    return rows + [(10_000 + i, rng.standard_normal(dim).tolist()) for i in range(noise)]


def test_groups_and_noise(spark):
    rows = planted(7, 5, 8, 30)
    odd = [(20_000, None), (20_001, [0.0] * 32), (20_002, [float("nan")] * 32), (20_003, [1.0, 2.0]), (20_004, [1.0, 2.0]), (20_005, [2.0, 4.0]), (20_006, []), (None, rows[0][1]), (0, rows[0][1])]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, node string")
    got = {r.vec_id: r.cluster for r in density.density_clusters(frame).collect()}
    assert len(got) == len(rows) + 7
    assert all(got[i] == i // 8 * 8 for i in range(40)) and not any(got[i] is not None for i, _ in rows[40:])
    assert all(got[i] is None for i in (20_000, 20_001, 20_002, 20_006)) and got[20_003] == got[20_004] == got[20_005] == 20_003
    few = density.density_clusters(frame.filter("vec_id < 4"))
    assert few.count() == 4 and {r.cluster for r in few.collect()} == {None}
    assert density.density_clusters(frame.limit(0)).count() == 0


def test_a_wide_group_of_two_dense_ones_is_two(spark):
    """Two tight groups within the coarsest level of one another stay apart; a loose one alone is one."""
    rng = np.random.default_rng(1)
    base, off, far = rng.standard_normal((3, 32))
    tight = lambda c, i: (i, (c + 0.01 * rng.standard_normal(32)).tolist())
    rows = [tight(base, i) for i in range(10)] + [tight(base + 0.8 * off, 10 + i) for i in range(10)] + [(20 + i, (far + 0.45 * rng.standard_normal(32)).tolist()) for i in range(12)]
    got = {r.vec_id: r.cluster for r in density.density_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {got[i] for i in range(10)} == {0} and {got[i] for i in range(10, 20)} == {10} and {got[i] for i in range(20, 32)} == {20}


@pytest.mark.parametrize(("block", "least"), [(4096, 1.0), (256, 0.9)])
def test_neighbours_are_found(spark, block, least):
    rows = planted(3, 60, 40, 600)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, unit array<double>")
    found = {(r.a, r.b) for r in density.neighbours(frame, block=block, near=5).collect()}
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(2400) for j in np.argpartition(d[i], 4)[:5]}  # those of the groups; noise has none that are near
    assert len(want & found) >= least * len(want)


def test_a_neighbour_counts_once(spark):
    """Distances that many blocks give with other last bits are those of one neighbour."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 50))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, unit array<double>")
    found = density.neighbours(frame, block=64).select("a", "b").collect()
    assert len(found) == len(set(found)) and max(np.bincount([r.a for r in found])) == density.NEAR
