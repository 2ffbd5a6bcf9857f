"""The threshold join against brute force, and the blocks it leaves out."""

import numpy as np
import pytest

from twinweave.operators import similarity
from twinweave.operators.similarity import Plan, choose_pivots, close_pairs, threshold_pairs


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), "c") for i, v in enumerate(x)], "idx long, vec array<double>, home string")


def brute(x, y, threshold, digits=None):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sim = unit(x) @ unit(y).T
    sim = np.round(sim, digits) if digits is not None else sim
    return {(int(i), int(a), round(float(sim[i, a]), 9)) for i, a in zip(*np.nonzero(sim >= threshold), strict=True)}


def told(df):
    rows = [(r.i, r.a, round(r.sim, 9)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def clusters(rng, n, groups, dim=16, spread=0.05):
    centre = rng.normal(size=(groups, dim))
    return centre[rng.integers(0, groups, n)] + rng.normal(0, spread, (n, dim))


@pytest.mark.parametrize(("threshold", "digits"), [(0.95, 6), (0.7, None), (0.3, 3), (0.0, 6), (-0.5, None)])
def test_against_brute_force(spark, monkeypatch, threshold, digits):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x, y = clusters(rng, 90, 5), clusters(rng, 70, 5)
    x[3] = 0
    y[4] = 0
    y[5:10] = x[5:10]  # a cosine of 1
    x[10:14], y[10:14] = rng.normal(size=(2, 4, 16))
    assert told(threshold_pairs(frame(spark, x), frame(spark, y), threshold, digits)) == brute(x, y, threshold, digits)


def test_ties_at_the_threshold(spark, monkeypatch):
    """Cosines of exactly 0.6 and 0.8, and one that only rounding lifts to the threshold."""
    monkeypatch.setattr(similarity, "BLOCK", 2)
    x = np.array([[1.0, 0.0], [3.0, 4.0], [0.0, 2.0], [0.6 - 4e-7, (1 - (0.6 - 4e-7) ** 2) ** 0.5]])
    y = np.array([[5.0, 0.0], [0.0, 1.0]])
    got = told(threshold_pairs(frame(spark, x), frame(spark, y), 0.6, 6))
    assert {(i, a) for i, a, _ in got} == {(0, 0), (1, 0), (1, 1), (2, 1), (3, 0), (3, 1)}
    assert {(i, a) for i, a, _ in told(threshold_pairs(frame(spark, x), frame(spark, y), 0.6, 9))} == {(0, 0), (1, 0), (1, 1), (2, 1), (3, 1)}


def test_blocks_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 20)
    rng = np.random.default_rng(2)
    x, y = clusters(rng, 600, 30, 24), clusters(rng, 600, 30, 24)
    y[:300] = clusters(np.random.default_rng(2), 600, 30, 24)[:300]
    plan = Plan(frame(spark, x), frame(spark, y), 0.9, 6)
    pairs = plan.pairs.collect()
    assert len(pairs) == len(set(map(tuple, pairs)))
    across, down = (plan.blocks.where(f"side = '{s}'").select("block").distinct().count() for s in ("left", "right"))
    assert min(across, down) >= 30
    assert len(pairs) < 0.25 * across * down
    assert told(plan.rows()) == brute(x, y, 0.9, 6)
    plan.drop()


def test_one_direction_holds_most_vectors(spark, monkeypatch):
    """A third of all rows alike: their stretch is cut into blocks like any other."""
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile([1.0, 0, 0, 0], (60, 1)), rng.normal(size=(60, 4))])
    plan = Plan(frame(spark, x), frame(spark, x), 0.99, 6)
    sizes = [r["count"] for r in plan.blocks.groupBy("side", "block").count().collect()]
    assert max(sizes) <= 16
    assert told(plan.rows()) == brute(x, x, 0.99, 6)


def test_nulls_and_empty_sides(spark):
    x = spark.createDataFrame([(0, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)], "idx long, vec array<double>")
    none = x.limit(0)
    assert told(threshold_pairs(x, x, 0.5)) == {(0, 0, 1.0)}
    assert threshold_pairs(x, none, 0.5).collect() == threshold_pairs(none, none, 0.5).collect() == []


def test_one_block_a_side_is_compared_at_once(spark):
    rng = np.random.default_rng(6)
    x, y = clusters(rng, 40, 3), clusters(rng, 30, 3)
    assert told(threshold_pairs(frame(spark, x), frame(spark, y), 0.8, 6)) == told(Plan(frame(spark, x), frame(spark, y), 0.8, 6).rows()) == brute(x, y, 0.8, 6)


def test_prefixes_and_pivots():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 32)) * np.geomspace(4, 0.05, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r, c = close_pairs(x, x, 0.8, 8)
    kept = set(zip(r.tolist(), c.tolist(), strict=True))
    assert len(kept) < 0.6 * 200 * 200
    assert set(zip(*map(lambda k: k.tolist(), np.nonzero(x @ x.T >= 0.8)), strict=True)) <= kept
    assert len(choose_pivots(np.ones((50, 3)), 8)) == 1
    assert len(choose_pivots(rng.normal(size=(50, 3)), 8)) == 8
