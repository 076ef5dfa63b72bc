"""Hard negatives and the cover tree against exhaustive search."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.cover_tree import LONGEST, Tree, farthest_first
from tidemark.llm.hard_negatives import hard_negatives


def vectors(n: int, size: int = 6, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 0.3, (n, size)) + rng.integers(0, 4, (n, 1)) * 0.2


def make(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1) for r in rows],
        "vec_id long, embedding array<float>, label int, row string, score int",
    )


def plain(rows, positives=5, negatives=3, low=50, high=95):
    kept = []
    for vec_id, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    for n, (anchor, q, label) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scored = [
            (-sum(a * b for a, b in zip(q, v, strict=True)), r is None, r or 0, r, own)
            for k, (r, v, own) in enumerate(kept)
            if k != n and len(v) == len(q)
        ]
        scored.sort(key=lambda s: s[:3])
        for score, _, _, positive, _ in [s for s in scored if s[-1] == label][:positives]:
            fit = [
                s for s in scored if s[-1] != label and low * -score <= 100 * -s[0] <= high * -score
            ]
            for rank, s in enumerate(fit[:negatives], 1):
                out.append((anchor, positive, rank, s[3], -score, -s[0]))
    return out


def run(spark, rows, **options):
    found = hard_negatives(make(spark, rows), F.col("vec_id") % 50 == 0, **options)
    return [tuple(r) for r in found.collect()]


def key(row):
    return tuple(-1 if v is None else v for v in row)


def test_equals_exhaustive_search(spark):
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(vectors(900))]
    want = plain(rows)
    assert len(want) > 100
    assert sorted(run(spark, rows)) == sorted(want)
    # Many small trees, split labels, and cells beside the anchor's own.
    assert sorted(run(spark, rows, tree_rows=40, max_cells=9)) == sorted(want)


def test_ties_copies_and_a_hot_label(spark):
    base = vectors(40, seed=5)
    rows = [(k, base[k % 40 if k % 3 else 0].tolist(), 1 if k % 3 else k % 7) for k in range(400)]
    rows += rows[:60]
    want = plain(rows)
    assert sorted(run(spark, rows, tree_rows=32)) == sorted(want)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(vectors(120, size=3))]
    rows += [
        (50, None, 1),
        (100, [1.0, 2.0, 3.0], None),
        (150, [1.0, None, 1.0], 1),
        (200, [nan, 0.1, 0.1], 1),
        (250, [inf, 0.1, 0.1], 0),
        (None, [0.5, 0.4, 0.3], 1),
        (None, [0.5, 0.4, 0.3], 0),
        (300, [0.5, 0.5], 1),
        (301, [0.5, 0.5], 1),
        (302, [0.4, 0.4], 0),
        (350, [], 1),
        (351, [], 1),
        (352, [], 0),
        (400, [0.0, 0.0, 0.0], 5),
        (450, [-0.5, 0.1, -0.5], 9),
        (451, [0.5, -0.5, 0.5], 9),
    ]
    want = plain(rows)
    assert sorted(run(spark, rows), key=key) == sorted(want, key=key)
    assert {300, 350} <= {r[0] for r in want}


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_levels_cover_and_bounds_hold(spread):
    rng = np.random.default_rng(1)
    points = np.floor(rng.normal(0, 50 * spread, (700, 8)) + rng.integers(0, 2, (700, 1)) * 90)
    norm = float(np.sqrt((points**2).sum(1).max()))
    tree = Tree.of(points, np.arange(700), np.arange(700), np.zeros(700, bool), np.full(700, "a"), norm)
    tree = Tree.loads(tree.dumps())
    starts = np.concatenate([[0], tree.ends[:-1]])
    lone = np.full(5, -np.inf), np.full(5, np.inf)
    queries = np.floor(rng.normal(0, 60, (5, 8)))
    low, high = tree.bounds(queries, *lone)
    for leaf, (a, b) in enumerate(zip(starts, tree.ends, strict=True)):
        scores = queries @ tree.points[a:b].T
        assert (scores >= low[:, leaf, None]).all() and (scores <= high[:, leaf, None]).all()
    assert tree.ends[-1] == 700 and sorted(tree.rows) == list(range(700))
    for k, (centres, radii) in enumerate(zip(tree.centres, tree.radii, strict=True)):
        assert len(centres) == len(radii) == len(tree.parents[k])


def test_centres_are_farther_apart_than_anything_is_from_them():
    points = vectors(300)
    chosen, gaps, nearest = farthest_first(points, 20)
    apart = np.sqrt(((points[:, None] - points[chosen]) ** 2).sum(2))
    assert (np.diff(gaps[1:]) <= 1e-9).all()
    assert (apart.argmin(1) == nearest).mean() > 0.99
    assert apart.min(1).max() <= gaps[-1] + 1e-9


def test_scores_beyond_doubles_are_exact():
    points = np.array([[2.0**40, 3.0], [2.0**60, 1.0]])
    tree = Tree.of(points, np.arange(2), np.arange(2), np.zeros(2, bool), np.array(["a", "b"]), 2.0**61)
    whole = np.array([[-LONGEST - 1, LONGEST]])
    q = np.array([2.0**13, 1.0])
    ends = (whole[:, k].astype(float) for k in (0, 1))
    low, high = (b[0] for b in tree.bounds(q[None], *ends))
    for label, want in (("a", 2**53 + 3), ("b", LONGEST)):
        ((_, scores),) = tree.best(q, -1, label, True, 5, whole, low, high)
        assert scores.tolist() == [want]
