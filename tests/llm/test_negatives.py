"""Hard negatives against a plain version, and the rows that take no part."""

import numpy as np
import pytest

from docquery.llm import negatives

ROWS = "vec_id long, embedding array<double>, label int, id string, q string"


def plain(rows, every=100, k=5):
    seen = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v])
        seen[i] = min(seen.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(seen[a][1], seen[b][1]))
    out = []
    for a in seen:
        if a % every == 0:
            ranked = sorted((-score(a, b), b) for b in seen if b != a)
            for ps, p in [(-s, b) for s, b in ranked if seen[b][0] == seen[a][0]][:k]:
                inside = [(-s, b) for s, b in ranked if seen[b][0] != seen[a][0] and 80 * ps <= -100 * s <= 100 * ps][:k]
                out += [(a, p, r + 1, b, ps, s) for r, (s, b) in enumerate(inside)]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "extra", "extra") for r in rows], ROWS)
    return sorted(tuple(r) for r in negatives.mine(df, **how).collect())


def close_vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dims)
    return [(int(i), [float(x) for x in np.round(centre + rng.normal(size=dims) * 0.4, 1)], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("block", [8192, 37])
def test_equal_to_all_scores(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    rows = close_vectors(1, 400, 6)
    expected = plain(rows, every=10)
    assert len(expected) > 500 and found(spark, rows, every=10) == expected


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    rows = close_vectors(2, 200, 5)
    assert found(spark, rows, every=10) == plain(rows, every=10)


def test_access_stops_before_the_end(monkeypatch):
    """A clear winner settles a window after few rows; a tie with the bound does not."""
    q = np.zeros((5000, 2), np.int64)
    q[:, 0] = np.arange(5000)
    lists = negatives.SortedLists(np.arange(5000), np.zeros(5000, np.int64), q)
    asked = []
    rounds = lists.rounds
    monkeypatch.setattr(lists, "rounds", lambda a: (asked.append(len(x[0])) or x for x in rounds(a)))
    rows, scores = lists.top(np.array([3, 0]), np.ones(5000, bool), [(None, None)], 5)[0]
    assert scores.tolist() == [14997, 14994, 14991, 14988, 14985] and sum(asked) < 200
    lists = negatives.SortedLists(np.arange(5000), np.zeros(5000, np.int64), np.ones((5000, 1), np.int64))
    assert lists.top(np.array([1]), np.ones(5000, bool), [(None, None)], 3)[0][0].tolist() == [0, 1, 2]


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.5], 2), (2, [0.9, 0.1], 2), (3, [0.9, 0.1], 2), (3, [0.9, 0.1], 2), (4, [0.95], 3), (5, [], 2), (6, [1.0, 0.0, 9.0], 5),
        (None, [1.0, 0.0], 2), (8, None, 2), (9, [1.0, None], 2), (10, [nan, 1.0], 2), (11, [1.0, -inf], 2), (12, [1.0, 0.0], None), (13, [0.5, 0.5], 3), (100, [0.0, 0.0], 2), (200, [-1.0, 2.0], 4),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(100, [1.0], 1)]) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_large_components_are_bounded(spark):
    rows = [(100, [1e300, 1.0], 1), (101, [1.0, 1.0], 1), (102, [0.9, 1.0], 2)]
    assert [r[:4] for r in found(spark, rows)] == [(100, 101, 1, 102)]
