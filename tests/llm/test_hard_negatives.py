"""Hard negatives against all pairs, and the bounds of segment summaries."""

from __future__ import annotations

import numpy as np
import pytest

from dexspark.llm import hard_negatives


def plain(rows, every=50):
    """By all pairs, from distinct (vec_id, vector, label)."""
    whole = [(k, [int(np.floor(256 * c)) for c in v], label) for k, v, label in rows]
    out = []
    for a, x, label in whole:
        if a % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), k, other) for k, y, other in whole if k != a and len(y) == len(x)))
        for top, p, _ in [s for s in scored if s[2] == label][:5]:
            fit = [(k, -s) for s, k, other in scored if other != label and -50 * top <= -100 * s <= -95 * top]
            out += [(a, p, n, k, -top, s) for n, (k, s) in enumerate(fit[:3], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as x", "2 as row", "3 as shard", "4 as sums", "5 as v")


@pytest.mark.parametrize("shard, dims", [(100, 16), (10_000, 16), (150, 13), (10_000, 1), (400, 40)])
def test_negatives_equal_all_pairs(spark, shard, dims):
    rng = np.random.default_rng(dims)
    x = np.round(rng.standard_normal((700, dims)), 2)
    x[300:340] = x[7]  # ties, copies of one vector
    x[600:] = np.sort(x[600:], axis=1)  # vectors that are smooth
    rows = [(k, v.tolist(), int(rng.integers(4))) for k, v in enumerate(x)]
    bad = [(750, None, 1), (800, [], 1), (850, [1.0] * (dims - 1) + [None], 1), (900, [float("nan")] * dims, 1), (950, [float("inf")] * dims, 2), (1000, [1.0] * dims, None), (None, [1.0] * dims, 1)]
    got = hard_negatives.mine(table(spark, rows + bad), shard=shard, anchors=4).collect()
    want = plain(rows)
    assert sorted(map(tuple, got)) == want and (want or dims == 1)


def test_repeated_rows_shared_ids_and_lengths(spark):
    rows = [(50, [1.0, 0.5], 1), (1, [1.0, 1.0], 1), (2, [0.5, 1.0], 2), (3, [1.0, 0.25], 2), (50, [1.0, 1.0, 1.0], 1), (4, [1.0, 1.0, 2.0], 1), (5, [1.0, 1.0, 0.5], 2)]
    got = sorted(map(tuple, hard_negatives.mine(table(spark, rows + rows)).collect()))
    one = 256 * 256
    assert got == [(50, 1, 1, 3, one * 3 // 2, one * 9 // 8), (50, 1, 2, 2, one * 3 // 2, one), (50, 4, 1, 5, 4 * one, one * 5 // 2)]
    assert hard_negatives.mine(table(spark, rows).limit(0)).count() == 0
    assert hard_negatives.mine(table(spark, [(50, [1.0], 1)])).count() == 0
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(table(spark, [(50, [1e12], 1), (1, [1e12], 1)])).collect()


@pytest.mark.parametrize("dims", [1, 7, 8, 64, 100])
def test_bounds_hold_and_narrow(dims):
    rng = np.random.default_rng(dims)
    x = np.floor(256 * np.cumsum(rng.standard_normal((50, dims)), axis=1))
    levels = hard_negatives.by_level(hard_negatives.summaries(x), dims)
    scores, before = x @ x[0], np.inf
    for means, spreads in levels:
        middle, width = means @ means[0], spreads @ spreads[0]
        assert (np.abs(scores - middle) <= width * (1 + 1e-9) + 1e-6).all() and (width <= before * (1 + 1e-9) + 1e-6).all()
        before = width
