"""Whitened vectors against a plain decomposition."""

from __future__ import annotations

import numpy as np
import pytest

from dexspark.llm import registry, whitening
from tests.conftest import SMALL


def plain(vectors: list[np.ndarray], components: int):
    """n, deviations, whitened rows (but for signs), shares of variance."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.unique(x.astype(np.int64), axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    apart = fit - np.array(sums) / n
    values, turn = np.linalg.eigh(apart.T @ apart / n)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    fine = values > 1e-10 * values[0]
    rows = (x.astype(np.float64) - np.array(sums) / n) @ turn[:, fine] / np.sqrt(values[fine])
    return n, deviation, rows, values[fine] / np.trace(apart.T @ apart / n)


def compare(got, ids, vectors, components):
    n, deviation, rows, share = plain(vectors, components)
    assert len(got) == len(ids) * len(share)
    signs = np.zeros(len(share))
    at = {doc: k for k, doc in enumerate(ids)}
    for r in got:
        k, c = at[r.vec_id], r.component - 1
        if not signs[c] and abs(rows[k, c]) > 0.1:
            signs[c] = np.sign(rows[k, c] * r.whitened)
    for r in got:
        k, c = at[r.vec_id], r.component - 1
        assert (r.n, int(r.deviation)) == (n, deviation[k])
        assert abs(r.whitened - signs[c] * rows[k, c]) < 1e-6 and abs(r.explained / share[c] - 1) < 1e-6
        assert r.identity_error < 1e-6


def test_query_equals_a_plain_decomposition(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    got = registry.queries()["op13_whitening"](spark, SMALL)
    assert dict(got.dtypes)["deviation"] == "bigint"
    compare(got.collect(), [r.vec_id for r in table], [np.array(r.embedding) for r in table], 16)


@pytest.mark.parametrize("block", [7, 1024])
def test_blocks_repeats_and_faulty_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    rng = np.random.default_rng(block)
    x = rng.standard_normal((60, 9)) * np.geomspace(5, 0.2, 9) + 3
    x[40:] = x[7]  # a third of the rows, and in the fit list once
    x[:, 8] = x[:, 0]  # no full rank
    bad = [(1000, None), (1001, []), (1002, [1.0] * 8 + [None]), (1003, [float("nan")] * 9), (1004, [float("-inf")] + [0.0] * 8)]
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as row", "2 as x", "3 as v", "4 as n")
    compare(whitening.whiten(docs, 12).collect(), list(range(60)), list(x), 12)
    repeated = whitening.whiten(docs.unionByName(docs), 2)
    assert repeated.count() == 2 * 2 * 60 and repeated.select("n").distinct().collect() == [(40,)]


def test_lengths_apart_and_nothing_to_whiten(spark):
    rows = [(1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [5.0]), (4, [7.0]), (5, [8.0, 8.0, 8.0]), (6, [8.0, 8.0, 8.0]), (None, [7.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(docs).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (None, 1)}
    assert all(abs(abs(r.whitened) - 1) < 1e-9 and r.n == 2 and abs(r.explained - 1) < 1e-9 for r in got.values())
    assert whitening.whiten(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e12])], docs.schema)).count()
    with pytest.raises(ValueError, match="at most"):
        whitening.whiten(spark.createDataFrame([(1, [0.0] * 5000)], docs.schema))
