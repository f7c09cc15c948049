"""Counts of links where shards overlap much: every pair that any shard found counts, once."""

import numpy as np
import pytest

from weftline.llm import graph


def brute(x):
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = np.zeros(len(u), np.int64)
    for a in range(0, len(u), 1000):
        out[a : a + 1000] = (u[a : a + 1000] @ u.T >= 0.95).sum(1) - 1
    return out


@pytest.mark.parametrize(("few", "share"), [(64, 0.98), (2, 0.9)])
def test_links_in_few_dimensions(spark, monkeypatch, few, share):
    """Vectors in 6 dimensions, where the shards' borders cut through many pairs: some are in no shard together. Whether pairs are kept or summed, nothing is counted twice."""
    monkeypatch.setattr(graph, "FEW", few)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12_000, 6))
    x[11_900:] = x[0] + rng.normal(size=(100, 6)) * 0.01  # a dense group
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    want = brute(x)
    got = np.array([r.n_links for r in graph.near_duplicates(df).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.995 * want.sum() and (got == want).mean() >= share
