"""The audit of the embedding index where links are rare."""

import numpy as np
import pytest

from weftline.llm import graph


@pytest.fixture(scope="module")
def rare(spark):
    """Three linked pairs among 20,000 vectors."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 24))
    pairs = [(17, 9_000), (5_000, 5_001), (19_999, 3)]
    for a, b in pairs:
        x[b] = x[a] + rng.normal(size=24) * 0.02
    df = spark.createDataFrame([(i, 1, 24, [float(v) for v in row]) for i, row in enumerate(x)], "node long, size long, dim int, emb array<float>").repartition(6).cache()
    df.count()
    return df, pairs


def test_rare_links_are_sought_without_the_index(spark, rare):
    classes, pairs = rare
    found = {r.node for r in graph.linked_by_sketches(classes, 0.95, 20_000).collect()}
    assert found <= {x for p in pairs for x in p} and len(found) >= 4


def test_a_broken_index_does_not_pass_where_links_are_rare(spark, rare):
    classes, pairs = rare
    none = spark.createDataFrame([], "node long, other long, add long")
    assert graph.audit(classes, none, 0.95, queries=16, most=64) < 0.1
    right = spark.createDataFrame([(x, y, 1) for a, b in pairs for x, y in ((a, b), (b, a))], none.schema)
    assert graph.audit(classes, right, 0.95, queries=16, most=64) == 1.0


def test_a_broken_index_raises_in_the_operator(spark, rare, monkeypatch):
    classes, _ = rare
    monkeypatch.setattr(graph, "_index", lambda *a, **kw: spark.createDataFrame([], "node long, other long, add long"))
    monkeypatch.setattr(graph.audit, "__defaults__", (16, 32, 64))
    with pytest.raises(RuntimeError, match="the index found"):
        graph.near_duplicates(classes.selectExpr("node AS vec_id", "emb AS embedding"), most_overlap=2)


def test_nothing_is_linked(spark):
    rng = np.random.default_rng(1)
    classes = spark.createDataFrame([(i, 1, 24, [float(v) for v in rng.normal(size=24)]) for i in range(600)], "node long, size long, dim int, emb array<float>")
    none = spark.createDataFrame([], "node long, other long, add long")
    assert graph.audit(classes, none, 0.95, queries=4, most=8) == 1.0 == graph.audit(classes.where("node < 0"), none, 0.95)
