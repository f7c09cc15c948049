"""A trained option head: gradients, epochs, and what it beats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import exprs as E
from weftline.operators import evaluation as V
from weftline.operators import fitting, typed

SMALL = fitting.Settings(dims=256, bias=32)


def made(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    words = {"a": ["red", "apple", "pie"], "b": ["blue", "sky", "sea"], "c": ["green", "leaf", "tree"]}
    rows = []
    for i in range(n):
        label = "abc"[rng.integers(0, 3)]
        known = rng.random() < 0.85
        text = " ".join(rng.choice(words[label] if known else ["mist", "fog"], 4)) + " " + " ".join(rng.choice(["x", "y", "z"], 5))
        rows.append((f"i{i}", f"g{i % 40}", text if i % 50 else None, "Which?", ["a", "b", "c"], ["fruit", "water", "plant"], [1.0 if known and i % 50 and k == label else 0.0 for k in "abc"]))
    return spark.createDataFrame(rows, "item_id string, source_group string, state string, text string, ids array<string>, texts array<string>, target array<double>").withColumn("kind", F.lit("choice"))


def test_gradients_are_finite_differences(spark):
    df = made(spark, 40).withColumn("target", F.transform("target", lambda t: t * 0.7 + F.when(F.array_max("target") > 0, 0.1).otherwise(0.0)))
    table = fitting.encoded(df, SMALL).toArrow()
    rows = fitting.Rows.of(table.combine_chunks().to_batches()[0])
    assert 0 < rows.yes.sum() < len(rows.yes)
    rng = np.random.default_rng(0)
    w = rng.normal(size=512)
    sums, g = fitting.loss_sums(w, rows)
    for group, which in (((0, 256), 0), ((256, 512), 2)):
        for k in [*rng.integers(*group, 30), *(np.flatnonzero(g[group[0] : group[1]])[:20] + group[0])]:
            step = np.zeros(512)
            step[k] = 1e-5
            up, down = (fitting.loss_sums(w + s, rows, False)[0][which] for s in (step, -step))
            assert (up - down) / 2e-5 == pytest.approx(g[k], abs=1e-5)
    assert sums[1] == rows.yes.sum() and sums[3] == 40


def test_losses_are_those_of_the_report(spark):
    df = made(spark, 60)
    head = fitting.OptionHead(np.random.default_rng(1).normal(size=512), SMALL)
    sums, _ = fitting._summed(fitting.encoded(df, SMALL), head.weights, False)
    rows = df.collect()
    z, a = head.logits([r.state for r in rows], [r.text for r in rows], [r.texts for r in rows]), head.answerability([r.state for r in rows])
    told = spark.createDataFrame([(x, r.target, y, sum(r.target) > 0) for x, y, r in zip(z, a, rows, strict=True)], "z array<double>, y array<double>, a double, yes boolean")
    parts = V.training_loss(F.col("z"), F.col("y"), F.col("a"), F.col("yes"))
    assert told.agg(parts["loss"].alias("x")).first().x == pytest.approx(fitting.loss_of(sums, 0.25), rel=1e-9)


def test_a_fitted_head_beats_the_prior(spark):
    df = made(spark)
    train, dev, test = (df.where(F.pmod(F.crc32("source_group"), F.lit(5)).isin(*k)) for k in ([0, 1, 2], [3], [4]))
    head, history = fitting.fit(train, dev)
    again, other = fitting.fit(train.repartition(7), dev.repartition(1))
    assert np.abs(again.weights - head.weights).max() < 1e-9 and [h["development"] for h in other] == pytest.approx([h["development"] for h in history])
    assert len(history) == 6 and history[-1]["train"] < history[0]["train"] / 2
    best = fitting.loss_of(fitting._summed(fitting.encoded(dev, head.settings), head.weights, False)[0], 0.25)
    assert best == pytest.approx(min(h["development"] for h in history))
    scored = typed.score(test.where("array_max(target) > 0"), head)
    ce = scored.agg(F.avg(E.soft_ce(F.col("p"), F.col("target")))).first()[0]
    keyed = lambda d: d.where("array_max(target) > 0").select(F.col("item_id").alias("case_id"), F.lit("w").alias("workflow"), F.lit("s").alias("schema_key"), "ids", "target")
    prior = V.prior_controls(keyed(train.unionAll(dev)), keyed(test)).where("key = 'all'").first()
    assert ce < prior.soft_prior_ce / 3
    # mist and fog have no answer
    a = head.answerability(["mist fog mist x", "red apple y", None])
    assert a[0] < a[1]


def test_nothing_to_train_on(spark):
    none = made(spark, 3).where("item_id = ''")
    head, history = fitting.fit(none, none, fitting.Settings(dims=256, bias=32, epochs=1))
    assert not head.weights.any() and head.logits(["x"], [None], [["a", "b"]]) == [[0.0, 0.0]] and len(history) == 1
