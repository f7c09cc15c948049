"""Scores of the hidden Markov model do not depend on how rows are dealt."""

import logging

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import hmm, shared


def table(spark, n=900):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        topic, words = rng.integers(0, 3), []
        for _ in range(80):
            topic = topic if rng.random() < 0.95 else rng.integers(0, 3)
            words.append(f"w{topic}x{int(2000 * rng.random() ** 2)}")
        rows.append((i, " ".join(words)))
    return spark.createDataFrame([*rows, (1, None), (None, ""), (5, "w1x1")], "doc_id long, text string")


def test_scores_do_not_depend_on_partitions(spark):
    df = table(spark)
    found = []
    for dealt in (df.coalesce(1), df.repartition(7, F.xxhash64("text")), df.orderBy(F.desc("doc_id")).coalesce(2)):
        scores = hmm.hmm_scores(dealt, shared.in_remainder("doc_id", 7, 2), states=3, most=1000, sample_tokens=4000)
        found.append(np.array(sorted((r["doc_id"] or -1, r["n_tokens"], r["score"]) for r in scores.collect())))
    assert len(found[0]) == 903
    for other in found[1:]:
        assert np.abs(other[:, 2] - found[0][:, 2]).max() < 1e-6 * np.abs(found[0][:, 2]).max()


def test_rounds_that_do_not_settle_are_told(spark, caplog):
    df = table(spark, 200)
    with caplog.at_level(logging.WARNING):
        hmm.train(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), hmm.token_counts(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), states=3, most=1000, sample_tokens=4000, rounds=2, gain=1e9)
        assert not caplog.records
        hmm.train(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), hmm.token_counts(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))), states=3, most=1000, sample_tokens=4000, rounds=2, gain=0.0)
    assert any("still gains" in r.message for r in caplog.records)
