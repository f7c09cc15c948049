import json

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.operators import training as R


def test_digests_differ_by_separators():
    assert R.digest({"b": 1, "a": "é"}) == R.digest({"a": "é", "b": 1}) != R.digest({"a": "é", "b": 1}, compact=False)


def test_preflight(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1990, "train").otherwise("test").alias("split"))
    assert R.preflight(df, F.when(F.col("id") == 3, "bad")).count() == 1999
    with pytest.raises(ValueError):
        R.preflight(df, F.when(F.col("id") == 1999, "bad"))
    with pytest.raises(ValueError):
        R.preflight(df, F.when(F.col("id") < 100, "bad"))


def test_cli(spark, tmp_path, capsys):
    req = tmp_path / "r.json"
    req.write_text(json.dumps({"state": "foo", "questions": {"q": {"instructions": "x", "criteria": {"a": "foo", "b": "bar"}}, "bad": {"instructions": ""}}}))
    assert cli.main(["decide", str(req)]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["answers"]["q"]["choice"] == "a" and "bad" in out["errors"]
    row = {"case_id": "1", "source_group": "1", "request_sha256": "a" * 64, "expected": "a", "raw_choice": "a", "choice": "a", "probabilities": {"a": 0.8, "b": 0.2}, "latency_ms": 10}
    led = tmp_path / "l.jsonl"
    led.write_text(json.dumps(row) + "\n")
    cli.main(["compare", str(led), str(led), "--samples", "100"])
    out = json.loads(capsys.readouterr().out)
    assert out["accuracy_delta"] == 0 and out["interval"] is None and out["baseline"]["accuracy"] == 1


def test_moving_average_in_buckets(spark):
    rows = [(k, i, float((i * 37 + len(k)) % 11)) for k in ("a", "bb") for i in range(0, 90, 1 if k == "a" else 7)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(3)
    for size in (1, 7, 1000):
        got = {r.k: r.average for r in R.moving_average(df, ["k"], "i", "v", 0.9, F.floor(F.col("i") / size)).collect()}
        for k in ("a", "bb"):
            want = 0.0
            for _, _, v in sorted(r for r in rows if r[0] == k):
                want = want * 0.9 + v * 0.1
            assert abs(got[k] - want) < 1e-9
