"""The real-world check in one call."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import typed
from weftline.plans import realworld

from test_functions import NEWS


@pytest.fixture
def found(spark):
    body = NEWS.replace("The library is open.", "The library is open. " * 20)
    data = [(f"w{i % 2}", i, f"https://h{i % 15}.example/{i}", body if i != 4 else "<p>thin", 404 if i % 6 == 1 else 200, "eng") for i in range(60)]
    return spark.createDataFrame(data, "warc_file string, seq long, url string, html string, http_status int, detected_language string").repartition(3)


def test_check(spark, found, tmp_path):
    out = f"{tmp_path}/out"
    known = spark.createDataFrame([("h0.example",), ("h1.example",)], "host string")

    def stop(batch):
        raise RuntimeError("stopped here")

    with pytest.raises(Exception, match="stopped here"):
        realworld.check(found, known, typed.OverlapScorer(), out, review=10, before_commit=stop)
    todo = realworld.pending_items(spark, out).count()
    # what is there is not made again: the second call reads no page
    broken = found.withColumn("html", F.raise_error(F.lit("read again")).cast("string"))
    report = realworld.check(broken, known, typed.OverlapScorer(), out, review=10)
    pages = spark.read.parquet(f"{out}/pages")
    assert report["pages"] == pages.count() and report["sites"] == 13 == pages.select("host").distinct().count()
    assert pages.groupBy("warc_file", "host").count().agg(F.max("count")).first()[0] <= 2 and pages.where("seq = 4").count() == 0
    assert report["decisions_scored"] == todo == spark.read.parquet(f"{out}/items").count() and realworld.pending_items(spark, out).count() == 0
    status = report["against_automatic_labels"]["page_status"]
    ok = pages.where("http_status = 200").count()
    assert status["n"] == report["pages"] and status["baseline"] == round(max(ok, report["pages"] - ok) / report["pages"], 4)
    assert 0 <= status["accuracy"] <= 1 and sum(c["n"] for c in status["confusions"]) == round((1 - status["accuracy"]) * status["n"])
    assert report["all_pages"]["page_type"]["n"] == ok and sum(report["all_pages"]["page_status"]["answers"].values()) == report["pages"]
    kept = json.loads(spark.read.text(f"{out}/report").first().value)
    assert kept == json.loads(json.dumps(report))
    review = spark.read.json(f"{out}/review").collect()
    assert len(review) == 10 and all(r.model.page_type.answer and len(r.page) <= 700 for r in review)
    assert {r.automatic_labels.page_type[0] for r in review if r.http_status == 200 and r.automatic_labels.page_type} == {"news_article"}
