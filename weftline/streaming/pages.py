"""The page pipeline as a stream: new parquet files of pages in, labelled pages out, each URL once within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import pages as P

SCHEMA = "page_id long, url string, html string"


def page_stream(spark: SparkSession, path: str, seed: int = 1, watermark: str = "1 hour") -> DataFrame:
    raw = spark.readStream.schema(SCHEMA).parquet(path).withColumn("seen", F.current_timestamp())
    once = raw.withWatermark("seen", watermark).dropDuplicatesWithinWatermark(["url"])
    return P.parse_v1(once).withColumn("host", E.host_of(F.col("url"))).withColumn("split", E.split_of(F.col("host"), seed))


def start(spark: SparkSession, path: str, out: str, checkpoint: str):
    """Runs the stream over what is there and stops."""
    return page_stream(spark, path).drop("seen").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
