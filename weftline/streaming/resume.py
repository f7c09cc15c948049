"""Stages that can be stopped at any point and go on where they were (SRC-16).

A stage appends the rows it makes of a stream of files to a folder, batch by batch:

    out/_checkpoint/        Spark's log of which files make up which batch
    out/batch=<id>/         the rows of a batch, parquet
    out/_committed/<id>     the batch's record: its id, its number of rows, its files

A batch's rows are written first, replacing whatever a stopped run left in the batch's folder, and its record after them, by a rename. The log hands a
batch out again, with the same files, until the whole batch is done; a batch that has its record is not computed again. So whenever a run is killed, the next one
goes on, and readers, who look at recorded batches alone, see each row once. Only records, one a batch, are listed by the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def _path(spark: SparkSession, *parts: str):
    """A Hadoop path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(p.strip("/") if i else p.rstrip("/") for i, p in enumerate(parts)))
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    at, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.writing")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(beside, at):
        raise OSError(f"{path} cannot be put in place")


def committed(spark: SparkSession, out: str) -> list[dict]:
    """The records of a stage's batches, in order."""
    at, fs = _path(spark, out, "_committed")
    if not fs.exists(at):
        return []
    names = [s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().isdigit()]
    if not names:
        return []
    found = spark.read.text(names, wholetext=True).collect()  # a record for each batch
    return sorted((json.loads(r[0]) for r in found), key=lambda r: r["batch"])


def read(spark: SparkSession, out: str, schema: StructType | str) -> DataFrame:
    """The rows of all recorded batches, with their batch."""
    done = committed(spark, out)
    wide = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not done:
        return spark.createDataFrame([], wide).withColumn("batch", F.lit(None).cast("long"))
    paths = [f"{out.rstrip('/')}/batch={r['batch']}" for r in done]
    return spark.read.schema(wide).option("basePath", out).parquet(*paths).withColumn("batch", F.col("batch").cast("long"))


def append(source: DataFrame, stage: Callable[[DataFrame], DataFrame], out: str, *, before_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """Starts a stage over all that is in the source, a streaming DataFrame of files, and stops after it. `before_commit` is called with a batch's id between its rows
    and its record; a stage that is stopped there is stopped at its weakest point."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        record = f"{out.rstrip('/')}/_committed/{batch_id}"
        at, fs = _path(spark, record)
        if fs.exists(at):
            return
        counted = Observation(f"batch {batch_id}")
        made = stage(batch)
        made.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")
        folder, _ = _path(spark, out, f"batch={batch_id}")
        files = {s.getPath().getName(): s.getLen() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")}
        if before_commit:
            before_commit(batch_id)
        put(spark, record, json.dumps({"batch": batch_id, "rows": counted.get["rows"], "files": files}))

    return source.writeStream.foreachBatch(write).option("checkpointLocation", f"{out.rstrip('/')}/_checkpoint").trigger(availableNow=True).start()


def check(spark: SparkSession, out: str, schema: StructType | str) -> int:
    """The number of rows in the recorded batches; raises if a batch has other files than its record says, or another number of rows."""
    done = committed(spark, out)
    for r in done:
        at, fs = _path(spark, out, f"batch={r['batch']}")
        found = {s.getPath().getName(): s.getLen() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-")}
        if found != r["files"]:
            raise ValueError(f"batch {r['batch']} has other files than its record")
    counts = {r["batch"]: r["count"] for r in read(spark, out, schema).groupBy("batch").count().collect()}
    bad = [r["batch"] for r in done if counts.get(r["batch"], 0) != r["rows"]]
    if bad:
        raise ValueError(f"batches with another number of rows than recorded: {bad}")
    return reduce(lambda n, r: n + r["rows"], done, 0)
