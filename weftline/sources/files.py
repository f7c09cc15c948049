"""JSON lines, prediction ledgers, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation

LEDGER = "case_id string, source_group string, request_sha256 string, expected string, raw_choice string, choice string, probabilities map<string,double>, latency_ms double"


BROKEN = "_broken_line"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped; only CR and LF end a line (SRC-7, SRC-8). A line that is no such object raises, with its file and its begin, once it is read."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    read = lines.select("value", "file", F.from_json("value", f"{schema}, {BROKEN} string", {"columnNameOfCorruptRecord": BROKEN}).alias("x"))
    names = [f for f in read.schema["x"].dataType.fieldNames() if f != BROKEN]
    found = F.struct(*(F.col(f"x.`{f}`").alias(f) for f in names))
    why = F.concat("file", F.lit(": broken line: "), F.substring("value", 1, 80))
    kind = read.select(found.alias("x")).schema["x"].dataType
    fine = F.when(F.col(f"x.{BROKEN}").isNull() & F.col("x").isNotNull(), found).otherwise(F.raise_error(why).cast(kind))
    return read.select(fine.alias("x")).select("x.*")


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Compact, non-ASCII kept, keys in the columns' order (SRC-9)."""
    cols = [c for c in df.columns if c not in (partition_by or [])]
    out = df.select(*(partition_by or []), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).text(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger's rows, probabilities renormed; raises with file and case at the first row that breaks a rule (SRC-14)."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.from_json("value", LEDGER).alias("r"))
    rows = rows.select("file", "r.*")
    if rows.limit(1).count() == 0:
        raise ValueError("prediction ledger is empty")
    twice = F.count(F.lit(1)).over(Window.partitionBy("case_id")) > 1
    error = F.coalesce(evaluation.ledger_error({c: F.col(c) for c in rows.columns}), F.when(F.col("twice"), "duplicate case_id"))
    bad = rows.withColumn("twice", twice).withColumn("error", error).where("error IS NOT NULL").select("file", "case_id", "error").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file}: {bad[0].case_id}: {bad[0].error}")
    return rows.drop("file").withColumn("probabilities", evaluation.renormed(F.col("probabilities")))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the files below a path, names relative to it, hashed in blocks of a MiB (SRC-12). Empty files and files whose names begin with . or _ do not count."""
    from . import sink  # which writes what this module reads

    top = path.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")  # noqa: E731  a store's name may stand before one path and not before the other
    name = F.substring(plain(F.col("path")), F.length(plain(F.lit(top))) + 2, F.lit(1 << 30))
    return sink.digests(listed.repartition(max(1, min(10_000, len(listed.inputFiles()))))).select(name.alias("name"), "sha256")


def check_manifest(spark: SparkSession, path: str, expected: dict[str, str]) -> None:
    """Raises for files that are missing or differ from the manifest (SRC-11)."""
    want = spark.createDataFrame(list(expected.items()), "name string, sha256 string")
    bad = [r[0] for r in want.join(file_digests(spark, path), ["name", "sha256"], "left_anti").select("name").collect()]
    if bad:
        raise ValueError(f"files that differ from the manifest: {sorted(bad)}")
