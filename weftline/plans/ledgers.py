"""A ledger of scored decisions derived from the tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as E


def h32(text: str) -> str:
    return f"cast('0x' || substr(sha256({text}), 1, 8) as bigint)"


def ledger(spark: SparkSession, sf_dir: str, salt: str = "") -> DataFrame:
    """Each labelled document as a decision between 0 and 1 with hashed logits, a soft target, and the fields of a prediction ledger."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("source_group"), F.col("lang").alias("workflow"))
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("q")).where("q IS NOT NULL").join(docs, "doc_id")
    rows = rows.withColumn("h", E.hash32(F.concat(F.lit(salt), F.col("doc_id").cast("string"))))
    rows = rows.withColumn("z", (F.col("h") % 1000 - 500) / F.lit(250.0) + F.lit(1.2) * (2 * F.col("q") - 1)).withColumn("t", F.lit(0.05) + F.lit(0.9) * F.col("q"))
    rows = rows.select(
        F.col("doc_id").cast("string").alias("case_id"),
        "source_group",
        "workflow",
        F.when(F.col("h") % 3 == 0, "noul").otherwise("choice").alias("question_type"),
        F.array(F.lit("0"), F.lit("1")).alias("ids"),
        F.array(F.lit(0.0), F.col("z")).alias("logits"),
        F.array(1 - F.col("t"), F.col("t")).alias("target"),
        "q",
        "h",
    )
    p = E.softmax(F.col("logits"))
    rows = rows.withColumn("p", p)
    return rows.withColumns(
        {
            "request_sha256": F.sha2(F.col("case_id").cast("binary"), 256),
            "expected": F.col("q").cast("string"),
            "raw_choice": F.element_at("ids", E.argmax(F.col("p"))),
            "choice": F.when(F.array_max("p") >= 0.7, F.element_at("ids", E.argmax(F.col("p")))),
            "probabilities": F.map_from_arrays("ids", "p"),
            "latency_ms": (F.col("h") % 500 + 1).cast("double"),
        }
    )


def ledger_sql(name: str = "led", salt: str = "") -> str:
    """The same as a list of CTEs; scalars p0, p1 stand for the array."""
    return f"""
{name}_a AS (SELECT cast(l.doc_id as varchar) AS case_id, d.source AS source_group, d.lang AS workflow, l.quality AS q, {h32(f"'{salt}' || cast(l.doc_id as varchar)")} AS h
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL),
{name}_b AS (SELECT *, (h % 1000 - 500) / 250.0E0 + 1.2E0 * (2 * q - 1) AS z, 0.05E0 + 0.9E0 * q AS t1, CASE WHEN h % 3 = 0 THEN 'noul' ELSE 'choice' END AS kind FROM {name}_a),
{name}_c AS (SELECT *, exp(0 - greatest(0, z)) AS e0, exp(z - greatest(0, z)) AS e1, 1 - t1 AS t0 FROM {name}_b),
{name} AS (SELECT *, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1, CASE WHEN z > 0 THEN 1 ELSE 0 END AS pred, CASE WHEN z > 0 THEN e1 ELSE e0 END / (e0 + e1) AS conf,
  CAST(h % 500 + 1 AS DOUBLE) AS latency_ms FROM {name}_c)"""
