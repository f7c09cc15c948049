"""The corpus pipeline: documents in, packed token windows out.

Each stage takes what its predecessor kept, works on all of it and returns the columns of documents; the last returns packed pieces. run() writes
every stage's result to the shared folder before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, jaccard, langid, pack, shared, suffixes

STAGES = [
    ("language ID", langid.keep_identified),
    ("n-gram Jaccard join", jaccard.keep_one_of_each),
    ("suffix-array dedup", suffixes.drop_repeats),
    ("benchmark decontamination", decontaminate.remove_contaminated),
    ("packing", pack.pack_stage),
]

#: Trained models, suffix arrays and tokenizers are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.cut(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
