"""The real-world check in one call (HX-13): pages of unseen hosts, scored, held against their own labels, with a sample for review.

    out/pages      the fresh pages, parsed                 written once
    out/labelled   the decisions whose labels they carry   written once
    out/items      what the scorer is asked                written once
    out/scores     its answers, batch by batch             `streaming.resume`
    out/review     a sample for people, JSON lines         written anew
    out/report     the numbers, JSON                       written anew

Each step is skipped where its output is complete, so a call that was stopped goes on where it was: pages are not read, and items are not scored, again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import exprs as E
from ..operators import dataset as D
from ..operators import pages as P
from ..operators import training as R
from ..operators import typed as T
from ..sources import files
from ..streaming import resume
from . import build

SCORED = "page_id string, decision string, answer string, confidence double"


def _once(spark: SparkSession, path: str, made: Callable[[], DataFrame]) -> DataFrame:
    """A table that is written unless it is there whole: Spark's writers say so with a file of their own."""
    at, fs = resume._path(spark, path, "_SUCCESS")
    if not fs.exists(at):
        made().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def asked(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """items(item_id, page_id, decision, kind, state, text, ids, texts): two decisions of every page, the others where the page offers options (PF-15)."""
    state = F.to_json(F.struct("url", "title", "page"))
    tables = {"page_type": K.PAGE_TYPES, "page_status": K.PAGE_STATUS}
    fixed = F.array(*(F.struct(F.lit(d).alias("decision"), F.lit(K.QUESTIONS[d]).alias("text"), P.options_of(o).alias("candidates")) for d, o in tables.items()))
    every = pages.select("page_id", state.alias("state"), F.explode(fixed).alias("q")).select("page_id", "state", "q.*")
    own = labelled.where(~F.col("decision").isin(*tables)).select("page_id", "decision", F.col("question").alias("text"), "candidates").join(pages.select("page_id", state.alias("state")), "page_id")
    items = every.unionByName(own)
    return items.select(F.concat_ws("::", "page_id", "decision").alias("item_id"), "page_id", "decision", F.lit("choice").alias("kind"), "state", "text", F.col("candidates.id").alias("ids"), F.col("candidates.text").alias("texts"))


def _score(scorer: T.Scorer, orders: int, temperature: float) -> Callable[[DataFrame], DataFrame]:
    def stage(batch: DataFrame) -> DataFrame:
        done = T.score(batch, scorer, orders=orders, temperature=temperature)
        return done.select("page_id", "decision", F.element_at("ids", E.argmax(F.col("p"))).alias("answer"), F.array_max("p").alias("confidence"))

    return stage


def against_labels(scores: DataFrame, labelled: DataFrame, sure: float) -> DataFrame:
    """AG-7, AG-8: by decision: rows, accuracy, what always giving the commonest label would score, the share and accuracy of confident answers, eight confusions."""
    gold = labelled.select("page_id", "decision", E.gold_set(F.col("candidates.id"), F.col("target")).alias("gold"))
    rows = scores.join(gold, ["page_id", "decision"]).withColumns({"label": F.array_min("gold"), "right": F.array_contains("gold", F.col("answer"))})
    confident = F.col("confidence") >= sure
    sums = rows.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("right").cast("double")).alias("accuracy"), F.avg(confident.cast("double")).alias("confident_share"), F.avg(F.when(confident, F.col("right").cast("double"))).alias("confident_accuracy"))
    labels = rows.groupBy("decision", "label").count().groupBy("decision").agg((F.max("count") / F.sum("count")).alias("baseline"))
    wrong = rows.where(~F.col("right")).groupBy("decision", F.concat_ws(" -> ", "label", "answer").alias("what")).count()
    top = wrong.groupBy("decision").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "what"))), 1, 8).alias("top"))  # pairs of labels, few
    return sums.join(labels, "decision").join(top, "decision", "left").select("decision", "n", "accuracy", "baseline", "confident_share", "confident_accuracy", F.transform("top", lambda x: F.struct(x["what"].alias("what"), (-x["n"]).alias("n"))).alias("confusions"))


def over_all(scores: DataFrame, pages: DataFrame, sure: float) -> DataFrame:
    """AG-9: how often each answer is given to the two decisions of every page, and how often confidently; page types of pages with status 200."""
    ok = pages.where("http_status = 200").select("page_id")
    types = scores.where("decision = 'page_type'").join(ok, "page_id", "left_semi")
    rows = types.unionByName(scores.where("decision = 'page_status'"))
    return rows.groupBy("decision", "answer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= sure).alias("confident"))


def check(found: DataFrame, known_hosts: DataFrame, scorer: T.Scorer, out: str, *, per_host: int = 2, per_file: int = 800, review: int = 150, seed: int = 7, sure: float = 0.9, orders: int = 1, temperature: float = 1.0, files_per_batch: int = 64, before_commit: Callable[[int], None] | None = None) -> dict:
    """The whole check of pages(warc_file, seq, url, html, http_status, detected_language) whose hosts are not known; returns the report."""
    spark, out = found.sparkSession, out.rstrip("/")
    page_id = F.concat_ws("#", "warc_file", "seq")
    pages = _once(spark, f"{out}/pages", lambda: build.fresh_pages(found, known_hosts, per_host=per_host, per_file=per_file).withColumn("page_id", page_id))
    labelled = _once(spark, f"{out}/labelled", lambda: P.parsed_rows_v1(pages, keep=("page_id",)))
    items = _once(spark, f"{out}/items", lambda: asked(pages, labelled))
    came = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{out}/items")
    resume.append(came, _score(scorer, orders, temperature), f"{out}/scores", before_commit=before_commit).awaitTermination()
    scored = resume.check(spark, f"{out}/scores", SCORED)
    scores = resume.read(spark, f"{out}/scores", SCORED)
    plain: Callable[[Column], Column] = lambda c: F.round(c, 4)
    report = {
        "pages": pages.count(),
        "sites": pages.select("host").distinct().count(),
        "decisions_scored": scored,
        "against_automatic_labels": {r["decision"]: {k: v for k, v in r.asDict(True).items() if k != "decision"} for r in against_labels(scores, labelled, sure).withColumns({c: plain(F.col(c)) for c in ("accuracy", "baseline", "confident_share", "confident_accuracy")}).collect()},
        "all_pages": {},
    }
    for r in over_all(scores, pages, sure).orderBy(F.desc("n"), "answer").collect():  # a row for each answer
        part = report["all_pages"].setdefault(r["decision"], {"n": 0, "answers": {}, "confident_answers": {}})
        part["n"] += r["n"]
        part["answers"][r["answer"]] = r["n"]
        if r["confident"]:
            part["confident_answers"][r["answer"]] = r["confident"]
    drawn = D.sample_n(pages.select("page_id", "url", "http_status", "title", F.substring("page", 1, 700).alias("page")), review, "page_id", seed)
    model = scores.join(F.broadcast(drawn.select("page_id")) if review <= 10_000 else drawn.select("page_id"), "page_id", "left_semi").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("decision", F.struct("answer", F.round("confidence", 4).alias("confidence"))))).alias("model"))
    gold = labelled.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("decision", F.array_sort(E.gold_set(F.col("candidates.id"), F.col("target")))))).alias("automatic_labels"))
    files.write_jsonl(drawn.join(model, "page_id").join(gold, "page_id", "left").drop("page_id"), f"{out}/review")
    spark.createDataFrame([(json.dumps(report, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return report


def pending_items(spark: SparkSession, out: str) -> DataFrame:
    """SRC-16: what a check that was stopped has still to score."""
    done = resume.read(spark, f"{out.rstrip('/')}/scores", SCORED).select("page_id", "decision")
    return R.pending(spark.read.parquet(f"{out.rstrip('/')}/items"), done, ["page_id", "decision"])
