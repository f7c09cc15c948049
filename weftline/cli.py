"""Command line: decide, compare, validate-request, build, merge, prepare, realworld, smoke (SV-2, HX-11 to HX-13). Each prints one JSON object."""

from __future__ import annotations

import argparse
import itertools
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluation, fitting, pages, typed
from .plans import build as plans
from .plans import realworld as plan_realworld
from .sources import files, sink, stages, warc


def session() -> SparkSession:
    return SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def decide(spark: SparkSession, body: str, orders: int = 1) -> dict:
    """The answers to one request (SC-5); errors by question."""
    rows = typed.predict(spark.createDataFrame([(0, body)], "request_id long, body string"), typed.OverlapScorer(), orders=orders)
    out: dict = {"answers": {}, "errors": {}}
    for r in rows.select("qid", F.to_json("answer").alias("answer"), "error").collect():
        if r.error is None:
            out["answers"][r.qid] = json.loads(r.answer)
        else:
            out["errors"][r.qid or "request"] = r.error
    return out


def compare(spark: SparkSession, baseline: str, candidate: str, samples: int = 2000, seed: int = 17) -> dict:
    """Both ledgers' summaries and the paired difference (JN-2, AG-17); raises for ledgers that do not fit."""
    a, b = files.read_ledger(spark, baseline), files.read_ledger(spark, candidate)
    pairs = evaluation.paired(a, b)
    bad = pairs.where("problem IS NOT NULL").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].case_id}: {bad[0].problem}")
    d = evaluation.bootstrap(pairs, samples, seed).first()
    interval = None if d.low is None else [d.low, d.high]
    return {"baseline": evaluation.summarize(a).first().asDict(), "candidate": evaluation.summarize(b).first().asDict(), "accuracy_delta": d.accuracy_delta, "interval": interval, "bootstrap_samples": samples, "seed": seed}


def build(spark: SparkSession, path: str, out: str, *, max_pages: int = 40_000, errors: str | None = None, **settings) -> dict:
    """The whole builder (HX-11): all WARC files below a path, and the pages of other statuses below `errors`, to labelled rows, capped, split, balanced and
    written with a manifest. Files that could not be read are a dataset of their own, `out`.failed, however many; the result has their number and the first names."""
    scans = [warc.scan_pages(spark, path, max_pages=max_pages)]
    if errors:
        scans.append(warc.scan_pages(spark, errors, errors_only=True, max_pages=max_pages))
    found = stages.cut(scans[0] if len(scans) == 1 else scans[0].unionByName(scans[1]), "pages")
    failed = found.where("error IS NOT NULL").groupBy("warc_file").agg(F.min("error").alias("error"))
    told = sink.write(failed, f"{out.rstrip('/')}.failed")
    first = [r["warc_file"] for r in sink.read(spark, f"{out.rstrip('/')}.failed").orderBy("warc_file").limit(100).collect()]
    rows = pages.page_rows_v1(found.where("error IS NULL").drop("error").withColumnRenamed("status", "http_status"))
    return plans.build_v1(rows, out, **settings) | {"failed_warcs": first, "failed": sum(f["rows"] for f in told["files"].values())}


def smoke(spark: SparkSession) -> dict:
    """MD-9: mechanics on made-up rows, no benchmark of meaning: all 24 orders of four options give each its own probability, and a small head's loss falls."""
    words = ("red apple", "blue sky", "green leaf", "old house")
    orders = list(itertools.permutations(range(4)))
    rows = [(str(k), "choice", "a red blue leaf on a house", "Which?", [str(i) for i in order], [words[i] for i in order]) for k, order in enumerate(orders)]
    items = spark.createDataFrame(rows, "item_id string, kind string, state string, text string, ids array<string>, texts array<string>")
    scored = [dict(zip(r.ids, r.p, strict=True)) for r in typed.score(items, typed.OverlapScorer(0.3), orders=4).collect()]
    worst = max(abs(s[i] - scored[0][i]) for s in scored for i in s)
    made = [(f"{k}", words[k % 4], "Which?", list(words), [1.0 if i == k % 4 and k % 8 < 6 else 0.0 for i in range(4)]) for k in range(64)]
    train = spark.createDataFrame(made, "item_id string, state string, text string, texts array<string>, target array<double>")
    _, history = fitting.fit(train, train, fitting.Settings(dims=1024, bias=64, epochs=3))
    passed = worst < 1e-9 and history[-1]["train"] < history[0]["train"]
    if not passed:
        raise RuntimeError(f"smoke checks failed: {worst}, {history}")
    return {"scope": "made-up rows, mechanics only", "permutations_checked": len(orders), "max_permutation_difference": worst, "losses": [h["train"] for h in history], "passed": passed}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("decide", "validate-request"):
        s = sub.add_parser(name)
        s.add_argument("file")
        s.add_argument("--orders", type=int, default=1)
    s = sub.add_parser("compare")
    s.add_argument("baseline")
    s.add_argument("candidate")
    s.add_argument("--samples", type=int, default=2000)
    s = sub.add_parser("build")
    s.add_argument("path")
    s.add_argument("out")
    s.add_argument("--errors", help="WARC files of responses with other statuses")
    s.add_argument("--max-pages", type=int, default=40_000, help="pages of a file")
    s.add_argument("--pages-per-host", type=int, default=20)
    s.add_argument("--page-type-ratio", type=float, default=3.0)
    s.add_argument("--ok-ratio", type=float, default=3.0)
    s.add_argument("--per-language", type=int, default=1500)
    s.add_argument("--seed", type=int, default=1)
    sub.add_parser("smoke")
    s = sub.add_parser("merge")
    s.add_argument("out")
    s.add_argument("datasets", nargs="+")
    s = sub.add_parser("prepare", help="a benchmark's cases, parquet, to a dataset")
    for name in ("train", "test", "out"):
        s.add_argument(name)
    s.add_argument("--question-types", default="choice")
    s.add_argument("--seed", type=int, default=1)
    s = sub.add_parser("realworld", help="WARC files of hosts outside a dataset, scored and held against their labels")
    for name in ("path", "dataset", "out"):
        s.add_argument(name)
    s.add_argument("--errors")
    s.add_argument("--pages-per-warc", type=int, default=800)
    s.add_argument("--per-host", type=int, default=2)
    s.add_argument("--review", type=int, default=150)
    s.add_argument("--seed", type=int, default=7)
    a = p.parse_args(argv)
    spark = session()
    if a.what in ("decide", "validate-request"):
        with open(a.file, encoding="utf-8") as f:
            body = f.read(2_000_001)
        if len(body) > 2_000_000:
            raise ValueError("request is larger than 2 MB")
        out = decide(spark, body, a.orders)
        if a.what == "validate-request":
            out = {"valid": not out["errors"], "errors": out["errors"]}
    elif a.what == "compare":
        out = compare(spark, a.baseline, a.candidate, a.samples)
    elif a.what == "smoke":
        out = smoke(spark)
    elif a.what == "merge":
        out = plans.merge(spark, a.datasets, a.out)
    elif a.what == "prepare":
        out = plans.prepare_benchmark(spark.read.parquet(a.train), spark.read.parquet(a.test), a.out, types=tuple(x.strip() for x in a.question_types.split(",") if x.strip()), seed=a.seed)
    elif a.what == "realworld":
        found = warc.read_pages(spark, a.path)
        if a.errors:
            found = found.unionByName(warc.read_pages(spark, a.errors, errors_only=True))
        known = sink.read(spark, a.dataset).select(F.col("source_group").alias("host")).distinct()
        out = plan_realworld.check(found.withColumnRenamed("status", "http_status"), known, typed.OverlapScorer(), a.out, per_host=a.per_host, per_file=a.pages_per_warc, review=a.review, seed=a.seed)
    else:
        settings = {k: getattr(a, k) for k in ("pages_per_host", "page_type_ratio", "ok_ratio", "per_language", "seed")}
        out = build(spark, a.path, a.out, max_pages=a.max_pages, errors=a.errors, **settings)
    print(json.dumps(out, ensure_ascii=False, allow_nan=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
