"""The two dataset builders, end to end: labelled rows to capped, split, balanced JSON lines with a manifest."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import exprs as E
from ..operators import dataset as D
from ..operators import evaluation as V
from ..operators import pages as P
from ..operators import training as R
from ..operators import typed as T
from ..sources import files, sink, stages

ROW = ("case_id", "source_group", "workflow", "state", "question", "question_type", "candidates", "target", "label_source", "label_quality")


def split_rows(rows: DataFrame, seed: int) -> DataFrame:
    """Adds split, decision and label to decision rows; groups stay whole."""
    return rows.withColumns(
        {
            "split": E.split_of(F.col("source_group"), seed),
            "decision": E.decision_of(F.col("case_id")),
            "label": E.gold_label(F.col("candidates.id"), F.col("target")),
        }
    )


def manifest(rows: DataFrame, name: str, revision: str | None = None, **extra) -> dict:
    """AG-14, DS-12: counts, labels and an order-free digest of each split, and the revision made of the digests."""
    text = F.to_json(F.struct(*(c for c in ROW if c in rows.columns)))
    parts = {r["split"]: r for r in D.split_manifest(rows.withColumn("_row", text), F.col("_row")).collect()}  # at most a row for each split
    labels = rows.groupBy("split", "decision", "label").agg(F.count(F.lit(1)).alias("n"))
    # options of a page's own (dates, prices) count by their place, so there are few labels
    found: dict[str, dict[str, int]] = {}
    for r in labels.orderBy("split", "decision", "label").collect():
        found.setdefault(r["split"], {})[f"{r['decision']}={r['label']}"] = r["n"]
    quality: dict[str, dict[str, int]] = {}
    for r in rows.groupBy("split", F.coalesce("label_quality", F.lit("none")).alias("q")).count().collect():
        quality.setdefault(r["split"], {})[r["q"]] = r["count"]
    counts = {}
    for split, _ in K.SPLIT_SHARES:
        p = parts.get(split)
        counts[split] = {
            "decision_cases": p["rows"] if p else 0,
            "source_groups": p["source_groups"] if p else 0,
            "labels": found.get(split, {}),
            "label_quality": quality.get(split, {}),
            "sha256": p["digest"] if p else hashlib.sha256(b"").hexdigest(),
        }
    revision = revision or hashlib.sha256("".join(counts[s]["sha256"] for s, _ in K.SPLIT_SHARES).encode()).hexdigest()[:16]
    return {"dataset": name, "revision": revision, "split_unit": "whole hosts", **extra, "split_counts": counts}


def collect_v0(pages: DataFrame, *, per_host: int = 20, non_product_keep: float = 1.0) -> DataFrame:
    """DS-3: the rows of labelled pages(warc_file, seq, url, html): hosts only, other than products by hash, the first of each URL over all files,
    and the first so many pages of each host as they come (WN-4, WN-5, PF-6)."""
    at = ["warc_file", "seq"]
    rows = P.page_rows_v0(pages.where(E.host_of(F.col("url")) != ""), keep=tuple(at))
    rows = stages.cut(rows, "rows")
    product = (F.col("decision") == "page_type") & (E.gold_label(F.col("candidates.id"), F.col("target")) == "product")
    one = rows.groupBy(*at, "url", "source_group").agg(F.max(product.cast("int")).alias("product"))
    kept = one.where(E.keep_by_hash(F.col("url"), non_product_keep, (F.col("product") == 1) | F.lit(non_product_keep >= 1)))
    kept = D.running_cap(D.first_wins(kept, ["url"], at), "source_group", at, per_host)
    return rows.join(kept.select(*at, "url"), [*at, "url"], "left_semi").drop(*at)


def fresh_pages(pages: DataFrame, known_hosts: DataFrame, *, per_host: int, per_file: int) -> DataFrame:
    """DS-13, PF-14: parsed pages(warc_file, seq, url, html, ...) of hosts outside known_hosts(host) that are not thin: so many of a host
    in each file, so many of each file, as they come."""
    parsed = P.parse_v1(pages).withColumn("host", E.host_of(F.col("url"))).where((F.col("host") != "") & (F.length("page") >= 200))
    fresh = parsed.join(known_hosts.select("host").distinct(), "host", "left_anti")
    w = Window.partitionBy("warc_file", "host").orderBy("seq")
    few = fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_host).drop("_n")
    return D.running_cap(few, "warc_file", ["seq"], per_file)


def write_dataset(rows: DataFrame, out: str, name: str, **extra) -> dict:
    """Decision rows with split, decision and label as JSON lines, a folder for each split, committed by a manifest with every file's digest. Returns the manifest."""
    rows = stages.cut(rows, "dataset")
    made = manifest(rows, name, **extra)
    return sink.write(rows.select("split", *(c for c in ROW if c in rows.columns)), out, "split", made)


def build_v1(rows: DataFrame, out: str, *, seed: int = 1, pages_per_host: int = 20, page_type_ratio: float = 3.0, ok_ratio: float = 3.0, per_language: int = 1500) -> dict:
    """DS-4 to DS-6: at most so many pages of a host, whole hosts to splits, every split balanced. Returns the manifest that is written."""
    rows = stages.cut(rows.withColumn("_url", E.url_of_case(F.col("case_id"))), "rows")
    kept = split_rows(D.cap_pages(rows, "source_group", "_url", pages_per_host, seed).drop("_url"), seed)
    args = {"page_type_ratio": page_type_ratio, "ok_ratio": ok_ratio, "per_language": per_language}
    return write_dataset(D.balance_v1(stages.cut(kept, "kept"), seed=seed, **args), out, "web-expert", balance=args)


def build_v0(rows: DataFrame, out: str, *, seed: int = 1, max_ratio: float = 3.0, old: DataFrame | None = None, mix_ratio: float = 0.0) -> dict:
    """DS-7: train alone is balanced, and takes rows of an old set up to a share."""
    kept = stages.cut(split_rows(rows, seed), "rows")
    train = kept.where("split = 'train'")
    if max_ratio > 0:
        train = D.balance_v0(train, seed=seed, max_ratio=max_ratio)
    if old is not None and mix_ratio > 0:
        train = D.mix(stages.cut(train, "train"), split_rows(old, seed).withColumn("split", F.lit("train")), mix_ratio, key="case_id", seed=seed)
    return write_dataset(train.unionByName(kept.where("split <> 'train'"), allowMissingColumns=True), out, "web-decisions", mix_ratio=mix_ratio)


def merge(spark: SparkSession, paths: list[str], out: str) -> dict:
    """DS-8: written datasets, split by split. Raises if a file of one is not what its manifest says, and for a group in two splits.

    The revision is made of the inputs' revisions, not of their rows.
    """
    given = [sink.check(spark, p) for p in paths]
    rows = D.merged([sink.read(spark, p) for p in paths])
    rows = rows.withColumns({"decision": E.decision_of(F.col("case_id")), "label": E.gold_label(F.col("candidates.id"), F.col("target"))})
    revision = hashlib.sha256("".join(m["revision"] for m in given).encode()).hexdigest()[:16]
    return write_dataset(rows, out, "merged", revision=revision, inputs=[m["revision"] for m in given])


def label_checked(rows: DataFrame, judged: DataFrame, base: dict, out: str, *, judge: str = "judge") -> dict:
    """DS-15: a dataset's rows (with split, decision, label) without those whose label a judge's ranking(case_id, order) does not bear out, written
    with the dataset's manifest patched: counts, labels and digests anew, the rest as it was, and the report of what was kept."""
    j = judged.select(F.col("case_id").alias("_c"), "order")
    checked = stages.cut(rows.join(j, F.col("case_id") == F.col("_c"), "left").withColumn("_keep", R.label_kept(F.col("label"), F.col("label_quality"), F.col("order"))).drop("_c", "order"), "checked")
    key = F.concat(F.col("decision"), F.lit("="), "label", F.lit("|"), F.coalesce("label_quality", F.lit("none")))
    report = {r["key"]: {"kept": r["kept"], "dropped": r["dropped"]} for r in checked.groupBy(key.alias("key")).agg(F.count_if("_keep").alias("kept"), F.count_if(~F.col("_keep")).alias("dropped")).collect()}
    made = write_dataset(checked.where("_keep").drop("_keep"), out, base["dataset"] + "-checked", **{k: v for k, v in base.items() if k not in ("dataset", "split_counts", "revision", "split_unit", "files", "schema", "partition_by")}, label_check={"judge": judge, "report": report})
    return made


def evaluate(rows: DataFrame, scorer: T.Scorer, out: str) -> dict:
    """HX-10: a dataset's rows(split, case_id, source_group, workflow, question_type, question, state, candidates, target) scored, temperatures fitted on
    calibration, metrics of test before and after, how many answers an order reversal changes, and the test ledger written as JSON lines."""
    kind = F.coalesce("question_type", F.lit("choice"))
    items = rows.where("split IN ('calibration', 'development', 'test')").withColumns({"item_id": F.col("case_id"), "kind": kind, "text": F.col("question"), "ids": F.col("candidates.id"), "texts": F.col("candidates.text")})
    items = items.withColumn("state", F.col("state").cast("string") if dict(items.dtypes)["state"] == "string" else F.to_json("state"))
    one = T.score(items, scorer).withColumnRenamed("p", "p1")
    flipped = T.score(one.withColumn("texts", F.reverse("texts")), scorer).withColumnRenamed("p", "p2").withColumn("texts", F.reverse("texts")).withColumn("p2", F.reverse("p2"))
    log = lambda c: F.transform(c, lambda p: F.ln(F.greatest(p, F.lit(1e-12))))
    mean = F.zip_with("p1", "p2", lambda a, b: (a + b) / 2)
    scored = stages.cut(flipped.withColumns({"logits": log(F.col("p1")), "averaged": log(mean), "flip": (E.argmax(F.col("p1")) != E.argmax(F.col("p2"))).cast("int")}), "scored")
    part = {s: scored.where(F.col("split") == s) for s in ("calibration", "development", "test")}
    fitted = V.fit_temperature(part["calibration"]).first()
    if fitted is None or fitted["temperature"] is None:
        raise ValueError("no calibration rows")
    by_type = {r["question_type"]: r["temperature"] for r in V.fit_temperature(part["calibration"].withColumn("question_type", kind), ["question_type"]).collect()}
    of = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in by_type.items() for x in kv)), kind), F.lit(1.0))
    table = lambda df, t=1.0: {r["key"]: {k: r[k] for k in ("decisions", "accuracy", "soft_ce", "brier", "ece")} for r in V.metrics(df, t).collect()}  # noqa: E731  a row for each workflow and type
    test = part["test"]
    p = E.softmax(F.col("logits"), F.lit(fitted["temperature"]))
    raw = F.element_at("ids", E.argmax(F.col("_p")))
    request = F.concat(F.lit('{"question":'), F.to_json(F.struct(F.map_from_entries(F.col("candidates")).alias("criteria"), F.col("question").alias("instructions"), F.lit("choice").alias("type"))), F.lit(',"state":'), F.when(F.col("state").rlike(r"^\s*[\[{]"), F.col("state")).otherwise(F.to_json(F.array("state"))), F.lit("}"))
    ledger = test.withColumn("_p", p).select("case_id", "source_group", request.alias("_request"), E.gold_label(F.col("ids"), F.col("target")).alias("expected"), raw.alias("raw_choice"), raw.alias("choice"), F.map_from_arrays("ids", "_p").alias("probabilities"), F.map_from_arrays("ids", "target").alias("teacher_target"))
    digests = R.request_digests(ledger, "case_id", "_request")
    files.write_jsonl(ledger.drop("_request").join(digests, "case_id").withColumn("latency_ms", F.lit(0.0)), out)
    return {
        "temperature": fitted["temperature"],
        "temperature_by_type": by_type,
        "test_uncalibrated": table(test),
        "test_calibrated": table(test, fitted["temperature"]),
        "test_calibrated_by_type": table(test, of),
        "test_order_averaged_uncalibrated": table(test.withColumn("logits", F.col("averaged"))),
        "development_uncalibrated": table(part["development"]).get("all"),
        "order_reversal_argmax_change_fraction": test.agg(F.avg("flip")).first()[0],
        "selective_uncalibrated": {r["threshold"]: {"coverage": r["coverage"], "accepted_accuracy": r["accepted_accuracy"]} for r in V.selective(test).collect()},
    }


def prepare_benchmark(train: DataFrame, test: DataFrame, out: str, *, types: tuple[str, ...] = ("choice",), seed: int = 1, name: str = "benchmark") -> dict:
    """HX-12, DS-9, DS-10: cases(id, workflow, state, questions, gold) of a benchmark's own train and test parts as a dataset. Train's cases are split before their questions
    are expanded, a tenth of each workflow to development and to calibration; so the split is the same for any question types. Raises where a case is in two splits."""
    cols = ["id", "workflow", "state", "questions", "gold"]
    dealt = stages.cut(D.stratified_split(train.select(*cols), stratum="workflow", key="id", seed=seed).select(*cols, "split").unionByName(test.select(*cols).withColumn("split", F.lit("test"))), "cases")
    splits = [s for s, _ in K.SPLIT_SHARES]
    parts = [T.benchmark_rows(dealt.where(F.col("split") == s), types).withColumn("split", F.lit(s)) for s in splits]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    named = {"decision": E.decision_of(F.col("case_id")), "label": E.gold_label(F.col("candidates.id"), F.col("target")), "label_quality": F.lit(None).cast("string")}
    rows = stages.cut(rows.withColumns(named), "benchmark")
    leaking = D.leaking_groups(rows).select("source_group").limit(5).collect()
    if leaking:
        raise ValueError(f"cases in more than one split: {[r[0] for r in leaking]}")
    about = {"split_unit": "whole cases, stratified by workflow before their questions are expanded", "label_source": "teacher distributions; agreement is not ground-truth correctness", "seed": seed, **({} if types == ("choice",) else {"question_types": list(types)})}
    return write_dataset(rows, out, name, **about)
