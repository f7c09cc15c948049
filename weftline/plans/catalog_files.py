"""Queries over files and whole builders: what they write to the shared folder is read back and held against SQL over the tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import dataset as D
from ..operators import evaluation as V
from ..operators import pages as P
from ..operators import training as R
from ..operators import typed as T
from ..sources import files, sink, stages, warc
from ..streaming import pages as stream
from . import build
from . import page_sql as S
from .catalog import HOST, LED, LED2, QUERIES, R6, SQL, WARC_FILE, built_sql, query, split_sql, warc_names, write_warcs

__all__ = ["QUERIES", "SQL"]  # the whole catalogue


@query(SQL["q33_summary"])
def q73_ledger_file(t):
    """SRC-14, SRC-15, EV-1: a ledger written as JSON lines, read back with every rule checked, and summed up."""
    path = stages.folder(t.spark, "ledger")
    files.write_jsonl(t.L.select("case_id", "source_group", "request_sha256", "expected", "raw_choice", "choice", "probabilities", "latency_ms"), path)
    s = V.summarize(stages.cut(files.read_ledger(t.spark, path), "ledger"))
    return s.select("cases", "source_groups", *(R6(c).alias(c) for c in s.columns if c not in ("cases", "source_groups")))


def _counted(t, path: str):
    return sink.read(t.spark, path).select("split", E.decision_of(F.col("case_id")).alias("decision"), "source_group", "case_id").groupBy("split", "decision").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source_group").alias("source_groups"), F.min("case_id").alias("least"), F.max("case_id").alias("most"))


_COUNTED = "SELECT split, decision, count(*) AS rows, count(DISTINCT host) AS source_groups, min(case_id) AS least, max(case_id) AS most FROM kept GROUP BY ALL"


@query(f"WITH {built_sql(3, 1.0, 1.0, 5)} {_COUNTED}")
def q74_builder_v1(t):
    """DS-4 to DS-6, SRC-9 to SRC-12: the dataset written with its manifest; its files are hashed again, and its counts held against the rows read back."""
    path = stages.folder(t.spark, "v1")
    made = build.build_v1(P.page_rows_v1(S.furnished(t.pages)), path, pages_per_host=3, page_type_ratio=1.0, ok_ratio=1.0, per_language=5)
    sink.check(t.spark, path)
    total = sum(c["decision_cases"] for c in made["split_counts"].values())
    if total != sum(f["rows"] for f in made["files"].values()):
        raise ValueError("the manifest's splits and files have different numbers of rows")
    return _counted(t, path)


_V0 = f"""{S.rows_v0()}, hosted AS (SELECT page_id, url, {HOST} AS host, url || '::' || decision AS case_id, decision, gold AS label, page_id % 3 AS file FROM row),
firsts AS (SELECT url, host, file, page_id FROM (SELECT DISTINCT url, host, file, page_id FROM hosted WHERE host <> '') QUALIFY row_number() OVER (PARTITION BY url ORDER BY file, page_id) = 1),
few AS (SELECT url, file, page_id FROM firsts QUALIFY row_number() OVER (PARTITION BY host ORDER BY file, page_id) <= 4),
dealt AS (SELECT hosted.*, {split_sql('hosted.host', 1)} AS split FROM hosted JOIN few ON hosted.url = few.url AND hosted.page_id = few.page_id),
counted AS (SELECT decision, label, count(*) AS n FROM dealt WHERE split = 'train' GROUP BY ALL),
capped AS (SELECT decision, label, CASE WHEN decision IN ('page_type', 'in_stock') THEN greatest(1, cast(floor(1.5E0 * min(n) OVER (PARTITION BY decision)) as bigint)) END AS cap FROM counted),
kept AS (SELECT dealt.*, cap, row_number() OVER (PARTITION BY dealt.split, dealt.decision, dealt.label ORDER BY sha256('1|' || case_id), case_id) AS rn FROM dealt LEFT JOIN capped ON dealt.split = 'train' AND dealt.decision = capped.decision AND dealt.label = capped.label QUALIFY cap IS NULL OR rn <= cap)"""


def _collected(t):
    pages = S.furnished(t.pages).select(F.concat(F.lit("f"), (F.col("page_id") % 3).cast("string")).alias("warc_file"), F.col("page_id").alias("seq"), "url", "html")
    return build.collect_v0(pages, per_host=4)


@query(f"WITH {_V0} {_COUNTED}")
def q75_builder_v0(t):
    """DS-3, DS-7, WN-3 to WN-5: the older builder: first of each URL, four pages a host as they come, train alone balanced."""
    path = stages.folder(t.spark, "v0")
    build.build_v0(_collected(t), path, max_ratio=1.5)
    return _counted(t, path)


@query(f"WITH {_V0}, b AS (SELECT {split_sql("'bench' || item_id % 7", 1)} AS split, 'bench' || item_id % 7 AS host FROM benchmark), u AS (SELECT split, host FROM kept UNION ALL SELECT split, host FROM b) SELECT split, count(*) AS rows, count(DISTINCT host) AS source_groups FROM u GROUP BY split")
def q76_merged_files(t):
    """DS-8, SO-1, JN-6, SRC-11: two written datasets merged split by split, each checked by its manifest first; the revision is made of theirs."""
    one, two, out = (stages.folder(t.spark, x) for x in ("part", "other", "merged"))
    first = build.build_v0(_collected(t), one, max_ratio=1.5)
    group = F.concat(F.lit("bench"), (F.col("item_id") % 7).cast("string"))
    options = F.from_json(F.lit('[{"id":"a","text":"a"},{"id":"b","text":"b"}]'), "array<struct<id:string,text:string>>")
    other = t.benchmark.select(F.concat(F.lit("b"), F.col("item_id").cast("string"), F.lit("::quality")).alias("case_id"), group.alias("source_group"), E.split_of(group, 1).alias("split"), options.alias("candidates"), F.array(F.lit(1.0), F.lit(0.0)).alias("target"), F.lit("agreed").alias("label_quality"))
    second = build.write_dataset(other.withColumns({"decision": F.lit("quality"), "label": F.lit("a")}), two, "bench")
    made = build.merge(t.spark, [one, two], out)
    if made["revision"] != hashlib.sha256((first["revision"] + second["revision"]).encode()).hexdigest()[:16]:
        raise ValueError("the merged revision is not made of the inputs'")
    return sink.read(t.spark, out).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source_group").alias("source_groups"))


@query(
    """WITH p AS (SELECT p_partkey AS k, p_brand AS brand, split_part(p_name, ' ', 1) AS w1, p_type AS w2, p_size AS size FROM part)
SELECT k || '::kind' AS case_id, brand || '::' || k AS source_group, 'Which kind?' AS question, 'a=' || w1 || ',b=' || w2 AS options, round(size / (size + 1.0E0), 6) AS first, CAST(NULL AS VARCHAR) AS question_type FROM p
UNION ALL SELECT k || '::big', brand || '::' || k, 'True or false: Is it big?', 'false=The statement is false.,true=The statement is true.', CASE WHEN size > 25 THEN 0.0 ELSE 1.0 END, 'noul' FROM p"""
)
def q77_benchmark_rows(t):
    """DS-9, PF-12, HX-2, HX-12: cases with maps of questions to decision rows; the score question is of no wanted type."""
    q = lambda s: F.to_json(s)
    questions = q(F.struct(F.struct(F.lit("choice").alias("type"), F.lit("Which kind?").alias("instructions"), F.struct(F.split("p_name", " ")[0].alias("a"), F.col("p_type").alias("b")).alias("criteria")).alias("kind"), F.struct(F.lit("noul").alias("type"), F.lit("Is it big?").alias("instructions")).alias("big"), F.struct(F.lit("score").alias("type"), F.lit("How?").alias("instructions"), F.array(F.lit("low"), F.lit("high")).alias("criteria")).alias("level")))
    p = lambda *kv: F.struct(F.create_map(*(x if i % 2 else F.lit(x) for i, x in enumerate(kv))).alias("probabilities"))
    big = (F.col("p_size") > 25).cast("double")
    gold = q(F.struct(p("a", F.col("p_size").cast("double"), "b", F.lit(1.0)).alias("kind"), p("false", 1 - big, "true", big).alias("big"), p("0", F.lit(1.0), "1", F.lit(1.0)).alias("level")))
    cases = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("workflow"), F.lit("{}").alias("state"), questions.alias("questions"), gold.alias("gold"))
    rows = T.benchmark_rows(cases, ("choice", "noul"))
    return rows.select("case_id", "source_group", "question", F.array_join(F.transform("candidates", lambda c: F.concat(c["id"], F.lit("="), c["text"])), ",").alias("options"), R6(F.col("target")[0]).alias("first"), "question_type")


@query(
    f"""WITH {S.OUTLINE}, p AS (SELECT page_id, {HOST} AS host, page_id % 3 AS file FROM pages JOIN outline USING (page_id) WHERE length(page) >= 200), f AS (SELECT * FROM p WHERE host <> '' AND {split_sql('host', 1)} <> 'train'),
a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY file, host ORDER BY page_id) <= 2) SELECT page_id AS seq, host FROM a QUALIFY row_number() OVER (PARTITION BY file ORDER BY page_id) <= 9"""
)
def q78_fresh_pages(t):
    """DS-13, PF-14, SRC-17: pages of hosts that the train split has not seen: two of a host in each file, nine of a file."""
    pages = S.furnished(t.pages).select(F.concat(F.lit("f"), (F.col("page_id") % 3).cast("string")).alias("warc_file"), F.col("page_id").alias("seq"), "url", "html")
    host = E.host_of(F.col("url"))
    known = t.pages.select(host.alias("host")).where(E.split_of(F.col("host"), 1) == "train")
    return build.fresh_pages(pages, known, per_host=2, per_file=9).select("seq", "host")


@query(f"WITH p AS (SELECT DISTINCT url, {HOST} AS host FROM pages) SELECT {split_sql('host', 1)} AS split, count(*) AS pages, count(DISTINCT host) AS hosts FROM p GROUP BY ALL")
def q79_stream(t):
    """Streaming: the pages as a stream of files, each URL once, to parsed pages in their splits."""
    source, out, check = (stages.folder(t.spark, x) for x in ("stream-in", "stream-out", "stream-check"))
    t.pages.select("page_id", "url", "html").write.parquet(source)
    running = stream.start(t.spark, source, out, check)
    running.awaitTermination()
    return t.spark.read.parquet(out).groupBy("split").agg(F.count_distinct("url").alias("pages"), F.count_distinct("host").alias("hosts"))


_ROT = """WITH s AS (SELECT lang AS workflow, source AS source_group, max(source || '/' || lang) AS own FROM documents GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY sha256('19|' || workflow || '|' || source_group), workflow, source_group) AS rn, count(*) OVER (PARTITION BY workflow) AS k FROM s),
m AS (SELECT a.workflow, a.source_group, b.own AS state FROM o a JOIN o b ON a.workflow = b.workflow AND b.rn = a.rn % a.k + 1)"""


@query(
    f"""{_ROT} SELECT doc_id, 'original' AS condition, source || '/' || lang AS state FROM documents UNION ALL SELECT doc_id, 'blank', '{{}}' FROM documents
UNION ALL SELECT doc_id, 'shuffled_within_workflow', m.state FROM documents JOIN m ON lang = workflow AND source = source_group"""
)
def q80_state_ablations(t):
    """DS-11: every row as it is, with a blank state, and with another source's."""
    rows = t.documents.select("doc_id", F.col("lang").alias("workflow"), F.col("source").alias("source_group"), F.concat_ws("/", "source", "lang").alias("state"))
    return D.state_ablations(rows, seed=19).select("doc_id", "condition", "state")


@query(
    f"""WITH {LED}, s AS (SELECT *, {split_sql('source_group', 1)} = 'train' AS tr, CASE WHEN workflow = 'de' AND h % 2 = 1 THEN '1,0' ELSE '0,1' END AS opts FROM led),
v AS (SELECT workflow, q, count(*) AS n FROM s WHERE tr GROUP BY ALL), m AS (SELECT workflow, arg_min(q, [-n, q]) AS top FROM v GROUP BY workflow), o AS (SELECT workflow, count(DISTINCT opts) = 1 AS same FROM s WHERE tr GROUP BY workflow)
SELECT s.workflow, count(*) AS n, round(avg(CASE WHEN pred = q THEN 1.0E0 ELSE 0 END), 6) AS model, round(avg(CASE WHEN same THEN CASE WHEN q = top THEN 1.0E0 ELSE 0 END ELSE CASE WHEN h % 5 = 0 THEN 0.5E0 ELSE 1 END END), 6) AS baseline,
  CASE WHEN any_value(same) THEN CAST(any_value(top) AS VARCHAR) END AS majority, count(*) FILTER (conf >= 0.9E0) AS sure_n, count(*) FILTER (conf >= 0.9E0 AND pred = q) AS sure_ok FROM s JOIN m ON s.workflow = m.workflow JOIN o ON s.workflow = o.workflow WHERE NOT tr GROUP BY s.workflow"""
)
def q81_decision_baselines(t):
    """AG-10: the model against a majority, or where options differ a random pick among the supported ones."""
    s = V.scored(t.L.withColumn("target", F.when(F.col("h") % 5 == 0, F.transform("target", lambda x: F.when(x == F.array_max("target"), 1.0).otherwise(0.0))).otherwise(F.col("target"))))
    s = s.withColumn("gold", F.col("q").cast("string")).withColumn("ids", F.when((F.col("workflow") == "de") & (F.col("h") % 2 == 1), F.reverse("ids")).otherwise(F.col("ids")))
    train = E.split_of(F.col("source_group"), 1) == "train"
    table = V.decision_table(s.where(train), s.where(~train))
    return table.select("workflow", "n", R6("model").alias("model"), R6("baseline").alias("baseline"), "majority", "sure_n", "sure_ok")


@query("SELECT count(*) AS items, count(*) FILTER (substr(source, 1, 4) = 'src1') AS collisions FROM documents")
def q82_option_collisions(t):
    """AG-13: two options that are one in their first four tokens, characters here."""
    return V.option_collisions(t.documents.select(F.array(F.split("source", ""), F.split(F.lit("src1 and more"), "")).alias("tokens")), "tokens", 4)


@query(
    f"""WITH {LED}, x AS (SELECT *, h % 4 <> 0 AS yes, z / 2 AS a FROM led)
SELECT workflow, round(avg(-(t0 * ln(p0) + t1 * ln(p1))) FILTER (yes) + 0.25E0 * avg(ln(1 + exp(a)) - CASE WHEN yes THEN a ELSE 0 END), 6) AS loss, round(avg(-(t0 * ln(p0) + t1 * ln(p1))) FILTER (yes), 6) AS choice_loss, round(avg(ln(1 + exp(a)) - CASE WHEN yes THEN a ELSE 0 END), 6) AS answerability_loss FROM x GROUP BY workflow"""
)
def q83_training_loss(t):
    """SF-21: the value of the training loss; every fourth row has no answer and no target mass."""
    yes = F.col("h") % 4 != 0
    target = F.when(yes, F.col("target")).otherwise(F.transform("target", lambda x: x * 0))
    parts = V.training_loss(F.col("logits"), F.col("y"), F.col("z") / 2, F.col("yes"))
    return t.L.withColumns({"yes": yes, "y": target, "z": F.col("logits")[1]}).groupBy("workflow").agg(*(R6(v).alias(k) for k, v in parts.items()))


@query(
    f"""WITH {LED}, {LED2}, j AS (SELECT led.case_id, led.q, {split_sql('led.case_id', 1)} AS split, led.source_group, led2.pred AS top FROM led LEFT JOIN led2 ON led.case_id = led2.case_id AND led.h % 5 <> 0)
SELECT split, count(*) AS rows, count(DISTINCT source_group) AS source_groups, min(case_id) AS least FROM j WHERE top IS NULL OR top = q GROUP BY split"""
)
def q84_label_checked(t):
    """DS-15, LB-22: a dataset written anew without the labels that another model does not bear out, its manifest patched."""
    candidates = F.transform("ids", lambda i: F.struct(i.alias("id"), i.alias("text")))
    rows = t.L.select("case_id", "source_group", "workflow", candidates.alias("candidates"), "target", F.lit("single").alias("label_quality"), "h", E.split_of(F.col("case_id"), 1).alias("split"), F.lit("quality").alias("decision"), E.gold_label(F.col("ids"), F.col("target")).alias("label"))
    order = F.transform(E.ranked(F.col("p"), F.col("ids")), lambda x: x["id"])
    judged = t.L2.select("case_id", order.alias("order")).join(t.L.where("h % 5 <> 0").select("case_id"), "case_id", "left_semi")
    path = stages.folder(t.spark, "checked")
    base = build.manifest(rows, "ledger")
    made = build.label_checked(rows.drop("h"), judged, base, path)
    back = t.spark.read.json(path)
    counts = {s: c["decision_cases"] for s, c in made["split_counts"].items()}
    assert counts == {**dict.fromkeys(counts, 0), **{r["split"]: r["count"] for r in back.groupBy("split").count().collect()}}
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source_group").alias("source_groups"), F.min("case_id").alias("least"))


@query(
    f"""{{grid}} SELECT (SELECT t / 100.0E0 FROM s ORDER BY ce, t LIMIT 1) AS temperature, count(*) AS cases, round(avg(CASE WHEN pred = q THEN 1.0E0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN (x1 + 0.4E0 > x0) <> (x1 > x0 + 0.4E0) THEN 1.0E0 ELSE 0 END), 6) AS flips FROM c WHERE split = 'test'""".replace(
        "{grid}",
        f"""WITH {LED}, w AS (SELECT case_id, source_group, q, t0, t1, {split_sql('case_id', 1)} AS split, regexp_split_to_array(CASE WHEN h % 2 = 0 THEN 'big ' ELSE '' END || CASE WHEN h % 3 = 0 THEN 'red apple' ELSE 'cold' END, ' ') AS w FROM led),
c AS (SELECT *, {S.overlap("w", "red apple pie")} AS x0, {S.overlap("w", "big house")} AS x1, CASE WHEN {S.overlap("w", "big house")} > {S.overlap("w", "red apple pie")} + 0.4E0 THEN 1 ELSE 0 END AS pred FROM w),
g AS (SELECT unnest(range(50, 501)) AS t), l AS (SELECT t, x0 + 0.4E0 AS a, x1 AS b, t0, t1 FROM c CROSS JOIN g WHERE split = 'calibration'),
s AS (SELECT t, round(sum(-(t0 * ln(greatest(exp(a / (t / 100.0E0)) / (exp(a / (t / 100.0E0)) + exp(b / (t / 100.0E0))), 1e-12)) + t1 * ln(greatest(exp(b / (t / 100.0E0)) / (exp(a / (t / 100.0E0)) + exp(b / (t / 100.0E0))), 1e-12)))), 6) AS ce FROM l GROUP BY t)""",
    )
)
def q85_evaluation(t):
    """HX-10, JN-11, AG-5, AG-20: a dataset scored, its temperature fitted on calibration, its test rows judged in both orders, and the ledger read back."""
    state = F.concat(F.when(F.col("h") % 2 == 0, "big ").otherwise(""), F.when(F.col("h") % 3 == 0, "red apple").otherwise("cold"))
    texts = F.from_json(F.lit('[{"id":"0","text":"red apple pie"},{"id":"1","text":"big house"}]'), "array<struct<id:string,text:string>>")
    rows = t.L.select("case_id", "source_group", "workflow", "question_type", F.lit("Which?").alias("question"), state.alias("state"), texts.alias("candidates"), "target", E.split_of(F.col("case_id"), 1).alias("split"))
    path = stages.folder(t.spark, "evaluation")
    made = build.evaluate(rows, T.OverlapScorer(0.4), path)
    back = stages.cut(files.read_ledger(t.spark, path), "ledger")
    hit = (F.col("raw_choice") == F.col("expected")).cast("int")
    return back.agg(F.lit(made["temperature"]).alias("temperature"), F.count(F.lit(1)).alias("cases"), R6(F.avg(hit)).alias("accuracy"), R6(F.lit(made["order_reversal_argmax_change_fraction"])).alias("flips"))


@query(f"WITH p AS (SELECT page_id, {HOST} AS host FROM pages) SELECT {WARC_FILE} AS warc_file, count(*) AS responses, count(*) FILTER (page_id % 3 = 0) AS metadata, count(*) FILTER (page_id % 10 = 0) AS gone, 0 AS failed FROM p GROUP BY 1 UNION ALL SELECT 'none.gz', 0, 0, 0, 1")
def q86_warc_source(t):
    """SRC-1, SRC-3, DS-2: all records through the data source; a file that is not there gives a row that says so."""
    path = stages.folder(t.spark, "records")
    write_warcs(t, path)
    t.spark.dataSource.register(warc.WarcSource)
    names = [r[0] for r in warc_names(t, path).collect()]  # a name for each file
    found = t.spark.read.format("warc").option("paths", ",".join([*names, f"{path}/none.gz"])).load()
    kind = lambda k: F.count_if(F.col("rec_type") == k)
    return found.groupBy(F.element_at(F.split("warc_file", "/"), -1).alias("warc_file")).agg(kind("response").alias("responses"), kind("metadata").alias("metadata"), F.count_if(F.col("status") == 404).alias("gone"), kind("failed").alias("failed"))


@query(f"WITH {LED}, s AS (SELECT *, {split_sql('source_group', 1)} AS split, h % 6 = 0 AS none FROM led) SELECT split, count(*) AS rows FROM s WHERE NOT none OR split = 'train' GROUP BY split")
def q87_unlabelled(t):
    """PF-11: rows that only hold a place for a label go, but for train's, which a teacher labels."""
    rows = t.L.withColumns({"split": E.split_of(F.col("source_group"), 1), "label_source": F.when(F.col("h") % 6 == 0, "none").otherwise("x")})
    return R.labelled(rows, teacher=True).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
