"""Queries over streams, stages that go on after a stop, and files that many tasks share; held against SQL over the tables they were made of."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import exprs as E
from ..operators import evaluation as V
from ..operators import fitting, judging
from ..operators import pages as P
from ..operators import training as R
from ..operators import typed as T
from ..sources import sink, stages, udtf, warc, warc_ranges, warc_stream
from ..streaming import resume
from ..streaming import state as stateful
from . import build, realworld
from . import page_sql as S
from .catalog import _HINTS, _PATH, HOST, LED, PER_FILE, QUERIES, R6, SQL, WARC_FILE, query, split_sql, warc_names, write_warcs
from .catalog_files import _V0

__all__ = ["QUERIES", "SQL"]  # the whole catalogue


class Stopped(RuntimeError):
    """Stands for whatever ends a run."""


def _once(batch_id: int):
    """Stops a stage in that batch, between its rows and its record."""

    def stop(b: int) -> None:
        if b == batch_id:
            raise Stopped(f"stopped in batch {b}")

    return stop


@query(
    f"""WITH {LED}, w AS (SELECT case_id, regexp_split_to_array(CASE WHEN h % 2 = 0 THEN 'big ' ELSE '' END || CASE WHEN h % 3 = 0 THEN 'red apple' ELSE 'cold' END, ' ') AS w FROM led),
c AS (SELECT case_id, {S.overlap("w", "red apple pie")} + 0.4E0 AS a, {S.overlap("w", "big house")} AS b FROM w) SELECT case_id, round(exp(a) / (exp(a) + exp(b)), 6) AS p FROM c"""
)
def q120_resumed_scoring(t):
    """SRC-16: cases scored batch by batch into an append-only folder. The run is stopped in its second batch, after the rows and before their record, and started again."""
    source, out = (stages.folder(t.spark, x) for x in ("cases", "scores"))
    state = F.concat(F.when(F.col("h") % 2 == 0, "big ").otherwise(""), F.when(F.col("h") % 3 == 0, "red apple").otherwise("cold"))
    texts = F.array(F.lit("red apple pie"), F.lit("big house"))
    items = t.L.select("case_id", F.lit("choice").alias("kind"), state.alias("state"), F.lit("Which?").alias("text"), F.array(F.lit("0"), F.lit("1")).alias("ids"), texts.alias("texts"))
    items.repartition(6).write.parquet(source)
    stage = lambda batch: T.score(batch, T.OverlapScorer(0.4)).select("case_id", "p")
    cases = lambda: t.spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 2).parquet(source)
    first = resume.append(cases(), stage, out, before_commit=_once(1))
    try:
        first.awaitTermination()
    except Exception:
        if "stopped in batch 1" not in str(first.exception()):
            raise
    resume.append(cases(), stage, out).awaitTermination()
    return resume.read(t.spark, out, "case_id string, p array<double>").select("case_id", R6(F.col("p")[0]).alias("p"))


@query(f"""WITH {_V0.partition(",\ndealt AS")[0]} SELECT hosted.case_id, hosted.host FROM hosted JOIN few ON hosted.url = few.url AND hosted.page_id = few.page_id""")
def q121_streamed_host_cap(t):
    """WN-4, WN-5, DS-3 as a stream: labelled pages that arrive in three runs; four pages of each host, each URL where it came first."""
    source, out, check = (stages.folder(t.spark, x) for x in ("arrivals", "given", "given-log"))
    pages = S.furnished(t.pages).select(F.concat(F.lit("f"), (F.col("page_id") % 3).cast("string")).alias("warc_file"), F.col("page_id").alias("seq"), "url", "html")
    for k in range(3):  # a run for each arrival: the state is that of the run before
        pages.where(F.col("warc_file") == f"f{k}").write.mode("append").parquet(source)
        came = t.spark.readStream.schema(pages.schema).parquet(source)
        rows = P.page_rows_v0(came.where(E.host_of(F.col("url")) != ""), keep=("warc_file", "seq")).select("case_id", "url", "source_group", "warc_file", "seq")
        stateful.to_table(stateful.running_cap(rows, "source_group", "url", ["warc_file", "seq"], 4), out, check).awaitTermination()
    return t.spark.read.parquet(out).select("case_id", F.col("source_group").alias("host"))


@query(SQL["q22_pending_metadata"])
def q122_streamed_metadata(t):
    """JN-1 as a stream: files of a thousand records, each cut at places of its own into four arrivals, and a record that ends each file."""
    source, out, check = (stages.folder(t.spark, x) for x in ("records", "responses", "responses-log"))
    kind = F.when(F.col("event_type") == "click", "response").otherwise("metadata")
    file = F.floor(F.col("event_id") / 1000)
    records = t.events.select(file.cast("string").alias("warc_file"), F.col("event_id").alias("seq"), (F.col("user_id") % 20).cast("string").alias("url"), kind.alias("rec_type"), F.col("event_type").alias("lang3"))
    place = F.col("seq") % 1000
    cut = lambda i: F.pmod(F.xxhash64("warc_file", F.lit(i)), F.lit(1000))
    part = sum((place >= cut(i)).cast("int") for i in range(3))
    ends = stateful.ended(records.select("warc_file").distinct(), "warc_file", records.schema)
    for rows in (*(records.where(part == k) for k in range(4)), ends):  # a run for each arrival: responses wait from one to the next
        rows.write.mode("append").parquet(source)
        came = t.spark.readStream.schema(records.schema).parquet(source)
        stateful.to_table(stateful.attach_metadata(came), out, check).awaitTermination()
    return t.spark.read.parquet(out).select(F.col("seq").alias("event_id"), F.col("detected_language").alias("detected"))


_MEMBERS = f"""p AS (SELECT page_id, url, {HOST} AS host FROM pages),
m AS (SELECT host, page_id, url, 'response' AS rec_type, 0 AS o FROM p UNION ALL SELECT host, page_id, url, 'metadata', 1 FROM p WHERE page_id % 3 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY host, page_id // {PER_FILE} ORDER BY page_id, o) - 1 AS seq FROM m)"""


@query(f"WITH {_MEMBERS} SELECT {WARC_FILE} AS warc_file, seq, rec_type, CASE WHEN rec_type = 'response' THEN CASE WHEN page_id % 10 = 0 THEN 404 ELSE 200 END END AS status, md5(url) AS url_md5 FROM n")
def q123_split_warc(t):
    """SRC-1: every file read in ranges of a few kilobytes, by many tasks; members keep the numbers they have in their file."""
    path = stages.folder(t.spark, "warcs")
    write_warcs(t, path)
    found = warc_ranges.read_warc(t.spark, path, split_bytes=16_384)
    return found.select(F.element_at(F.split("warc_file", "/"), -1).alias("warc_file"), "seq", "rec_type", "status", F.md5(F.col("url").cast("binary")).alias("url_md5"))


@query(f"WITH p AS (SELECT page_id, url, html, {HOST} AS host FROM pages WHERE page_id % 10 <> 0) SELECT {WARC_FILE} AS warc_file, count(*) AS pages, min(md5(coalesce(html, ''))) AS least, max(md5(coalesce(html, ''))) AS most FROM p GROUP BY 1")
def q124_fetched_members(t):
    """SRC-1, PF-2: pages found without their bodies, which ranged reads bring afterwards for the wanted ones alone."""
    path = stages.folder(t.spark, "warcs")
    write_warcs(t, path)
    found = warc_ranges.read_warc(t.spark, path, split_bytes=65_536).where("rec_type = 'response' AND status = 200").select("warc_file", "seq", "offset", "length")
    html = F.md5(F.col("body"))
    return warc_ranges.fetch(found).groupBy(F.element_at(F.split("warc_file", "/"), -1).alias("warc_file")).agg(F.count(F.lit(1)).alias("pages"), F.min(html).alias("least"), F.max(html).alias("most"))


@query(f"WITH p AS (SELECT DISTINCT url, {HOST} AS host FROM pages WHERE page_id % 10 <> 0) SELECT {split_sql('host', 1)} AS split, count(*) AS pages, count(DISTINCT host) AS hosts FROM p GROUP BY ALL")
def q125_warc_stream(t):
    """Streaming, SRC-1, SRC-4: a folder of WARC files as a stream, several files a trigger, to parsed pages in their splits."""
    path, log, out, check = (stages.folder(t.spark, x) for x in ("warcs", "warc-log", "warc-pages", "warc-check"))
    write_warcs(t, path)
    t.spark.dataSource.register(warc_stream.WarcStream)
    files = warc_names(t, path).count()
    came = t.spark.readStream.format("warc_stream").option("path", path).option("log", log).option("rec_type", "response").option("status", "200").option("files_per_trigger", -(-files // 3)).load()
    host = E.host_of(F.col("url"))
    pages = warc.decode(came.where("rec_type = 'response'")).where("html IS NOT NULL").select("url", host.alias("host"), E.split_of(host, 1).alias("split"))
    running = pages.dropDuplicates(["url"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return t.spark.read.parquet(out).groupBy("split").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("hosts"))


_N = lambda *texts: sum(len(x.split()) for x in texts)
_ASKED = _N("Which?", "the of and", "de la que") + _N(K.NOUL_PREFIX + "Long.", *K.NOUL_DEFAULT.values()) + _N(K.SCORE_PREFIX + "How?", "low", "the mid", "de high")


@query(
    f"""WITH w AS (SELECT item_id, len(list_filter(regexp_split_to_array(CAST(to_json({{'page': text}}) AS VARCHAR), '\\s+'), lambda x: x <> '')) AS n FROM benchmark)
SELECT item_id AS request_id, 'overlap' AS model, 3 AS answers, 2 * (3 * n + {_ASKED}) AS input_tokens, 0 AS output_tokens, true AS timed FROM w"""
)
def q126_usage(t):
    """SC-5, AG-23: answers with usage and latency, gathered while they are scored; what was observed on the way must be what the rows say."""
    body = F.to_json(F.struct(F.struct(F.col("text").alias("page")).alias("state"), F.lit(None).cast("string").alias("none")))
    questions = '{"lang":{"type":"choice","instructions":"Which?","criteria":{"en":"the of and","es":"de la que"}},"flag":{"type":"noul","instructions":"Long."},"level":{"type":"score","instructions":"How?","criteria":["low","the mid","de high"]}}'
    requests = t.benchmark.select(F.col("item_id").alias("request_id"), F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(f',"questions":{questions}}}')).alias("body"))
    answers, seen = T.metered(T.predict(requests, T.OverlapScorer(0.2), orders=2, usage=True))
    kept = stages.cut(answers, "answers")
    said = seen.get
    total = kept.agg(F.count("answer"), F.sum("input_tokens")).first()
    if (said["answers"], said["input_tokens"]) != tuple(total) or said["errors"] or not 0 <= said["ms_p50"] <= said["ms_p95"]:
        raise ValueError(f"observed {said}, the rows say {total}")
    out = T.by_request(kept, "overlap")
    return out.select("request_id", "model", F.size("answers").alias("answers"), "usage.input_tokens", "usage.output_tokens", (F.col("latency_ms") >= 0).alias("timed"))


@query(
    f"""WITH p AS (SELECT doc_id, substr(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), 1, 3500) AS page FROM documents),
c AS (SELECT doc_id, len(list_filter(string_split(page, ' '), lambda x: x <> '')) + {_N("Which?", "A. the of and", "B. de la que", "Answer with one letter.")} AS tokens, string_split(lower(page), ' ') AS w FROM p),
x AS (SELECT doc_id, tokens, {S.overlap("w", "the of and")} AS a, {S.overlap("w", "de la que")} AS b FROM c) SELECT doc_id, tokens, round(exp(a) / (exp(a) + exp(b)), 6) AS p FROM x"""
)
def q127_judged(t):
    """LB-23: a judge whose memory is smaller than the token budget it is given; every document judged once, no batch above what it has room for."""
    page = F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+", " ")
    items = t.documents.select("doc_id", R.prompt(page, F.lit("Which?"), F.array(F.lit("the of and"), F.lit("de la que"))).alias("prompt"), F.lit(2).alias("letters"))
    done = stages.cut(judging.judged(items, judging.OverlapJudge(room=9_000), 20_000).drop("prompt"), "judged")
    if done.where("batch_rows > 1 AND batch_tokens > 9000").limit(1).count():
        raise ValueError("a batch above the budget")
    return done.select("doc_id", "tokens", R6(F.col("probabilities")[0]).alias("p"))


@query(SQL["q11_outline_v1"])
def q128_sql_pages(t):
    """§2.11: pages read by a table function in SQL text alone."""
    udtf.register(t.spark)
    return t.spark.sql(
        "SELECT page_id, p.title, p.html_lang, p.lines AS n_lines, CAST(length(p.page) AS BIGINT) AS page_chars, md5(CAST(p.page AS BINARY)) AS page_md5 FROM {pages}, LATERAL page_state(url, html, 'title,html_lang,lines,page') p",
        pages=S.furnished(t.pages),
    )


@query(f"WITH p AS (SELECT page_id, {HOST} AS host FROM pages) SELECT {WARC_FILE} AS warc_file, count(*) AS pages, count(*) FILTER (page_id % 10 = 0) AS gone FROM p GROUP BY 1")
def q129_sql_records(t):
    """§2.11, SRC-1: WARC files read by a table function in SQL text alone, pages parsed by another."""
    path = stages.folder(t.spark, "records")
    write_warcs(t, path)
    udtf.register(t.spark)
    names = warc_names(t, path).repartition(4 * t.spark.sparkContext.defaultParallelism)  # names are so small that Spark would give them all to one task, with their files
    return t.spark.sql(
        "SELECT element_at(split(path, '/'), -1) AS warc_file, count(p.lines) AS pages, count_if(r.status = 404) AS gone FROM {files}, LATERAL warc_records(path, 'response') r, LATERAL page_state(r.url, r.html, 'lines') p GROUP BY 1",
        files=names,
    )


@query(f"SELECT {split_sql('source', 1)} AS split, count(*) AS rows, count(*) FILTER (lang IS NOT NULL AND text <> '') AS answerable, true AS beats_prior FROM documents GROUP BY 1")
def q130_trained_head(t):
    """MD-6, MD-7, SC-8, SF-21, AG-24: an option head trained on the train split's documents, its epoch picked on every fourth source of them, held against what the priors alone would score elsewhere."""
    labels = [r[0] for r in t.documents.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(16).collect()]  # the commonest are the options
    ids = F.array(*map(F.lit, labels)).cast("array<string>")
    known = F.coalesce(F.col("text") != "", F.lit(False)) & F.col("lang").isNotNull()
    target = F.transform(ids, lambda x: F.when(known & (x == F.col("lang")), 1.0).otherwise(0.0))
    items = t.documents.select(F.col("doc_id").cast("string").alias("item_id"), "source", E.split_of(F.col("source"), 1).alias("split"), F.lit("choice").alias("kind"), F.col("text").alias("state"), F.lit("Which language?").alias("text"), ids.alias("ids"), ids.alias("texts"), target.alias("target"), known.alias("known"))
    own = F.col("split") == "train"
    picked = F.pmod(F.xxhash64("source"), F.lit(4)) == 0
    head, _ = fitting.fit(items.where(own & ~picked), items.where(own & picked))
    asked = items.where(~own & F.col("known"))
    scored = T.score(asked.withColumn("state", F.coalesce("state", F.lit(""))), head)
    loss = scored.agg(F.avg(E.soft_ce(F.col("p"), F.col("target")))).first()[0]
    keyed = lambda d: d.where("known").select(F.col("item_id").alias("case_id"), F.lit("documents").alias("workflow"), F.lit("lang").alias("schema_key"), "ids", "target")
    prior = V.prior_controls(keyed(items.where(own)), keyed(asked)).where("key = 'all'").first()
    beats = loss is None or prior is None or loss < prior["soft_prior_ce"]
    return items.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if("known").alias("answerable"), F.lit(bool(beats)).alias("beats_prior"))


@query(
    f"""WITH {S.rows_v1(_PATH, _HINTS)}, p AS (SELECT page_id, {HOST} AS host, page_id % 3 AS file FROM pages JOIN outline USING (page_id) WHERE length(page) >= 200), f AS (SELECT * FROM p WHERE host <> '' AND {split_sql('host', 1)} <> 'train'),
a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY file, host ORDER BY page_id) <= 2), fresh AS (SELECT page_id FROM a QUALIFY row_number() OVER (PARTITION BY file ORDER BY page_id) <= 30),
l AS (SELECT row.* FROM row JOIN fresh USING (page_id)), q AS (SELECT unnest(['page_type', 'page_status']) AS decision FROM fresh UNION ALL SELECT decision FROM l WHERE decision NOT IN ('page_type', 'page_status')),
c AS (SELECT decision, count(*) AS asked FROM q GROUP BY 1), b AS (SELECT decision, CAST(sum(n) AS BIGINT) AS labelled, round(max(n) / sum(n), 4) AS baseline FROM (SELECT decision, gold, count(*) AS n FROM l GROUP BY ALL) GROUP BY 1)
SELECT decision, asked, labelled, baseline FROM c LEFT JOIN b USING (decision)"""
)
def q131_realworld(t):
    """HX-13, SRC-16, AG-7 to AG-9, DS-13, DS-14: pages of unseen hosts scored and held against their labels in one call, which is stopped while it scores and called again."""
    out = stages.folder(t.spark, "realworld")
    host = E.host_of(F.col("url"))
    found = S.furnished(t.pages).select(F.concat(F.lit("f"), (F.col("page_id") % 3).cast("string")).alias("warc_file"), F.col("page_id").alias("seq"), "url", "html", "http_status", "detected_language")
    known = t.pages.select(host.alias("host")).where(E.split_of(F.col("host"), 1) == "train")
    call = lambda **kw: realworld.check(found, known, T.OverlapScorer(), out, per_host=2, per_file=30, files_per_batch=1, **kw)
    try:
        call(before_commit=_once(0))
    except Exception as why:
        if "stopped in batch 0" not in str(why):
            raise
    report = call()
    scores = resume.read(t.spark, f"{out}/scores", realworld.SCORED)
    if report["decisions_scored"] != t.spark.read.parquet(f"{out}/items").count() or realworld.pending_items(t.spark, out).limit(1).count():
        raise ValueError("items without an answer")
    against = realworld.against_labels(scores, t.spark.read.parquet(f"{out}/labelled"), 0.9)
    return scores.groupBy("decision").agg(F.count(F.lit(1)).alias("asked")).join(against.select("decision", F.col("n").alias("labelled"), F.round("baseline", 4).alias("baseline")), "decision", "left")


@query(
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 'w' || p_partkey % 5 AS workflow, p_partkey % 10 = 0 AS held FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY sha256('1|' || id), id) AS n, count(*) OVER (PARTITION BY workflow) AS k FROM p WHERE NOT held), s AS (SELECT *, greatest(1, cast(round_even(k / 10.0, 0) as bigint)) AS ten FROM r),
d AS (SELECT id, workflow, CASE WHEN n <= ten THEN 'development' WHEN n <= 2 * ten THEN 'calibration' ELSE 'train' END AS split FROM s UNION ALL SELECT id, workflow, 'test' FROM p WHERE held)
SELECT split, 2 * count(*) AS rows, count(DISTINCT workflow || '::' || id) AS source_groups, min(id || '::kind') AS least FROM d GROUP BY split"""
)
def q132_benchmark_prepared(t):
    """HX-12, DS-9, DS-10, JN-5: a benchmark's train and test cases to a written dataset in one call: split before expansion, checked for leaks, read back."""
    options = F.struct(F.split("p_name", " ")[0].alias("a"), F.col("p_type").alias("b"))
    questions = F.to_json(F.struct(F.struct(F.lit("choice").alias("type"), F.lit("Which kind?").alias("instructions"), options.alias("criteria")).alias("kind"), F.struct(F.lit("noul").alias("type"), F.lit("Is it big?").alias("instructions")).alias("size")))
    big = (F.col("p_size") > 25).cast("double")
    p = lambda *kv: F.struct(F.create_map(*(x if i % 2 else F.lit(x) for i, x in enumerate(kv))).alias("probabilities"))
    gold = F.to_json(F.struct(p("a", F.col("p_size").cast("double"), "b", F.lit(1.0)).alias("kind"), p("false", 1 - big, "true", big).alias("size")))
    cases = t.part.select("p_partkey", F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("w"), (F.col("p_partkey") % 5).cast("string")).alias("workflow"), F.lit("{}").alias("state"), questions.alias("questions"), gold.alias("gold"))
    path = stages.folder(t.spark, "benchmark")
    build.prepare_benchmark(cases.where("p_partkey % 10 <> 0"), cases.where("p_partkey % 10 = 0"), path, types=("choice", "noul"))
    sink.check(t.spark, path)
    return sink.read(t.spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source_group").alias("source_groups"), F.min(F.when(F.col("case_id").endswith("::kind"), F.col("case_id"))).alias("least"))
