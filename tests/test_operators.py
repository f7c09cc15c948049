"""Datasets, ledgers, typed questions, sources and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import dataset as D
from weftline.operators import evaluation as V
from weftline.operators import pages as P
from weftline.operators import typed as T
from weftline.sources import files, warc
from weftline.streaming import pages as stream

from test_functions import NEWS


def pages(spark, rows):
    return spark.createDataFrame(rows, "url string, html string, http_status int, detected_language string")


def test_rows_of_a_news_page(spark):
    body = NEWS.replace("The library is open.", "The library is open. " * 20)
    rows = {r.decision: r for r in P.page_rows_v1(pages(spark, [("https://a.example/p", body, 200, "eng")])).collect()}
    assert set(rows) == {"page_type", "page_status", "language", "published_date"}
    gold = {k: r.candidates[max(range(len(r.target)), key=r.target.__getitem__)] for k, r in rows.items()}
    assert gold["page_type"].id == "news_article" and gold["page_status"].id == "ok" and gold["language"].id == "en" and "[14 March 2026]" in gold["published_date"].text
    assert rows["page_type"].label_quality == "agreed" and json.loads(rows["page_type"].label_source)["schema.org"] == "news_article"
    assert rows["page_type"].case_id == "https://a.example/p::page_type" and rows["page_type"].source_group == "a.example"
    assert len(rows["language"].candidates) == 5 and sum(rows["published_date"].target) == 1


def test_rows_that_are_dropped(spark):
    body = NEWS.replace("The library is open.", "The library is open. " * 20)
    df = pages(spark, [("https://a.example/1", body, 200, "glg"), ("https://a.example/2", body, 404, "eng"), ("https://a.example/3", "<p>thin", 200, "eng"), ("https://a.example/4", None, 200, None), ("https://a.example/5", body, 302, "eng")])
    rows = {(r.url[-1], r.decision) for r in P.page_rows_v1(df).collect()}
    assert rows == {("1", "page_type"), ("1", "page_status"), ("1", "published_date"), ("2", "page_status")}
    d = {r.url[-1]: r for r in P.labels_v1(P.parse_v1(df)).collect()}
    assert d["1"].language_disagreement and d["3"].too_little_text and not d["2"].language_disagreement


SHOP = """<html><head><title>Lamp</title><script type="application/ld+json">{"@type":"Product","offers":{"price":"1299.00","availability":"https://schema.org/InStock"}};</script></head>
<body><div>Lamp now ₹1,299.00 free delivery</div><p>Old price ₹1,499.00 only</p><a>x</a><a>y</a><p>""" + "words about a lamp " * 20 + "</p></body></html>"


def test_v0_rows(spark):
    df = pages(spark, [("https://s.example/p", SHOP, 200, ""), ("https://s.example/q", SHOP.replace("InStock", "PreOrder").replace("1299.00", "777"), 200, ""), ("https://s.example/r", "<p>untyped " * 100, 200, "")])
    rows = {(r.url[-1], r.decision): r for r in P.page_rows_v0(df).collect()}
    assert set(rows) == {("p", "page_type"), ("p", "price_field"), ("p", "in_stock"), ("q", "page_type")}
    price = rows["p", "price_field"]
    assert sum(price.target) == 1 and "[₹1,299.00]" in price.candidates[price.target.index(1.0)].text
    assert rows["p", "in_stock"].target == [0.0, 1.0] and rows["p", "in_stock"].question_type == "noul" and rows["p", "page_type"].state.link_count == 2


def test_balance(spark):
    rows = [("page_status", "ok")] * 50 + [("page_status", "not_found")] * 5 + [("language", "en")] * 30
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "case_id string, decision string, label string")
    got = {(r.decision, r.label): r["count"] for r in D.balance_v1(df, seed=1, split=None, ok_ratio=2, per_language=10).groupBy("decision", "label").count().collect()}
    assert got == {("page_status", "ok"): 10, ("page_status", "not_found"): 5, ("language", "en"): 10}
    for n in (1, 7):
        same = D.balance_v1(df.repartition(n), seed=1, split=None, ok_ratio=2, per_language=10)
        assert {r.case_id for r in same.collect()} == {r.case_id for r in D.balance_v1(df, seed=1, split=None, ok_ratio=2, per_language=10).collect()}


def test_caps_and_first_wins(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 3).alias("host"), (F.col("id") / 3).cast("int").cast("string").alias("url"))
    kept = D.cap_pages(df, "host", "url", 5, 1)
    assert {r["count"] for r in kept.groupBy("host").count().collect()} == {5}
    assert {r.id for r in D.running_cap(df, "host", ["id"], 2).collect()} == set(range(6))
    assert sorted(r.id for r in D.first_wins(df, ["host"], ["id"]).collect()) == [0, 1, 2]


def test_merge_and_leaks(spark):
    a = spark.createDataFrame([("g", "train"), ("h", "test")], "source_group string, split string")
    assert D.merged([a, a]).count() == 4
    with pytest.raises(ValueError, match="more than one split"):
        D.merged([a, spark.createDataFrame([("g", "test")], "source_group string, split string")])


def test_stratified_split(spark):
    df = spark.createDataFrame([(f"{w}{i}", w) for w, n in (("a", 20), ("b", 3), ("c", 25)) for i in range(n)], "id string, w string")
    got = {(r.w, r.split): r["count"] for r in D.stratified_split(df, stratum="w", key="id", seed=1).groupBy("w", "split").count().collect()}
    assert got == {("a", "train"): 16, ("a", "development"): 2, ("a", "calibration"): 2, ("b", "train"): 1, ("b", "development"): 1, ("b", "calibration"): 1, ("c", "train"): 21, ("c", "development"): 2, ("c", "calibration"): 2}
    with pytest.raises(Exception, match="not enough"):
        D.stratified_split(df.where("id in ('a0', 'a1')"), stratum="w", key="id", seed=1).collect()


def test_state_rotation_keeps_sources_whole(spark):
    df = spark.createDataFrame([("w", f"g{i}", f"s{i}") for i in range(5)], "workflow string, g string, s string")
    got = {r.g: r.s for r in D.rotated_states(df, workflow="workflow", group="g", state="s", seed=1).collect()}
    assert sorted(got.values()) == sorted(f"s{i}" for i in range(5)) and all(got[f"g{i}"] != f"s{i}" for i in range(5))


def ledger(spark, rows):
    base = {"source_group": "g", "request_sha256": "a" * 64, "latency_ms": 10.0}
    full = [base | {"case_id": str(i), "choice": None} | r for i, r in enumerate(rows)]
    cols = [c.split()[0] for c in files.LEDGER.replace("map<string,double>", "map").split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in full], files.LEDGER)


def test_summary(spark):
    p = {"a": 0.8, "b": 0.2}
    rows = [{"expected": "a", "raw_choice": "a", "choice": "a", "probabilities": p}, {"expected": "b", "raw_choice": "a", "probabilities": p}, {"expected": "a", "raw_choice": "a", "probabilities": p}]
    s = V.summarize(ledger(spark, rows)).first()
    assert s.cases == 3 and s.source_groups == 1 and abs(s.accuracy - 2 / 3) < 1e-12 and abs(s.coverage - 1 / 3) < 1e-12 and s.accepted_accuracy == 1
    assert abs(s.ece_15_bins - (0.8 - 2 / 3)) < 1e-12
    none = V.summarize(ledger(spark, [r | {"choice": None} for r in rows])).first()
    assert none.accepted_accuracy is None


def test_compare(spark):
    rows = [{"expected": "a", "raw_choice": "a", "probabilities": {"a": 0.8, "b": 0.2}, "source_group": f"g{i % 3}"} for i in range(9)]
    a = ledger(spark, rows)
    b = V.bootstrap(V.paired(a, a), samples=100).first()
    assert (b.accuracy_delta, b.low, b.high) == (0, 0, 0)
    lone = ledger(spark, [r | {"source_group": "g"} for r in rows])
    assert V.bootstrap(V.paired(lone, lone), samples=100).first().low is None
    worse = ledger(spark, [r | {"request_sha256": "b" * 64} if i == 0 else r for i, r in enumerate(rows[:8])])
    assert {r.problem for r in V.paired(a, worse).collect()} == {None, "incompatible request_sha256", "both ledgers must contain exactly the same case ids"}
    with pytest.raises(ValueError):
        V.bootstrap(V.paired(a, a), samples=5)


def test_ledger_file(spark, tmp_path):
    row = {"case_id": "1", "source_group": "1", "request_sha256": "a" * 64, "expected": "a", "raw_choice": "a", "choice": "a", "probabilities": {"a": 0.8, "b": 0.2}, "latency_ms": 10}
    good = tmp_path / "good.jsonl"
    good.write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"case_id": "2 \u0085"}, ensure_ascii=False) + "\n")
    assert files.read_ledger(spark, str(good)).count() == 2
    for bad, why in ((row | {"choice": "b"}, "accepted choice"), (row | {"latency_ms": -1}, "negative"), (row | {"probabilities": {"a": 0.8}}, "at least two"), (row | {"raw_choice": "b", "choice": None}, "inconsistent"), (row | {"request_sha256": "A" * 64}, "SHA256")):
        f = tmp_path / "bad.jsonl"
        f.write_text(json.dumps(bad) + "\n")
        with pytest.raises(ValueError, match=why):
            files.read_ledger(spark, str(f))
    f.write_text((json.dumps(row) + "\n") * 2)
    with pytest.raises(ValueError, match="duplicate"):
        files.read_ledger(spark, str(f))
    f.write_text("\n")
    with pytest.raises(ValueError, match="empty"):
        files.read_ledger(spark, str(f))


def test_broken_lines_raise_with_their_file(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"k":"a","n":1}\n\n{"k":"b"}\n{"k":\n')
    with pytest.raises(Exception, match=r"in\.jsonl: broken line: \{\"k\":"):
        files.read_jsonl(spark, str(tmp_path), "k string, n int").collect()
    (tmp_path / "in.jsonl").write_text('{"k":"a","n":1}\n \n{"k":"b","more":[1]}\n')
    assert sorted(map(str, files.read_jsonl(spark, str(tmp_path), "k string, n int").collect())) == ["Row(k='a', n=1)", "Row(k='b', n=None)"]
    (tmp_path / "in.jsonl").write_text('{"k":"a","n":"many"}\n')
    with pytest.raises(Exception, match="broken line"):
        files.read_jsonl(spark, str(tmp_path), "k string, n int").collect()


def test_jsonl_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", "é x", None), ("b", "", 1)], "k string, t string, n int")
    files.write_jsonl(df, f"{tmp_path}/out")
    assert sorted(map(tuple, files.read_jsonl(spark, f"{tmp_path}/out", "k string, t string, n int").collect())) == [("a", "é x", None), ("b", "", 1)]
    digests = {r.name: r.sha256 for r in files.file_digests(spark, f"{tmp_path}/out").collect()}
    data = {k: v for k, v in digests.items() if k.startswith("part-")}
    files.check_manifest(spark, f"{tmp_path}/out", data)
    with pytest.raises(ValueError, match="manifest"):
        files.check_manifest(spark, f"{tmp_path}/out", {k: "0" * 64 for k in data})


def test_temperature(spark):
    df = spark.createDataFrame([([0.0, 2.0], [0.0, 1.0]), ([0.0, 2.0], [1.0, 0.0]), ([0.0, 2.0], [0.0, 1.0])], "logits array<double>, target array<double>")
    import math

    t = V.fit_temperature(df).first().temperature
    assert abs(t - 2 / math.log(2)) < 0.01  # two of three right: the best p is 2/3


def test_priors(spark):
    schema = "case_id string, workflow string, schema_key string, ids array<string>, target array<double>"
    train = spark.createDataFrame([("1", "w", "k", ["a", "b"], [0.9, 0.1]), ("2", "w", "k", ["b", "a"], [0.2, 0.8]), ("3", "w", "k", ["a", "b"], [0.1, 0.9])], schema)
    dev = spark.createDataFrame([("4", "w", "k", ["b", "a"], [0.1, 0.9]), ("5", "v", "new", ["x", "y"], [1.0, 0.0])], schema)
    got = {r.key: r for r in V.prior_controls(train, dev).collect()}
    assert got["w"].hard_majority_accuracy == 1 and got["v"].hard_majority_accuracy == 0.5 and got["all"].decisions == 2
    assert abs(got["w"].soft_prior_brier - 2 * (0.9 - 0.6) ** 2) < 1e-12


@pytest.mark.parametrize(
    "bad",
    [
        "text",
        {"type": "rank", "instructions": "x", "criteria": {"a": "1", "b": "2"}},
        {"instructions": " ", "criteria": {"a": "1", "b": "2"}},
        {"instructions": "x", "criteria": {"a": "1"}},
        {"type": "noul", "instructions": "x", "criteria": {"yes": "1", "no": "2"}},
        {"type": "score", "instructions": "x", "criteria": ["only"]},
        {"instructions": "x", "criteria": {"a": "1", "b": ""}},
    ],
)
def test_bad_questions(bad):
    assert T.question(bad)["error"]


def test_questions():
    q = T.question({"instructions": "Which team?", "criteria": {"sales": "S", "support": "P"}})
    assert (q["type"], q["text"], q["ids"]) == ("choice", "Which team?", ["sales", "support"])
    q = T.question({"type": " NOUL ", "instructions": "It works."})
    assert q["text"] == "True or false: It works." and q["ids"] == ["false", "true"]
    q = T.question({"type": "score", "instructions": "How?", "criteria": ["low", "medium", "high"]})
    assert q["text"] == "Pick the level that fits best: How?" and q["ids"] == ["0", "1", "2"]


def test_predict_averages_orders(spark):
    body = json.dumps({"state": {"a": 1}, "questions": {"q": {"instructions": "x", "criteria": {"a": "foo", "b": "1 bar", "c": "baz"}}}})
    req = spark.createDataFrame([(1, body), (2, "[]"), (3, None)], "request_id long, body string")

    class Biased(T.OverlapScorer):
        def logits(self, state, text, options):
            return [[(0.4 if o == "1 bar" else 0) + (1.0 if i == 0 else 0) for i, o in enumerate(x)] for x in options]

    first = {r.request_id: r for r in T.predict(req, Biased()).collect()}
    assert first[1].answer.choice == "a" and first[2].error and first[3].error
    even = T.predict(req, Biased(), orders=3).where("request_id = 1").first().answer
    assert even.choice == "b" and abs(even.probabilities["a"] - even.probabilities["c"]) < 1e-9


def test_engine_settings(spark, tmp_path):
    (tmp_path / "engine.json").write_text(json.dumps({"name": "e", "temperature": 2.0, "temperature_by_type": {"noul": 0.5}, "abstain_below": 0.9, "max_tokens": 512}, indent=1))
    e = T.Engine.load(spark, str(tmp_path / "engine.json"), T.OverlapScorer(1.0), orders=1)
    body = json.dumps({"state": "", "questions": {"c": {"instructions": "x", "criteria": {"a": "1", "b": "2"}}, "n": {"type": "noul", "instructions": "y"}}})
    got = {r.qid: r.answer for r in e.predict(spark.createDataFrame([(1, body)], "request_id long, body string")).collect()}
    assert abs(got["c"].probabilities["a"] - 0.6225) < 1e-4 and abs(got["n"].noul - 0.1192) < 1e-4 and got["c"].abstain
    for bad in ({"orders": 0}, {"temperature": 0.0}, {"temperature_by_type": {"noul": -1.0}}):
        with pytest.raises(ValueError):
            T.Engine(T.OverlapScorer(), **bad)


def test_benchmark_rows(spark):
    q = {"q1": {"type": "choice", "instructions": "Which?", "criteria": {"a": "A", "b": "B"}}, "q2": {"type": "score", "instructions": "How?", "criteria": ["lo", "hi"]}, "q3": {"type": "noul", "instructions": "Yes.", "criteria": None}}
    gold = {"q1": {"probabilities": {"a": 3, "b": 1}}, "q2": {"probabilities": {"0": 0.5, "1": 0.5}}, "q3": {"probabilities": {"false": 0, "true": 1}}}
    df = spark.createDataFrame([("c", "w", "{}", json.dumps(q), json.dumps(gold))], "id string, workflow string, state string, questions string, gold string")
    got = {r.case_id: r for r in T.benchmark_rows(df, ("choice", "score", "noul")).collect()}
    assert got["c::q1"].target == [0.75, 0.25] and got["c::q1"].question_type is None and got["c::q1"].source_group == "w::c"
    assert got["c::q2"].question == "Pick the level that fits best: How?" and got["c::q2"].candidates[1].text == "hi"
    assert got["c::q3"].question_type == "noul" and got["c::q3"].candidates[0].id == "false"
    assert T.benchmark_rows(df).count() == 1


def test_packing(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    state = F.sequence(F.lit(1), F.lit(100))
    r = spark.range(1).select(T.packed(a(7, 8), state, F.array(a(1), a(2, 3)), cls=101, sep=102, max_tokens=42).alias("p"), T.packed(a(7, 8), state, F.array(a(1), a(2, 3)), cls=101, sep=102, max_tokens=40).alias("q"), T.shared_positions(F.lit(4), a(1, 2)).alias("s")).first()
    assert len(r.p.ids) == 42 and r.p.state_tokens_dropped == 100 - 32 and r.p.ids[4:20] == list(range(1, 17)) and r.p.ids[20:36] == list(range(85, 101))
    assert r.q is None and r.s == [0, 1, 2, 3, 4, 5, 4, 5, 6]


def write_warc(path):
    def member(head, body):
        return gzip.compress(f"WARC/1.0\r\n{head}\r\n\r\n".encode() + body)

    out = b""
    out += member("WARC-Type: response\r\nWARC-Target-URI: https://h1.example/p", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nno page")
    for i in range(6):
        status = "404 Not Found" if i == 5 else "200 OK"
        url = f"https://h{i}.example/p"
        html = NEWS.replace("The library is open.", "Straße. " * 60).encode("latin-1")
        out += member(f"WARC-Type: response\r\nwarc-target-uri: {url}", f"HTTP/1.1 {status}\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n".encode() + html)
        out += member("WARC-Type: metadata\r\nWARC-Target-URI: https://other.example/", b'languages-cld2: {"languages":[{"code-iso-639-3":"fra"}]}\r\n')
        out += member(f"WARC-Type: metadata\r\nWARC-Target-URI: {url}", b'languages-cld2: {"reliable":true,"languages":[{"code":"en","code-iso-639-3":"eng"}]}\r\n')
    out += member("WARC-Type: response\r\nWARC-Target-URI: https://x.example/", b"HTTP/1.1 what\r\n\r\n") + member("WARC-Type: request\r\nWARC-Target-URI: https://x.example/", b"GET /")
    out += member("WARC-Type: response\r\nWARC-Target-URI: https://h0.example/p", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nsecond")
    path.write_bytes(out + b"\x1f\x8bbroken")


def test_warc(spark, tmp_path):
    write_warc(tmp_path / "a.warc.gz")
    records = warc.read_warc(spark, str(tmp_path))
    spark.dataSource.register(warc.WarcSource)
    again = spark.read.format("warc").option("paths", f"{tmp_path}/a.warc.gz,{tmp_path}/none.gz").load()
    assert records.count() == again.where("rec_type <> 'failed'").count() == 20 and again.where("rec_type = 'failed'").count() == 1
    found = warc.html_pages(records).collect()
    assert len(found) == 5 and {r.detected_language for r in found} == {"eng"} and all("Straße" in r.html for r in found)
    assert [r.status for r in warc.html_pages(records, errors_only=True).collect()] == [404]
    assert warc.html_pages(records, max_pages=2).count() == 2
    for kw in ({}, {"errors_only": True}, {"max_pages": 2}):
        a, b = (sorted(map(str, df.select("seq", "url", "status", "detected_language", "html").collect())) for df in (warc.html_pages(records, **kw), warc.read_pages(spark, str(tmp_path), **kw)))
        assert a == b and a
    rows = P.page_rows_v1(warc.html_pages(records).withColumnRenamed("status", "http_status"))
    assert rows.groupBy("decision").count().count() == 4


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "https://a.example/1", NEWS), (2, "https://a.example/1", NEWS), (3, "https://b.example/", NEWS)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/in")
    q = stream.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 2 and {r.host for r in got.collect()} == {"a.example", "b.example"}


def test_manifest_does_not_depend_on_partitions(spark):
    df = spark.range(100).select(F.lit("train").alias("split"), (F.col("id") % 7).alias("source_group"), F.col("id").cast("string").alias("row"))
    digests = {D.split_manifest(df.repartition(n), F.col("row")).first().digest for n in (1, 7, 50)}
    assert len(digests) == 1
    assert D.split_manifest(df.where("row < '99'"), F.col("row")).first().digest not in digests


def test_label_expressions_do_not_depend_on_partitions(spark):
    body = NEWS.replace("The library is open.", "The library is open. " * 20)
    df = pages(spark, [(f"https://h{i}.example/p", body, 200, "eng") for i in range(20)])
    a, b = (sorted(map(str, P.page_rows_v1(df.repartition(n)).collect())) for n in (1, 7))
    assert a == b
