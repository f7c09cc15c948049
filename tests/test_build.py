import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.operators import pages as P
from weftline.plans import build
from weftline.sources import files, sink

from test_functions import NEWS
from test_operators import SHOP


@pytest.fixture(scope="module")
def rows(spark):
    body = NEWS.replace("The library is open.", "The library is open. " * 20)
    data = [(f"https://h{i % 20}.example/{i}", body, 404 if i % 9 == 0 else 200, "eng") for i in range(120)]
    return P.page_rows_v1(spark.createDataFrame(data, "url string, html string, http_status int, detected_language string").repartition(3))


def test_builder_v1(spark, rows, tmp_path):
    m = build.build_v1(rows, f"{tmp_path}/v1", pages_per_host=3, per_language=5)
    back = spark.read.json(f"{tmp_path}/v1")
    assert back.count() == sum(c["decision_cases"] for c in m["split_counts"].values())
    hosts = back.select("source_group", "split").distinct()
    assert hosts.count() == hosts.select("source_group").distinct().count()  # no host in two splits
    pages = back.select("source_group", F.regexp_replace("case_id", "::[^:]*$", "").alias("u")).distinct().groupBy("source_group").count()
    assert pages.agg(F.max("count")).first()[0] <= 3
    assert m["split_counts"]["train"]["labels"]["language=en"] <= 5
    kept = json.loads((tmp_path / "v1" / "_manifest.json").read_text())
    assert kept["revision"] == m["revision"] and len(m["revision"]) == 16
    assert build.build_v1(rows.repartition(5), f"{tmp_path}/again", pages_per_host=3, per_language=5)["revision"] == m["revision"]


def test_builder_v0_balances_train_alone_and_mixes(spark, rows, tmp_path):
    shops = P.page_rows_v0(spark.createDataFrame([(f"https://s{i}.example/p", SHOP if i % 4 else SHOP.replace("InStock", "SoldOut"), 200, "") for i in range(60)], "url string, html string, http_status int, detected_language string"))
    m = build.build_v0(shops, f"{tmp_path}/v0", max_ratio=1.0, old=rows, mix_ratio=0.2)
    train, rest = m["split_counts"]["train"], m["split_counts"]["test"]
    assert train["labels"]["in_stock=true"] == train["labels"]["in_stock=false"]
    assert rest["labels"].get("in_stock=true", 0) >= rest["labels"].get("in_stock=false", 0)
    mixed = spark.read.json(f"{tmp_path}/v0").where("source_group LIKE 'mix::%'")
    own = train["decision_cases"] - mixed.count()
    assert mixed.count() == int(own * 0.2 / 0.8) and {r.split for r in mixed.select("split").distinct().collect()} == {"train"}


def test_merge(spark, rows, tmp_path):
    kept = build.split_rows(rows, 1)
    made = [build.write_dataset(df, f"{tmp_path}/{name}", name) for name, df in (("a", kept.where("source_group < 'h15'")), ("b", kept.where("source_group >= 'h15'")))]
    m = build.merge(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], f"{tmp_path}/m")
    assert sum(c["decision_cases"] for c in m["split_counts"].values()) == rows.count() and m["inputs"] == [x["revision"] for x in made]
    assert json.loads((tmp_path / "m" / "_manifest.json").read_text())["revision"] == m["revision"] == hashlib.sha256("".join(m["inputs"]).encode()).hexdigest()[:16]
    build.write_dataset(kept.withColumn("split", F.lit("test")), f"{tmp_path}/c", "c")
    with pytest.raises(ValueError, match="more than one split"):
        build.merge(spark, [f"{tmp_path}/a", f"{tmp_path}/c"], f"{tmp_path}/n")


def test_merge_raises_for_a_changed_byte(spark, rows, tmp_path):
    kept = build.split_rows(rows, 1)
    made = [build.write_dataset(df, f"{tmp_path}/{name}", name) for name, df in (("a", kept.where("source_group < 'h15'")), ("b", kept.where("source_group >= 'h15'")))]
    name, told = sorted(made[1]["files"].items())[0]
    file = tmp_path / "b" / name
    data = file.read_bytes()
    assert hashlib.sha256(data).hexdigest() == told["sha256"] and len(data) == told["bytes"] and data.count(b"\n") == told["rows"]
    for changed in (data[:9] + bytes([data[9] ^ 1]) + data[10:], data[:-1], None):
        file.unlink() if changed is None else file.write_bytes(changed)
        with pytest.raises(ValueError, match=name.rpartition("/")[2]):
            build.merge(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], f"{tmp_path}/m")
    assert not sink.exists(f"{tmp_path}/m")


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([(i, "é\u2028\n" * (i % 3), ["x", "y /é:%=", None][i % 3]) for i in range(300)], "i int, t string, s string").repartition(5)
    made = sink.write(df, f"{tmp_path}/d", "s", {"dataset": "d"})
    assert made["dataset"] == "d" and sum(f["rows"] for f in made["files"].values()) == 300
    back = sink.read(spark, f"{tmp_path}/d")
    assert sorted(map(tuple, back.select("i", "t", F.coalesce("s", F.lit("-"))).collect())) == sorted((r.i, r.t, r.s or "-") for r in df.collect())
    # an attempt that was lost leaves a file that no manifest names
    (tmp_path / "d" / "s=x" / "part-lost.jsonl").write_text('{"i":1,"t":"lost"}\n')
    assert sink.read(spark, f"{tmp_path}/d").count() == 300 and sink.check(spark, f"{tmp_path}/d") == made
    # a failed job leaves the dataset as it was
    bad = df.withColumn("t", F.when(F.col("i") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("t")))
    with pytest.raises(Exception, match="broken"):
        sink.write(bad, f"{tmp_path}/d", "s")
    assert sink.check(spark, f"{tmp_path}/d") == made
    # a new one takes its place, and its files go
    small = sink.write(df.where("i < 10"), f"{tmp_path}/d", "s")
    left = {f.name for f in (tmp_path / "d").rglob("*.jsonl")}
    names = lambda m: {n.rpartition("/")[2] for n in m["files"]}
    assert sink.read(spark, f"{tmp_path}/d").count() == 10 and names(small) <= left and not names(made) & left
    none = sink.write(df.where("i < 0"), f"{tmp_path}/e", "s")
    assert none["files"] == {} and sink.read(spark, f"{tmp_path}/e").count() == 0 and sink.check(spark, f"{tmp_path}/e") == none


def test_digests_are_taken_in_blocks(spark, tmp_path):
    for i, n in enumerate((0, 1, (1 << 20) - 1, 1 << 20, (3 << 20) + 5)):
        (tmp_path / f"split={i}").mkdir()
        (tmp_path / f"split={i}" / "same name").write_bytes(bytes(i % 256 for i in range(1000)) * (n // 1000) + b"x" * (n % 1000))
    got = {r.name: r.sha256 for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert got == {f"split={i}/same name": hashlib.sha256((tmp_path / f"split={i}" / "same name").read_bytes()).hexdigest() for i in range(1, 5)}


def test_collect_v0(spark):
    untyped, article = "<p>untyped</p>" * 60, SHOP.replace('"Product"', '"Article"')
    html = [SHOP, article, untyped, SHOP, article]
    data = [(f"w{f}", 10 * f + i, f"https://shop{i % 2}.example/{i if i != 3 else 0}", html[i]) for f in range(2) for i in range(5)] + [("w0", 99, "no host", SHOP)]
    df = spark.createDataFrame(data, "warc_file string, seq long, url string, html string").repartition(3)
    urls = lambda **kw: sorted({(r.source_group, r.url[-1]) for r in build.collect_v0(df, **kw).collect()})
    assert urls() == [("shop0.example", "0"), ("shop0.example", "4"), ("shop1.example", "0"), ("shop1.example", "1")]
    assert urls(per_host=1) == [("shop0.example", "0"), ("shop1.example", "1")]
    assert urls(non_product_keep=0.0) == [("shop0.example", "0"), ("shop1.example", "0")]
    assert build.collect_v0(df).where("decision = 'page_type'").count() == 4  # each URL once


def test_fresh_pages(spark):
    body = NEWS.replace("The library is open.", "The library is open. " * 20)
    data = [("w", i, f"https://h{i % 3}.example/{i}", body if i != 4 else "<p>thin") for i in range(9)]
    df = spark.createDataFrame(data, "warc_file string, seq long, url string, html string")
    known = spark.createDataFrame([("h0.example",)], "host string")
    seqs = lambda **kw: sorted(r.seq for r in build.fresh_pages(df, known, **kw).collect())
    assert seqs(per_host=2, per_file=100) == [1, 2, 5, 7] and seqs(per_host=2, per_file=3) == [1, 2, 5]


def test_prepare_benchmark(spark, tmp_path, capsys):
    q = '{"k":{"type":"choice","instructions":"Which?","criteria":{"a":"x","b":"y"}},"s":{"type":"score","instructions":"How?","criteria":["l","h"]}}'
    gold = '{"k":{"probabilities":{"a":3,"b":1}},"s":{"probabilities":{"0":1,"1":1}}}'
    cases = spark.createDataFrame([(f"c{i}", f"w{i % 2}", "{}", q, gold) for i in range(50)], "id string, workflow string, state string, questions string, gold string")
    cases.where("id <> 'c7'").write.parquet(f"{tmp_path}/train")
    cases.where("id = 'c7'").write.parquet(f"{tmp_path}/test")
    assert cli.main(["prepare", f"{tmp_path}/train", f"{tmp_path}/test", f"{tmp_path}/out", "--question-types", "choice,score"]) == 0
    made = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert made["question_types"] == ["choice", "score"] and {s: c["source_groups"] for s, c in made["split_counts"].items()} == {"train": 41, "development": 4, "calibration": 4, "test": 1}
    rows = sink.read(spark, f"{tmp_path}/out")
    assert rows.count() == 100 and rows.where("split = 'test'").select("source_group").distinct().first()[0] == "w1::c7"
    # the split does not depend on the question types
    build.prepare_benchmark(cases.where("id <> 'c7'"), cases.where("id = 'c7'"), f"{tmp_path}/one")
    pairs = lambda p: {tuple(r) for r in sink.read(spark, f"{tmp_path}/{p}").select("source_group", "split").distinct().collect()}
    assert pairs("one") == pairs("out")
    with pytest.raises(ValueError, match="more than one split"):
        build.prepare_benchmark(cases, cases.where("id = 'c7'"), f"{tmp_path}/leak")
    assert cli.main(["merge", f"{tmp_path}/merged", f"{tmp_path}/out"]) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["inputs"] == [made["revision"]]


def test_smoke(spark, capsys):
    assert cli.main(["smoke"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["passed"] and out["permutations_checked"] == 24 and out["losses"][-1] < out["losses"][0]
