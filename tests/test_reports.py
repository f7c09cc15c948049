"""Streams of bounded memory, scoring without shuffles, exact quantiles, whole commands."""

import gzip
import itertools
import json
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.functions import exprs as E
from weftline.operators import dataset as D
from weftline.operators import evaluation as V
from weftline.operators import training as R
from weftline.operators import typed as T
from weftline.sources import warc

from test_functions import NEWS


def member(kind, url, body):
    return gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\n\r\n".encode() + body)


def page(body, status="200 OK"):
    return f"HTTP/1.1 {status}\r\nContent-Type: text/html; charset=utf-8\r\n\r\n{body}".encode()


def test_warc_files_stream_in_bounded_memory(tmp_path):
    """80 records of 4 MB each, and one record of 64 MB that a few kilobytes hold."""
    with open(tmp_path / "big.warc.gz", "wb") as f:
        for i in range(80):
            f.write(member("response", f"https://h{i}.example/", page("<p>" + "x" * 4_000_000)))
        f.write(member("response", "https://bomb.example/", page("y" * (64 << 20))))
        f.write(member("response", "https://last.example/", page("<p>end")))
    tracemalloc.start()
    urls = [r["url"] for r in warc.streamed(str(tmp_path / "big.warc.gz"), 10**12)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(urls) == 82 and urls[-1] == "https://last.example/" and peak < 24 << 20


def test_files_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good.warc.gz").write_bytes(member("response", "https://h.example/", page("<p>fine")))
    rows = [r for name in (f"{tmp_path}/a/good.warc.gz", f"{tmp_path}/a/none.warc.gz") for r in warc.streamed(name, 10**12)]
    assert [r["rec_type"] for r in rows] == ["response", "failed"] and "FileNotFoundError" in rows[1]["url"]
    assert warc.scan_pages(spark, f"{tmp_path}/a").select("url", "error").collect() == [("https://h.example/", None)]


def test_build_command(spark, tmp_path, capsys):
    """WARC files to a balanced dataset with its manifest, errors from their own files."""
    body = NEWS.replace("The library is open.", "The library is open. " * 20)
    for folder, status in (("ok", "200 OK"), ("bad", "404 Not Found")):
        (tmp_path / folder).mkdir()
        for k in range(2):
            with open(tmp_path / folder / f"{k}.warc.gz", "wb") as f:
                for i in range(30):
                    url = f"https://h{k}x{i % 10}.example/{folder}{i}"
                    f.write(member("response", url, page(body, status)))
                    f.write(member("metadata", url, b'languages-cld2: {"languages":[{"code-iso-639-3":"eng"}]}\r\n'))
    assert cli.main(["build", f"{tmp_path}/ok", f"{tmp_path}/out", "--errors", f"{tmp_path}/bad", "--pages-per-host", "4", "--per-language", "7"]) == 0
    made = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert made["failed_warcs"] == [] and made["failed"] == 0
    back = spark.read.json(f"{tmp_path}/out")
    assert back.count() == sum(c["decision_cases"] for c in made["split_counts"].values()) > 0
    assert {"ok", "not_found"} <= {r[0] for r in back.select(E.gold_label(F.col("candidates.id"), F.col("target"))).distinct().collect()}
    assert back.select("source_group", "case_id").withColumn("u", E.url_of_case(F.col("case_id"))).groupBy("source_group").agg(F.count_distinct("u").alias("n")).agg(F.max("n")).first()[0] <= 4


def test_scores_do_not_depend_on_the_order_of_options(spark):
    """All 24 permutations of four options: without a bias any number of orders, with one all four rotations, give each option its own probability."""

    class Favours:
        """The first place gets a bias; the rest hangs on the option alone."""

        def __init__(self, bias):
            self.bias = bias

        def logits(self, state, text, options):
            return [[len(x) / 3 + self.bias * (i == 0) for i, x in enumerate(o)] for o in options]

    options = ["a", "bb", "cccc", "ddddddd"]
    rows = [(k, "choice", "s", "t", list(p), list(p)) for k, p in enumerate(itertools.permutations(options))]
    df = spark.createDataFrame(rows, "item_id int, kind string, state string, text string, ids array<string>, texts array<string>")
    for scorer, orders in ((Favours(0.0), 1), (Favours(0.0), 3)):
        found = {tuple(round(r.p[r.ids.index(x)], 9) for x in options) for r in T.score(df, scorer, orders=orders).collect()}
        assert len(found) == 1
    first, every = ({tuple(round(r.p[r.ids.index(x)], 9) for x in options) for r in T.score(df, Favours(2.0), orders=n).collect()} for n in (1, 4))
    assert len(first) == 4 and len(every) == 1  # over all rotations each option stands first once
    plan = T.score(df, Favours(0.0), orders=4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_batch_arrays():
    packed = [([1, 2, 3, 4, 5, 6, 7], [(3, 5), (5, 7)]), ([1, 2, 9], [(2, 3)])]
    ids, mask, spans, places = T.batch_arrays(packed, 0, shared=True)
    assert ids.tolist() == [[1, 2, 3, 4, 5, 6, 7], [1, 2, 9, 0, 0, 0, 0]] and mask.sum(axis=1).tolist() == [7, 3]
    assert spans.shape == (2, 2, 7) and spans[0, 1].tolist() == [0, 0, 0, 0, 0, 1, 1] and spans[1, 1].sum() == 0
    assert places.tolist() == [[0, 1, 2, 3, 4, 3, 4], [0, 1, 2, 0, 0, 0, 0]]
    assert len(T.batch_arrays(packed, 0)) == 3


def test_order_statistics(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    values.sort()
    for few in (50, 100_000):
        ranks = [0, 1, 2000, 3500, 5000, len(values) - 1]
        assert V.order_statistics(df, "x", ranks, few=few) == [values[r] for r in ranks]
        assert np.allclose(V.order_statistics(df, "x", places=[0.5, 0.95], few=few), np.quantile(values, [0.5, 0.95]))
    assert V.order_statistics(df.where("x IS NULL"), "x", places=[0.5]) == [None]


def test_faults_are_told(spark):
    rows = spark.createDataFrame([("train", "none", "w", "g"), ("test", "none", "w", "g"), ("test", "x", "w", "g")], "split string, label_source string, workflow string, source_group string")
    with pytest.raises(ValueError, match="1 training rows"):
        R.labelled(rows)
    assert R.labelled(rows.where("split = 'test'")).count() == 1 and R.labelled(rows, teacher=True).count() == 2
    with pytest.raises(ValueError, match="several sources"):
        D.state_ablations(rows, state="label_source")
    with pytest.raises(ValueError, match="nonnegative"):
        V.training_loss(F.lit(1), F.lit(1), weight=-1.0)
    bad = spark.createDataFrame([([1.0, 2.0], [0.0, 0.0], True)], "l array<double>, t array<double>, y boolean")
    with pytest.raises(Exception, match="target mass"):
        bad.agg(V.training_loss(F.col("l"), F.col("t"), None, F.col("y"))["loss"]).collect()
    a = spark.createDataFrame([("1", None, "d", "x", "x", {"x": 1.0})], "case_id string, source_group string, request_sha256 string, expected string, raw_choice string, probabilities map<string,double>")
    assert V.paired(a, a.withColumn("source_group", F.lit("g"))).first().problem == "incompatible source_group"
    assert V.paired(a, a).first().problem is None


def test_schema_key_and_shuffle(spark):
    one, two = ("[{'id':'a','text':'x'},{'id':'b','text':'y'}]", "[{'id':'b','text':'y'},{'id':'a','text':'x'}]")
    df = spark.createDataFrame([("w", "u1::p::q", one), ("w", "u2::p::q", two), ("w", "u3::r", one)], "w string, c string, o string")
    options = F.from_json("o", "array<struct<id:string,text:string>>", {"allowSingleQuotes": "true"})
    keys = [str(r[0]) for r in df.select(V.schema_key(F.col("w"), F.col("c"), options)).collect()]
    assert keys[0] == keys[1] != keys[2]
    a, b = ([r.id for r in D.shuffled(spark.range(50).repartition(n), "id", 4).collect()] for n in (1, 7))
    assert a == b != sorted(a) and sorted(a) == list(range(50))


def test_outlines_of_made_pages():
    """Pages worked out by hand, piece by piece."""
    from weftline.functions import html as H

    rows = "".join(f"<tr><td>{i}</td><td>{'z' * 50}</td></tr>" for i in range(8))
    cases = {
        "<p>a <b>b</b> c</p>": "<p> a b\nc",
        "<div>one <div>two</div>three": "one two\nthree",
        "<h1>T</h1>text<br>more": "<h1> T\ntext more",
        "<main><article><p>x</p></article><p>y</p></main><p>z</p>": "<article>\n  <p> x\n<main>\n  <p> y\n<p> z",
        "<nav><a href=1>A</a><a href=2>B</a></nav>": "<nav links=2> A | B",
        "<nav></nav><footer> </footer>": "",
        "<form><input name=a><input type=password><input type=hidden name=h><button>Go</button><input type=submit value=Send></form>": "<form fields=a,password buttons=Go,Send>",
        "<form><label>Name</label><input><input></form>": "<form fields=text> Name",
        "<div role=navigation><p>x</p></div>": "<nav> x",
        "<section class='Cookie-Bar'><p>We use</p><button>OK</button></section>": "<cookie buttons=OK> We use",
        "<span class=menu>not a region</span>": "not a region",
        "<ul id=breadcrumbs><li><a>H</a></li></ul>": "<nav links=1> H",
        f"<table>{rows}</table>": "\n".join([f"<row> {i} | {'z' * 40}" for i in range(6)] + ["<table> ... 8 rows in all"]),
        "<table><tr>" + "<td>c</td>" * 10 + "</table>": "<row> " + " | ".join("c" * 8),
        "<table><tr><td>a<p>para</p></td></tr></table>": "<p> para\n<row> a",
        "<table><tr><th>open": "<row> open",
        "<aside><p>s</p></aside><div class=comment-list><p>c</p></div>": "<aside>\n  <p> s\n<comments>\n  <p> c",
        "<header><nav><a>x</a></nav><h2>t</h2></header>": "<header>\n  <nav links=1> x\n  <h2> t",
        "</p></div>stray": "stray",
        "<p>unclosed <div>next</div>": "<p> unclosed next",
        "<script><p>no</p></script><style>x</style><noscript>n</noscript>yes": "yes",
        "<head><title>T</title>hidden</head>seen": "seen",
        "<svg><p>in</p></svg><template>t</template>out": "out",
        "<p>&lt;b&gt; &amp; caf&eacute;</p>": "<p> <b> & café",
        "<p>" + "w" * 400 + "</p>": "<p> " + "w" * 300,
        "<li>1<li>2</li></li>": "<li> 1\n<li> 2",
        "<button>B</button><time>T</time><caption>C</caption>": "<button> B\n<time> T\n<caption> C",
        "<form><p>in <main>no region</main></p></form>": "<form> in no region",
        "<nav>" + "<p>" + "t" * 40 + "</p>" + "".join(f"<p>{i}</p>" for i in range(12)) + "</nav>": "<nav> " + " | ".join(["t" * 30, *map(str, range(7))]),
        "": "",
    }
    for html, want in cases.items():
        assert H.outline(H.read_page(html)) == want, html
    page = H.read_page('<HTML lang="de"><head><title>A &amp; B</title><meta name="OG:Type" content=article><script type="application/LD+json">{"a":1}</script></head><p>x')
    assert (page.title, page.html_lang, page.jsonld, page.meta) == ("A & B", "de", ['{"a":1}'], {"og:type": "article"})
    lines = [H.Line("", "p", "x" * 90) for _ in range(50)]
    random.Random(1).shuffle(lines)
    assert len(H.outline(H.Page(lines=lines)).split("\n")) == 3001 // 95


def test_visible_text_of_made_pages():
    from weftline.functions import html as H

    cases = {
        "<p>a <b>b</b> c</p>d": (["a b c", "d"], 0),
        "a<br>b<a href=1>c</a>": (["a", "bc"], 1),
        "<title>t</title>x<script>y</script>z": (["xz"], 0),
        "<div>1<div>2</div>3</div>": (["1", "2", "3"], 0),
        "<option>o<option>p": (["o", "p"], 0),
    }
    for html, (blocks, links) in cases.items():
        got = H.read_text_page(html)
        assert (got.blocks, got.links) == (blocks, links), html
    assert H.visible_text(["abc", "defg", "h"], 100) == "abc\ndefg\nh"
    assert [H.visible_text(["abc", "defg", "h"], n) for n in (3, 4, 5, 8, 9, 10)] == ["abc", "abc", "abc\nd", "abc\ndefg", "abc\ndefg", "abc\ndefg\nh"]
