"""Expressions and labels against literals worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import constants as K
from weftline.functions import exprs as E
from weftline.functions import html as H
from weftline.functions import labels as L


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(*x):
    return F.array(*map(F.lit, x))


def test_hosts_and_cases(spark):
    urls = ["http://User@WWW.Host_x.Example:80/p?q#f", "https://a.b.c", "ftp://www.x.org/", "no url", None]
    rows = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(E.host_of(F.col("u"))).collect()]
    assert rows == ["host_x.example", "a.b.c", "x.org", "", ""]
    r = one(spark, E.decision_of(F.lit("u::v::page_type")), E.url_of_case(F.lit("u::v::page_type")), E.first_key(F.lit("u::v::page_type")), E.squeeze(F.lit("  a  b\n")))
    assert tuple(r) == ("page_type", "u::v", "v::page_type", "a b")


def test_split_shares(spark):
    import hashlib

    df = spark.range(3000).select(F.col("id").cast("string").alias("g")).select("g", E.split_of(F.col("g"), 1).alias("s"))
    counts = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert abs(counts["train"] / 3000 - 0.8) < 0.03 and set(counts) == {n for n, _ in K.SPLIT_SHARES}
    point = int(hashlib.sha256(b"1:17").hexdigest()[:8], 16) / 0xFFFFFFFF
    want = "train" if point <= 0.8 else "development" if point <= 0.88 else "calibration" if point <= 0.94 else "test"
    assert df.where("g = '17'").first().s == want


def test_distributions(spark):
    r = one(
        spark,
        E.softmax(arr(1000.0, 1001.0)).alias("big"),
        E.concentration(arr(0.5, 0.5)),
        E.concentration(arr(1.0, 0.0)),
        E.concentration(arr(0.2, 0.3, 0.5)),
        E.ranked_probability_score(arr(0.97, 0.01, 0.01, 0.01), arr(0.0, 0.0, 0.0, 1.0)),
        E.gold_label(arr("a", "b", "c"), arr(0.1, 0.45, 0.45)),
        E.gold_set(arr("a", "b", "c"), arr(0.0, 0.5, 0.5)),
        E.ranked(arr(0.4, 0.4, 0.2), arr("z", "b", "c"))[0]["id"],
    )
    assert math.isclose(r[0][1], 1 / (1 + math.exp(-1)))
    assert (r[1], r[2]) == (0.0, 1.0) and math.isclose(r[3], 0.25)
    assert math.isclose(r[4], (0.97**2 + 0.98**2 + 0.99**2) / 3)
    assert r[5] == "b" and r[6] == ["b", "c"] and r[7] == "b"


def test_option_orders(spark):
    cases = [((4, 1), [0]), ((4, 2), [0, 2]), ((3, 3), [0, 1, 2]), ((2, 5), [0, 1])]
    for (n, m), want in cases:
        assert one(spark, E.option_orders(F.lit(n), m))[0] == want
    r = one(spark, E.rotate(arr(0, 1, 2, 3), F.lit(3)), E.unrotate(E.rotate(arr(0, 1, 2, 3), F.lit(3)), F.lit(3)))
    assert r[0] == [3, 0, 1, 2] and r[1] == [0, 1, 2, 3]


def test_weights_and_schedule(spark):
    r = one(spark, E.row_weight(F.lit(1.0)), E.row_weight(F.lit(0.0)), E.row_weight(F.lit(None).cast("double")), E.row_weight(F.lit(float("nan"))))
    assert tuple(r) == (1.0, 0.1, 1.0, 1.0)
    r = one(spark, *(E.lr_factor(F.lit(s), 100, 0.1, "linear") for s in (0, 9, 55)), E.lr_factor(F.lit(50), 100, 0.0, "cosine"), E.lr_factor(F.lit(70), 100, 0.1, "constant"))
    assert [round(x, 9) for x in r] == [0.1, 1.0, 0.5, 0.5, 1.0]
    with pytest.raises(ValueError):
        E.lr_factor(F.lit(0), 10, 0.1, "step")


def test_answers(spark):
    a = lambda kind, ids, p: E.answer(F.lit(kind), arr(*ids), arr(*ids), arr(*p), 0.8)
    r = one(spark, a("choice", "ab", (0.25, 0.75)).alias("c"), a("score", "012", (0.1, 0.2, 0.7)).alias("s"), a("noul", ("false", "true"), (0.3, 0.7)).alias("n"))
    assert r.c.choice == "b" and r.c.abstain and r.c.probabilities == {"a": 0.25, "b": 0.75} and r.c.confidence == 0.5 and r.c.legend is None
    assert r.s.score == 1.6 and r.s.legend == {"0": "0", "1": "1", "2": "2"} and r.s.choice is None
    assert r.n.noul == 0.7 and r.n.confidence == 0.7 and r.n.probabilities is None


def test_policy(spark):
    d = lambda logits, **kw: E.decide(arr(*"ab"), arr(*logits), **{"trained": True} | kw)
    r = one(spark, d((5.0, 0.0)).alias("fine"), d((5.0, 0.0), trained=False).alias("raw"), d((1.0, 1.0)).alias("tie"), d((5.0, 0.0), answerability=F.lit(0.1)).alias("no"), d((0.3, 0.0)).alias("low"), d((0.03, 0.0), min_probability=0.5).alias("small"), d((1e300, -1e300), temperature=1e-9).alias("far"))
    assert r.fine.choice == "a" and not r.fine.abstain
    assert one(spark, E.decide(arr(*"ab"), arr(5.0, 0.0)).alias("x")).x.reason == "untrained_model"  # unless told otherwise
    assert [r[c].reason for c in ("raw", "tie", "no", "low", "small")] == ["untrained_model", "ambiguous_tie", "no_supported_candidate", "low_probability", "small_margin"]
    assert r.tie.raw_choice == "a" and r.tie.choice is None and r.far.top_probability == 1.0
    with pytest.raises(ValueError):
        d((1.0, 0.0), min_margin=1.5)


@pytest.mark.parametrize(
    ("text", "want"),
    [("₹1,299.00", 1299.0), ("1.299,50 €", 1299.5), ("$12", 12.0), ("1299", 1299.0), ("Rs. 2,49,999", 249999.0), ("€1.299", 1299.0), ("19,99 €", 19.99), ("free", None)],
)
def test_money(spark, text, want):
    assert one(spark, L.parse_amount(F.lit(text)))[0] == want
    assert L.amount(text) == want


def test_votes(spark):
    def resolved(types, og, url):
        r = one(spark, L.resolve_votes(L.schema_vote(arr(*types).cast("array<string>")), L.og_vote(F.lit(og)), L.url_vote(F.lit(url))).alias("r")).r
        return r.label, r.quality

    assert resolved(["NewsArticle"], "article", "https://a.org/x") == ("news_article", "agreed")
    assert resolved(["Recipe"], "product", "https://a.org/x") == (None, "conflict")
    assert resolved(["Recipe"], "", "https://a.org/tag/soups/") == (None, "conflict")
    assert resolved([], "", "https://a.org/") == ("home", "single")
    assert resolved(["Product"], "", "https://a.org") == (None, "conflict")
    assert resolved(["Store"], "", "https://a.org") == ("home", "agreed")
    assert resolved(["AboutPage"], "", "https://a.org/ABOUT") == ("about", "agreed")
    assert resolved([], "article", "https://a.org/x") == (None, "none")


def test_language_status_stock_dates(spark):
    r = one(
        spark,
        L.language_label(F.lit("pt_BR"), F.lit("por")),
        L.language_label(F.lit("pt"), F.lit("glg")),
        L.status_label(F.lit(410)),
        L.status_label(F.lit(302)),
        L.stock(arr("https://schema.org/InStock", "schema:OnlineOnly")),
        L.stock(arr("SoldOut/")),
        L.stock(arr("InStock", "SoldOut")),
        L.published_date(arr("{}", '{"datePublished": "2026-02-31T1"}'), F.lit("2020-01-01")),
        L.published_date(arr("{}"), F.lit("2020-01-01T00")),
        L.date_values(F.lit("on 3rd March 2026 or 05/04/2026, 2026年3月3日")),
    )
    assert list(r)[:7] == ["pt", None, "not_found", None, True, False, None]
    assert tuple(r[7]) == ("2026-02-31", "schema.org datePublished") and tuple(r[8]) == ("2020-01-01", "meta article:published_time")
    assert r[9] == ["2026-03-03", "2026-04-05", "2026-05-04"]


def test_json_ld():
    graph = json.dumps({"@graph": [{"@type": ["FAQPage"]}, {"author": {"@type": "Person"}}]})
    assert L.schema_types([graph, "broken"]) == ["FAQPage"]
    assert [L.node_types(n) for n in L.schema_nodes([graph + ";"])] == [[], ["FAQPage"], [], ["Person"]]
    assert L.schema_types(['{"@type": "schema:Product"}']) == ["schema:Product"] and L.node_types({"@type": "schema:Product"}) == ["Product"]
    group = L.schema_nodes(['{"@type": "ProductGroup", "offers": {"price": 5}}'])
    assert L.offer_price(group) is None
    assert L.offer_price(L.schema_nodes(['{"@type": "Product", "offers": [{"price": ""}, {"lowPrice": "7,50"}]}'])) == 7.5


NEWS = """<html lang="en"><head><title>Library  hours</title><meta property="og:type" content="article">
<script type="application/ld+json">{"@type":"NewsArticle","datePublished":"2026-03-14"}</script></head><body>
<div class="site-navigation"><a href="/">Home</a> <a href="/n">News</a> <a href="/c">Contact</a></div>
<main><h1>Library hours</h1><time>14 March 2026</time><p>The library is open. Next change on 2 April 2026.</p></main>
<form><input type="email"><input type="password"><input type="hidden" name="t"><button>Sign in</button></form>
<footer><a>Privacy</a> <a>Terms</a></footer><script>secret()</script></body></html>"""


def test_outline():
    p = H.read_page(NEWS)
    text = H.outline(p).split("\n")
    assert text[0] == "<nav links=3> Home | News | Contact"
    assert text[1:4] == ["<main>", "  <h1> Library hours", "  <time> 14 March 2026"]
    assert "<form fields=email,password buttons=Sign in>" in [x.strip() for x in text]
    assert text[-1] == "<footer links=2> Privacy | Terms"
    assert "secret" not in "".join(text) and "NewsArticle" not in "".join(text)
    assert p.html_lang == "en" and p.meta["og:type"] == "article" and H.squeeze(p.title) == "Library hours"


def test_outline_of_tables_and_broken_pages():
    rows = "".join(f"<tr><td>r{i}</td><td>{i}</td></tr>" for i in range(10))
    lines = H.outline(H.read_page(f"<body><table>{rows}</table></body>")).split("\n")
    assert lines[:2] == ["<row> r0 | 0", "<row> r1 | 1"] and len(lines) == 7 and lines[-1] == "<table> ... 10 rows in all"
    assert "Unclosed bold" in H.outline(H.read_page("<div><p><b>Unclosed bold"))
    assert H.outline(H.read_page("<html><head><title>x</title><body><p>text</p>")) == ""  # the head never ends
    outside = H.read_page("<body><title>Out</title><p>in</p></body>")
    assert [x.text for x in outside.lines] == ["Out", "in"] and outside.title == "Out"
    assert H.read_text_page("<body><title>Out</title><p>in</p></body>").blocks == ["in"]
    assert H.read_page('<script type="application/ld+json; x">{}</script>').jsonld == ["{}"]
    assert H.read_text_page('<script type="application/ld+json; x">{}</script>').jsonld == []
    long = H.read_page("".join(f"<p>{'w' * 290}</p>" for _ in range(20)))
    assert len(H.outline(long)) <= 3000 and H.outline(long).endswith("w" * 290)  # whole lines
    assert len(H.visible_text(["w" * 290] * 20)) == 3000  # cut in a line


def test_candidates():
    lines = [x.text for x in H.read_page(NEWS).lines if x.info is None]
    dates = L.date_candidates(lines)
    assert [d["dates"] for d in dates] == [["2026-03-14"], ["2026-04-02"]] and "[14 March 2026]" in dates[0]["text"]
    prices = L.price_candidates(["Now ₹1,299.00 only", "was ₹1,499.00", "Now ₹1,299.00 only"])
    assert [p["value"] for p in prices] == [1299.0, 1499.0] and prices[0]["text"] == "Now [₹1,299.00] only"
