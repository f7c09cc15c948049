"""Table functions in SQL."""

import gzip

import pytest

from weftline.functions import html as H
from weftline.sources import udtf, warc

PAGE = "<html lang='en'><head><title> A  page </title></head><body><main><h1>Head</h1><p>Text</p></main></html>"


@pytest.fixture
def sql(spark):
    udtf.register(spark)
    return lambda text, **kw: [r.asDict() for r in spark.sql(text, **kw).collect()]


def test_page_state(spark, sql):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, None, "<p>cut")], "i int, url string, html string")
    got = {r["i"]: r for r in sql("SELECT i, p.* FROM {pages}, LATERAL page_state(url, html) p", pages=pages)}
    assert got[1]["title"] == "A page" and got[1]["html_lang"] == "en" and got[1]["page"] == H.outline(H.read_page(PAGE)) and got[1]["lines"] == 2
    assert got[2]["page"] == "" and got[2]["jsonld"] == [] and got[3]["lines"] == 1
    named = spark.sql("SELECT * FROM page_state('u', '<title>t</title>', 'lines, title')")
    assert named.columns == ["lines", "title"] and named.first().title == "t"
    for bad in ("page_state('u', '<p>', 'nothing')", "page_state('u', 3)"):
        with pytest.raises(Exception, match="no columns|must be a string"):
            sql(f"SELECT * FROM {bad}")
    with pytest.raises(Exception, match="constant"):
        sql("SELECT p.* FROM {pages}, LATERAL page_state(url, html, url) p", pages=pages)


def test_warc_records(spark, sql, tmp_path):
    member = lambda kind, body: gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a/\r\n\r\n".encode() + body)
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n\xe9"
    (tmp_path / "a.gz").write_bytes(member("response", page) + member("metadata", b'languages-cld2: {"languages":[{"code-iso-639-3":"fra"}]}\r\n') + member("response", page.replace(b"html", b"plain")))
    files = spark.createDataFrame([(f"{tmp_path}/a.gz",), (f"{tmp_path}/none.gz",), (None,)], "path string")
    got = sql("SELECT r.* FROM {files}, LATERAL warc_records(path) r", files=files)
    assert sorted((r["seq"], r["rec_type"], r["html"], r["lang3"]) for r in got if r["seq"] >= 0) == [(0, "response", "é", None), (1, "metadata", None, "fra"), (2, "response", None, None)]
    assert [r["rec_type"] for r in got if r["seq"] < 0] == ["failed"]
    assert {r["rec_type"] for r in sql("SELECT r.* FROM {files}, LATERAL warc_records(path, 'metadata') r", files=files)} == {"metadata", "failed"}
    assert len(got) - 1 == warc.read_warc(spark, str(tmp_path)).count()
