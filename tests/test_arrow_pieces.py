"""Python's share of a task is bounded by a piece of a batch, whatever the batch has; results are those of all rows."""

import gzip

import numpy as np
import pyarrow as pa

from weftline.functions import arrow
from weftline.operators import fitting
from weftline.operators import pages as P
from weftline.sources import warc


def test_pages_are_parsed_by_pieces():
    seen = []
    batch = pa.RecordBatch.from_pydict({"i": list(range(300)), "html": [None if i == 7 else f"<p>{i}" for i in range(300)]})
    step = arrow.added(["i"], {"x": pa.string()}, lambda b: [seen.append(b.num_rows) or b.column("html").to_pylist()])
    out = pa.Table.from_batches(step([batch, batch.slice(0, 0)]))
    assert max(seen) == arrow.ROWS and out.column("i").to_pylist() == list(range(300)) and out.column("x").to_pylist() == batch.column("html").to_pylist()


def test_parsed_pages_leave_in_pieces(spark):
    """A frame for each piece: 1,000 pages in one task come out as batches of their own."""
    pages = spark.range(0, 1000, 1, 1).selectExpr("id", "'u' AS url", "concat('<title>', id, '</title><p>Text ', id) AS html")
    sizes = lambda df: [r[0] for r in df.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect()]
    for parse in (P.parse_v0, P.parse_v1):
        assert sum(sizes(parse(pages))) == 1000 and {r.title for r in parse(pages).collect()} == {str(i) for i in range(1000)}


def test_records_leave_a_reader_by_their_bytes(tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + b"x" * 1_000_000
    (tmp_path / "a.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\n\r\n" + body, 1) for _ in range(20)))
    found = list(warc.BatchReader({"paths": f"{tmp_path}/a.gz"}).read(warc._File(f"{tmp_path}/a.gz")))
    assert sum(b.num_rows for b in found) == 20 and max(b.num_rows for b in found) <= 4
    assert found[0].column("http").to_pylist()[0] == [("content-type", "text/html")] and len(found[0].column("body")[0].as_py()) == 1_000_000


def test_gradients_are_summed_by_places():
    rng = np.random.default_rng(1)
    lists = [list(map(int, rng.integers(0, 9, n))) for n in (3, 300, 4, 5, 900, 2)]
    batch = pa.RecordBatch.from_pydict({"places": lists})
    found = list(fitting._by_places([batch], 500))
    assert pa.Table.from_batches(found).column("places").to_pylist() == lists
    assert all(b.num_rows == 1 or sum(map(len, b.column("places").to_pylist())) <= 500 for b in found)


def test_files_are_dealt_to_tasks(spark):
    """q129: names are few bytes, and what they name is much: more than one task reads it."""
    from weftline.plans import catalog_streams as catalog

    plan = catalog.QUERIES["q129_sql_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
