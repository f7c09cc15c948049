"""Stages that go on after a stop, operators with state, WARC files in ranges and as a stream."""

import datetime
import gzip
import os
import random
import subprocess
import sys
import textwrap

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import dataset as D
from weftline.sources import warc, warc_ranges, warc_stream
from weftline.streaming import resume, state

SCHEMA = "i long, batch_file string"


def save_parts(spark, folder, n=6, rows=20):
    for k in range(n):
        spark.createDataFrame([(k * rows + j, f"f{k}") for j in range(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(folder)


# ---------------------------------------------------------------- resuming


def stopping(at):
    def stop(batch):
        if batch == at:
            raise RuntimeError("stopped here")

    return stop


@pytest.mark.parametrize("where", ["before the record", "in the rows"])
def test_a_stopped_stage_gives_each_row_once(spark, tmp_path, where):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    save_parts(spark, folder)
    bad = F.when((F.col("i") == 57) & F.lit(where == "in the rows"), F.raise_error(F.lit("stopped here"))).otherwise(F.col("i"))
    q = resume.append(source(spark, folder), lambda b: b.withColumn("i", bad.cast("long")), out, before_commit=stopping(1) if where != "in the rows" else None)
    with pytest.raises(Exception, match="stopped here"):
        q.awaitTermination()
    assert [r["batch"] for r in resume.committed(spark, out)] == [0]
    assert sorted(r.i for r in resume.read(spark, out, SCHEMA).collect()) == list(range(40))
    # a part of the stopped batch is there, and must not be seen twice
    if where != "in the rows":
        assert spark.read.parquet(f"{out}/batch=1").count() == 40
    spark.createDataFrame([(999, "left behind")], SCHEMA).write.mode("append").parquet(f"{out}/batch=1")
    resume.append(source(spark, folder), lambda b: b, out).awaitTermination()
    assert sorted(r.i for r in resume.read(spark, out, SCHEMA).collect()) == list(range(120)) and resume.check(spark, out, SCHEMA) == 120
    # what is done is not done again; what is new is
    resume.append(source(spark, folder), lambda b: b.select(F.raise_error(F.lit("again")).cast("long").alias("i"), "batch_file"), out).awaitTermination()
    spark.createDataFrame([(120, "late")], SCHEMA).write.mode("append").parquet(folder)
    resume.append(source(spark, folder), lambda b: b, out).awaitTermination()
    assert sorted(r.i for r in resume.read(spark, out, SCHEMA).collect()) == list(range(121))
    file = next(f for f in os.listdir(f"{out}/batch=0") if f.startswith("part-"))
    os.remove(f"{out}/batch=0/{file}")
    with pytest.raises(ValueError, match="batch 0"):
        resume.check(spark, out, SCHEMA)


def test_a_killed_process(spark, tmp_path):
    """The process is killed, no exception is handled, between two batches."""
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    save_parts(spark, folder)
    code = f"""
    import os
    from pyspark.sql import SparkSession
    from weftline.streaming import resume
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
    came = spark.readStream.schema({SCHEMA!r}).option("maxFilesPerTrigger", 2).parquet({folder!r})
    resume.append(came, lambda b: b, {out!r}, before_commit=lambda k: os._exit(9) if k == 1 else None).awaitTermination()
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env={**os.environ, "PYTHONPATH": root}, timeout=120, capture_output=True)
    assert done.returncode == 9
    assert [r["rows"] for r in resume.committed(spark, out)] == [40]
    resume.append(source(spark, folder), lambda b: b, out).awaitTermination()
    assert sorted(r.i for r in resume.read(spark, out, SCHEMA).collect()) == list(range(120))


def test_nothing_recorded(spark, tmp_path):
    assert resume.committed(spark, f"{tmp_path}/none") == [] and resume.read(spark, f"{tmp_path}/none", SCHEMA).count() == 0


# ---------------------------------------------------------------- running cap


def test_thinning_keeps_what_the_cap_keeps():
    rng = random.Random(4)
    for most in (1, 2, 3):
        rows = [(f"g{rng.randrange(3)}", f"p{rng.randrange(9)}", rng.randrange(40), k) for k in range(120)]
        df = pd.DataFrame(rows, columns=["g", "p", "at", "k"])
        kept = pd.concat(state._thinned("g", "p", ["at"], most)(iter([df[:50], df[50:]])))

        def capped(d, most=most):
            out = set()
            for _, part in d.sort_values(["at", "p"], kind="stable").groupby("g"):
                given = {}
                for r in part.itertuples():
                    if r.p in given or len(given) < most:
                        given.setdefault(r.p, r.at)
                        out |= {r.k} if given[r.p] == r.at else set()
            return out

        # ties between pages at one place are broken by the page here; a page has one place in real rows
        df = df.drop_duplicates("at")
        kept = kept[kept.k.isin(df.k)]
        assert capped(df) == capped(pd.concat(state._thinned("g", "p", ["at"], most)(iter([df[:20], df[20:]]))))
        assert len(kept) <= len(df)


def test_running_cap_over_triggers(spark, tmp_path):
    """A hot host with more pages than its cap in every file, pages again in later files, two rows a page."""
    rng = random.Random(1)
    rows = []
    for f in range(4):
        for seq in range(60):
            host = "hot" if rng.random() < 0.5 else f"h{rng.randrange(12)}"
            url = f"{host}/{rng.randrange(9)}"
            rows += [(f"w{f}", seq, host, url, d) for d in ("a", "b")]
    schema = "warc_file string, seq long, host string, url string, decision string"
    for f in range(4):
        spark.createDataFrame([r for r in rows if r[0] == f"w{f}"], schema).repartition(1).write.mode("append").parquet(f"{tmp_path}/in")
    came = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state.to_table(state.running_cap(came, "host", "url", ["warc_file", "seq"], 3), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    got = sorted(map(tuple, spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()))
    pages = spark.createDataFrame(rows, schema).select("warc_file", "seq", "host", "url").distinct()
    kept = D.running_cap(D.first_wins(pages, ["url"], ["warc_file", "seq"]), "host", ["warc_file", "seq"], 3)
    keys = {tuple(r) for r in kept.select("warc_file", "seq", "url").collect()}
    assert got == sorted(r for r in rows if (r[0], r[1], r[3]) in keys) and len({r[2] for r in got}) == 13


# ---------------------------------------------------------------- metadata

RECORD = "warc_file string, seq long, url string, rec_type string, lang3 string"


def test_metadata_for_any_cut(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"w{f}", s, rng.choice(["a", "b", None]), rng.choice(["response", "metadata", "metadata", "warcinfo"]), f"l{s}") for f in range(5) for s in range(80)]
    cuts = {f"w{f}": sorted(rng.randrange(80) for _ in range(3)) for f in range(5)}
    schema = spark.createDataFrame([], RECORD).schema
    for k in range(4):
        part = [r for r in rows if sum(r[1] >= c for c in cuts[r[0]]) == k]
        rng.shuffle(part)
        spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    state.ended(spark.createDataFrame([(f"w{f}",) for f in range(5)], "warc_file string"), "warc_file", schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    came = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state.to_table(state.attach_metadata(came), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = D.attach_metadata(spark.createDataFrame(rows, RECORD))
    cols = ["warc_file", "seq", "url", "rec_type", "lang3", "detected_language"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_a_file_that_never_ends(spark, tmp_path):
    """The watermark sends a response on; metadata that comes after it finds nothing."""
    schema = RECORD + ", ts timestamp"
    at = lambda m: datetime.datetime(2026, 1, 1, m // 60, m % 60)
    batches = [[("w", 0, "a", "response", None, at(0)), ("v", 0, "b", "response", None, at(1))], [("v", 1, "b", "metadata", "eng", at(5))], [("x", 0, "c", "response", None, at(60))], [("w", 1, "a", "metadata", "late", at(61)), ("x", 1, "c", "metadata", "fra", at(61))]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    came = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    state.to_table(state.attach_metadata(came, time="ts", wait_seconds=600), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert {(r.warc_file, r.detected_language) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("w", None), ("v", "eng"), ("x", "fra")}


# ---------------------------------------------------------------- WARC in ranges


def member(kind, url, body, level=6):
    return gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\n\r\n".encode() + body, level)


def response(url, html, level=6):
    return member("response", url, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + html, level)


def archive(rng, n=60):
    """Members of all sizes, records of other kinds, one whose body is an archive stored as it is, one that is no record."""
    inner = b"".join(response(f"http://inner/{i}", b"in" * 40) for i in range(30))
    out = []
    for i in range(n):
        size = rng.choice([0, 10, 500, 4000, 30_000])
        out.append(response(f"http://a/{i}", bytes(rng.randrange(256) for _ in range(size)), rng.choice([0, 1, 9])))
        if i % 3 == 0:
            out.append(member("metadata", f"http://a/{i}", b'languages-cld2: {"languages":[{"code-iso-639-3":"eng"}]}\r\n'))
        if i % 7 == 0:
            out += [member("warcinfo", "", b"x" * 50), gzip.compress(b"no record at all", 0)]
        if i % 10 == 4:
            out.append(response(f"http://nested/{i}", inner, 0))
    return out


def key(df):
    return sorted(str((r.warc_file.rpartition("/")[2], r.seq, r.rec_type, r.url, r.status, r.http, bytes(r.body) if r.body is not None else None, r.lang3)) for r in df.collect())


@pytest.mark.parametrize("split", [700, 5_000, 64 << 20])
def test_ranges_give_what_one_reader_gives(spark, tmp_path, split):
    rng = random.Random(split)
    whole = archive(rng)
    data = b"".join(whole)
    files = {"whole": data, "cut": data[: len(data) * 2 // 3], "broken": b"".join(whole[:40]) + b"\x1f\x8b\x08 not a member" + b"".join(whole[40:]), "padded": data + bytes(900), "garbage": b"no gzip" * 300, "empty": b"", "one": whole[0]}
    for name, content in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(content)
    got, want = warc_ranges.read_warc(spark, str(tmp_path), split), warc.read_warc(spark, str(tmp_path))
    assert key(got) == key(want)
    if split == 5_000:
        index = warc_ranges.member_ranges(spark, str(tmp_path), split)
        assert index.where("warc_file LIKE '%whole%'").count() > 10
        back = warc_ranges.fetch(got.select("warc_file", "seq", "url", "offset", "length"))
        assert sorted(str((r.url, r.seq, r.body)) for r in back.where("url LIKE 'http://%'").collect() if r.body is not None) == sorted(str((r.url, r.seq, r.body)) for r in want.where("body IS NOT NULL").collect())


def test_filters_reach_the_reader(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(archive(random.Random(1), 9)))
    spark.dataSource.register(warc.WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = spark.read.format("warc").option("paths", f"{tmp_path}/a.warc.gz,{tmp_path}/none").option("pushdown", "true").load()
        all_rows = found.collect()
        assert {r.rec_type for r in all_rows} == {"response", "metadata", "failed"}
        assert found.where("rec_type = 'metadata'").count() == sum(r.rec_type == "metadata" for r in all_rows)
        assert found.where("rec_type IN ('response', 'failed') AND status = 200").count() == sum(r.status == 200 for r in all_rows)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    plain = spark.read.format("warc").option("paths", f"{tmp_path}/a.warc.gz").option("rec_type", "metadata").load()
    assert {r.rec_type for r in plain.where("seq >= 0").collect()} == {"metadata"}
    reader = warc.PushingReader({"paths": f"{tmp_path}/a.warc.gz"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    filters = [EqualTo(("rec_type",), "metadata"), GreaterThan(("seq",), 3)]
    assert list(reader.pushFilters(filters)) == filters and {r[2] for r in reader.read(reader.partitions()[0])} == {"metadata"}


def test_a_growing_folder(spark, tmp_path):
    folder, log = tmp_path / "in", tmp_path / "log"
    folder.mkdir()
    spark.dataSource.register(warc_stream.WarcStream)

    def run():
        came = spark.readStream.format("warc_stream").option("path", str(folder)).option("log", str(log)).option("files_per_trigger", 2).option("rec_type", "response,end").option("end", "true").load()
        q = came.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    names = [f"f{k}.warc.gz" for k in (3, 1, 2, 0, 4)]
    for i, name in enumerate(names[:3]):
        (folder / name).write_bytes(b"".join(archive(random.Random(i), 5)))
    run()
    for i, name in enumerate(names[3:]):  # these sort before what was read
        (folder / name).write_bytes(b"".join(archive(random.Random(i), 5)))
    run()
    run()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = warc.read_warc(spark, str(folder)).where("rec_type = 'response'")
    place = lambda df: sorted((r.warc_file.rpartition("/")[2], r.seq) for r in df.collect())
    assert place(got.where("rec_type = 'response'")) == place(want) and got.where("rec_type = 'end'").count() == 5
    assert len([f for f in os.listdir(log) if f.isdigit()]) == 3
    reader = warc_stream.WarcStreamReader({"path": str(folder), "log": str(log)})
    assert reader.latestOffset() == {"entry": 2} and len(reader.partitions({"entry": -1}, {"entry": 2})) == 5
