"""WARC files: a Spark data source, and the page scan on top of it."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions import arrow
from ..operators import dataset

BODY = 1_500_000
SCHEMA = "warc_file string, seq long, rec_type string, url string, status int, http map<string,string>, body binary, lang3 string"


def fields(block: str) -> dict[str, str]:
    """A header block, names lower-cased; the last of equal names counts (SRC-2)."""
    pairs = (line.partition(":") for line in block.split("\r\n"))
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def members(stream, max_bytes: int = 10**12, keep: int = BODY + (1 << 20)) -> Iterator[bytes]:
    """The gzip members of a stream one after another, at most `keep` bytes of each; a broken one ends it (SRC-1).

    What is held is one block read and the part of one member that is kept, however large the file or a record is.
    """
    inflate, parts, held, read = zlib.decompressobj(31), [], 0, 0
    while read < max_bytes and (data := stream.read(1 << 16)):
        read += len(data)
        while data:
            try:
                out = inflate.decompress(data, 1 << 20)
            except zlib.error:
                return
            if held < keep:
                parts.append(out[: keep - held])
                held += len(parts[-1])
            data = inflate.unconsumed_tail
            if inflate.eof:
                data = inflate.unused_data
                yield b"".join(parts)
                inflate, parts, held = zlib.decompressobj(31), [], 0


def record(data: bytes, body: int = BODY) -> dict | None:
    """A response or metadata record; others and broken status lines give none (SRC-3)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head.decode("utf-8", "replace").partition("\r\n")[2])
    out = {"rec_type": warc.get("warc-type"), "url": warc.get("warc-target-uri"), "status": None, "http": None, "body": None, "lang3": None}
    if out["rec_type"] == "metadata":
        found = re.search(rb"languages-cld2: (\{.*?\})\r?\n", rest)
        try:
            languages = json.loads(found.group(1)).get("languages") if found else None
            out["lang3"] = (languages or [{}])[0].get("code-iso-639-3", "")
        except (ValueError, AttributeError):
            out["lang3"] = ""
        return out
    if out["rec_type"] != "response":
        return None
    http, _, content = rest.partition(b"\r\n\r\n")
    line, _, block = http.decode("latin-1").partition("\r\n")
    words = line.split()
    if len(words) < 2 or not re.fullmatch(r"[+-]?\d+", words[1]):
        return None
    return out | {"status": int(words[1]), "http": fields(block), "body": content[:body]}


def open_stream(uri: str):
    """A file on any store that Arrow knows (local, HDFS, S3, GCS), as a stream."""
    from urllib.parse import unquote, urlparse

    import pyarrow.fs as fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_stream(unquote(parts.path) if parts.scheme else uri, compression=None)
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_stream(path, compression=None)


def _rows(name: str, stream, max_bytes: int) -> Iterator[dict]:
    for seq, data in enumerate(members(stream, max_bytes)):
        r = record(data)
        if r:
            yield {"warc_file": name, "seq": seq} | r


def _failed(name: str, why: Exception) -> dict:
    """The row that tells that a file could not be read (to its end); the other files go on (DS-2)."""
    return {"warc_file": name, "seq": -1, "rec_type": "failed", "url": f"{type(why).__name__}: {why}", "status": None, "http": None, "body": None, "lang3": None}


def streamed(name: str, max_bytes: int, seen=lambda rows: rows) -> Iterator[dict]:
    """A file's rows as `seen` makes them of its records, and a failed one if reading stops."""
    try:
        with open_stream(name) as stream:
            yield from seen(_rows(name, stream, max_bytes))
    except (OSError, ValueError) as why:
        yield _failed(name, why)


def framed(rows: Iterator[dict], columns: list[str], most: int = 64) -> Iterator[pd.DataFrame]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _paths(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files below a path. Only their names are read; each large file is a split of its own."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


COLUMNS = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]


ARROW = pa.schema({"warc_file": pa.string(), "seq": pa.int64(), "rec_type": pa.string(), "url": pa.string(), "status": pa.int32(), "http": pa.map_(pa.string(), pa.string()), "body": pa.binary(), "lang3": pa.string()})


def batched(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    """A data source's rows as Arrow batches of a few megabytes; of tuples Spark would gather 10,000, whatever their bodies take."""
    header = lambda h: None if h is None else list(h.items())
    return arrow.weighed(((tuple(header(r.get(c)) if c == "http" else r.get(c) for c in COLUMNS), len(r.get("body") or b"")) for r in rows), ARROW)


def read_warc(spark: SparkSession, path: str, max_bytes: int = 10**12) -> DataFrame:
    """Records of all .warc.gz files below a path, streamed member by member; a file is one task's and takes the memory of one record.

    A file that cannot be read gives a row with rec_type "failed".
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["path"]:
                yield from framed(streamed(name, max_bytes), COLUMNS)

    return _paths(spark, path).mapInPandas(step, SCHEMA)


class Wanted:
    """Which records leave a reader, by their type and status; no values mean any. A row that tells of a failed file always does."""

    def __init__(self, rec_type: str | None = None, status: str | None = None) -> None:
        self.types = set(rec_type.split(",")) if rec_type else None
        self.codes = {int(s) for s in status.split(",")} if status else None

    def __call__(self, r: dict) -> bool:
        return r["rec_type"] == "failed" or ((self.types is None or r["rec_type"] in self.types) and (self.codes is None or r["status"] in self.codes))

    def push(self, f: Filter) -> bool:
        """Takes over an equality or a list of values on one of the two columns; what it takes over is true of no failed row either."""
        values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
        name = {("rec_type",): "types", ("status",): "codes"}.get(f.attribute) if values else None
        if name is None:
            return False
        had = getattr(self, name)
        setattr(self, name, set(values) if had is None else had & set(values))
        return True


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WarcReader(DataSourceReader):
    """Streams files member by member, so a file of any size takes the memory of one record; `paths` are separated by commas."""

    def __init__(self, options) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.max_bytes = int(options.get("max_bytes", 10**12))
        self.wanted = Wanted(options.get("rec_type"), options.get("status"))

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, part):
        for r in streamed(part.path, self.max_bytes):
            if self.wanted(r):
                yield tuple(r[c] for c in COLUMNS)


class PushingReader(WarcReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on rec_type and status keep records from being handed to Spark at all; Spark checks them again, for rows of failed files."""
        for f in filters:
            self.wanted.push(f)
            yield f


class _Batches:
    """A reader's rows for Spark, in Arrow batches."""

    def read(self, part) -> Iterator[pa.RecordBatch]:
        return batched(dict(zip(COLUMNS, r, strict=True)) for r in super().read(part))


class BatchReader(_Batches, WarcReader):
    pass


class PushingBatchReader(_Batches, PushingReader):
    pass


class WarcSource(DataSource):
    """spark.dataSource.register(WarcSource); spark.read.format("warc").option("paths", "a.warc.gz,b.warc.gz").load()

    With the option `pushdown` = true, and spark.sql.python.filterPushdown.enabled, filters on rec_type and status are pushed to the reader; without the setting Spark
    refuses a reader that takes filters. The options `rec_type` and `status` do the same without either.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushingBatchReader if str(self.options.get("pushdown", "false")).lower() == "true" else BatchReader)(self.options)


def html_text(body: bytes | None, http: dict | None) -> str | None:
    """The body by the HTTP charset, replacing what is broken; None if it is no HTML (PF-2). Python's codecs decide."""
    kind = (http or {}).get("content-type", "").lower()
    if "html" not in kind or body is None:
        return None
    charset = kind.rpartition("charset=")[2].split(";")[0].strip() if "charset=" in kind else "utf-8"
    try:
        return bytes(body).decode(charset or "utf-8", "replace")
    except LookupError:
        return bytes(body).decode("utf-8", "replace")


def decode(pages: DataFrame) -> DataFrame:
    """html in place of body and http."""
    keep = [f for f in pages.schema.fields if f.name not in ("body", "http")]

    def made(b: pa.RecordBatch) -> list[list]:
        return [[html_text(x, None if h is None else dict(h)) for x, h in zip(b.column("body").to_pylist(), b.column("http").to_pylist(), strict=True)]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return pages.mapInArrow(arrow.added([f.name for f in keep], {"html": pa.string()}, made), f"{fields}, html string")


def with_language(records: Iterator[dict]) -> Iterator[dict]:
    """A file's responses, each with the language of the first metadata record of its URL before the next response (JN-1)."""
    waiting = None
    for r in records:
        if r["rec_type"] == "response":
            if waiting:
                yield waiting
            waiting = r | {"detected_language": None}
        elif waiting and r["url"] == waiting["url"]:
            yield waiting | {"detected_language": r["lang3"]}
            waiting = None
    if waiting:
        yield waiting


def _pages(records: Iterator[dict], errors_only: bool, max_pages: int | None) -> Iterator[dict]:
    seen: set[str] = set()  # of one file
    n = 0
    for r in with_language(records):
        if not r["url"] or r["url"] in seen or (r["status"] == 200) == errors_only:
            continue
        html = html_text(r["body"], r["http"])
        if html is None:
            continue
        seen.add(r["url"])
        yield {k: r[k] for k in ("warc_file", "seq", "url", "status", "detected_language")} | {"html": html}
        n += 1
        if n == max_pages:
            return


def scan_pages(spark: SparkSession, path: str, *, errors_only: bool = False, max_pages: int | None = None) -> DataFrame:
    """`read_pages`, and a row with `error` for each file that could not be read to its end."""
    columns = ["warc_file", "seq", "url", "status", "detected_language", "html", "error"]

    def pages(records: Iterator[dict]) -> Iterator[dict]:
        return (r | {"error": None} for r in _pages(records, errors_only, max_pages))

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["path"]:
                rows = ({"warc_file": name, "seq": -1, "error": r["url"]} if r.get("rec_type") == "failed" else r for r in streamed(name, 10**12, pages))
                yield from framed(({c: r.get(c) for c in columns} for r in rows), columns)

    return _paths(spark, path).mapInPandas(step, "warc_file string, seq long, url string, status int, detected_language string, html string, error string")


def read_pages(spark: SparkSession, path: str, *, errors_only: bool = False, max_pages: int | None = None) -> DataFrame:
    """What `html_pages(read_warc(...))` gives, in one narrow stage: a file is read by one task in order, so its pages need no shuffle."""
    return scan_pages(spark, path, errors_only=errors_only, max_pages=max_pages).where("error IS NULL").drop("error")


def html_pages(records: DataFrame, *, errors_only: bool = False, max_pages: int | None = None, dedupe: str = "per_file") -> DataFrame:
    """(warc_file, seq, url, status, detected_language, html) of scanned records: the wanted status class, the first HTML record of each URL,
    the first pages of each file, with the language found by the crawler (JN-1). `read_pages` does this while it reads."""
    found = dataset.attach_metadata(records.where(F.col("rec_type").isin("response", "metadata")))
    is_html = F.contains(F.lower(F.coalesce(F.try_element_at("http", F.lit("content-type")), F.lit(""))), F.lit("html")) & F.col("body").isNotNull()
    wanted = found.where((F.coalesce("url", F.lit("")) != "") & is_html & ((F.col("status") != 200) if errors_only else (F.col("status") == 200)))
    keys = ["warc_file", "url"] if dedupe == "per_file" else ["url"]
    slim = wanted.select("warc_file", "seq", "url").transform(lambda d: dataset.first_wins(d, keys, ["seq"] if dedupe == "per_file" else ["warc_file", "seq"]))
    pages = decode(wanted.join(slim, ["warc_file", "seq", "url"], "left_semi").select("warc_file", "seq", "url", "status", "http", "body", "detected_language")).where("html IS NOT NULL")
    return dataset.running_cap(pages, "warc_file", ["seq"], max_pages) if max_pages else pages
