"""One WARC file over many tasks: ranges of members, and members by their place.

A .warc.gz file is a chain of gzip members whose lengths stand nowhere, so where a member begins is only known once the ones before it were inflated. Here every task takes
a range of bytes, finds the first member that seems to begin there (gzip's mark, and text that begins like a record), and follows the chain to the end of its range.
Then a file's ranges, one small row each, are put together: where one range's chain ends, the next one's must begin. If they do not meet, as where a body is itself
an archive, or a member begins with something else, the range is followed again from where the chain does end. So members and their numbers are those of reading
the file from its begin, whatever the bytes look like. The second pass reads each range's members, numbered.

A broken or cut member ends its file, as in `warc.read_warc`; a file that cannot be read gives one row with rec_type "failed".
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stages, warc

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 18
RANGE = "warc_file string, k int, begin long, stop long, first long, next long, n long, ended boolean, error string"
INDEX = "warc_file string, k int, first long, n long, seq long, error string"


def open_file(uri: str):
    """A file with random access, on any store that Arrow knows."""
    from urllib.parse import unquote, urlparse

    import pyarrow.fs as fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path) if parts.scheme else uri)
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)


class Chain:
    """The members of a file one after another from a place: begin, end, and the first `keep` bytes of each, as far as they begin before `stop`.

    Afterwards `at` is where the next member would begin and `ended` tells that there is none: the file is over, or broken there.
    """

    def __init__(self, f, at: int, stop: int, keep: int) -> None:
        self.f, self.at, self.stop, self.keep, self.ended = f, at, stop, keep, False

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        self.f.seek(self.at)
        data = b""
        while self.at < self.stop:
            inflate, parts, held = zlib.decompressobj(31), [], 0
            while not inflate.eof:
                data = data or self.f.read(READ)
                if not data:
                    self.ended = True
                    return
                try:
                    out = inflate.decompress(data, 1 << 20)
                except zlib.error:
                    self.ended = True
                    return
                if held < self.keep:
                    parts.append(out[: self.keep - held])
                    held += len(parts[-1])
                data = inflate.unconsumed_tail
            data = inflate.unused_data
            begin, self.at = self.at, self.f.tell() - len(data)
            yield begin, self.at, b"".join(parts)


def _begins(f, at: int) -> bool:
    """Whether a member with a record begins there."""
    f.seek(at)
    try:
        return zlib.decompressobj(31).decompress(f.read(4096), 5) == b"WARC/"
    except zlib.error:
        return False


def first_member(f, begin: int, stop: int) -> int | None:
    """Where the first member seems to begin between two places."""
    at = begin
    while at < stop:
        f.seek(at)
        block = f.read(min(READ, stop - at) + len(MAGIC) - 1)
        found = block.find(MAGIC)
        while 0 <= found and at + found < stop:
            if _begins(f, at + found):
                return at + found
            found = block.find(MAGIC, found + 1)
        at += READ
    return None


def _followed(f, first: int | None, stop: int) -> tuple[int | None, int, int, bool]:
    """first, next, number of members and whether the file ends, of the chain from `first` on."""
    if first is None:
        return None, stop, 0, False
    chain = Chain(f, first, stop, 0)
    n = sum(1 for _ in chain)
    return first, chain.at, n, chain.ended


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for name, k, begin, stop in zip(b["warc_file"], b["k"].tolist(), b["begin"].tolist(), b["stop"].tolist(), strict=True):
            try:
                with open_file(name) as f:
                    found = _followed(f, 0 if k == 0 else first_member(f, begin, stop), stop)
                rows.append((name, k, begin, stop, *found, None))
            except (OSError, ValueError) as why:
                rows.append((name, k, begin, stop, None, stop, 0, False, f"{type(why).__name__}: {why}"))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RANGE.split(", ")]).astype({"first": "Int64"})


def _chained(part: pd.DataFrame) -> pd.DataFrame:
    """A file's ranges put together: those with members, each with the number of its first."""
    rows, at, seq = [], 0, 0
    name = part["warc_file"].iloc[0]
    failed = part["error"].dropna()
    if len(failed):
        return pd.DataFrame([(name, -1, 0, 0, -1, failed.iloc[0])], columns=[c.split()[0] for c in INDEX.split(", ")])
    for r in part.sort_values("k").itertuples():
        if at >= r.stop:  # a member reaches over the whole range
            continue
        first, after, n, ended = r.first, r.next, r.n, r.ended
        if pd.isna(first) or first != at:
            with open_file(name) as f:
                first, after, n, ended = _followed(f, at, r.stop)
        if n:
            rows.append((name, r.k, int(first), int(n), seq, None))
        seq, at = seq + int(n), int(after)
        if ended:
            break
    return pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])


def _tasks(spark: SparkSession, ranges: int, split_bytes: int, most: int) -> int:
    """One for each range of a usual size; small ones share tasks, but for a few to each core."""
    usual = ranges * split_bytes // (64 << 20)
    return max(1, min(ranges, most, max(4 * spark.sparkContext.defaultParallelism, usual)))


def member_ranges(spark: SparkSession, path: str, split_bytes: int = 64 << 20, most_tasks: int = 20_000) -> DataFrame:
    """(warc_file, k, first, n, seq): where the k-th range of each file below a path has its first member, how many begin there, and the first one's number.

    Runs one pass over the files, inflating each range once in a task of its own; the rows are written to the shared folder. Two jobs run before this returns.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("warc_file"), "length")
    cuts = files.select("warc_file", "length", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.col("length"), F.lit(1)) - 1) / split_bytes).cast("int"))).alias("k"))
    ranges = cuts.select("warc_file", "k", (F.col("k").cast("long") * split_bytes).alias("begin"), F.least((F.col("k").cast("long") + 1) * split_bytes, "length").alias("stop"))
    n = int(files.agg(F.sum(F.floor(F.col("length") / split_bytes) + 1)).first()[0] or 1)
    scanned = ranges.repartition(_tasks(spark, n, split_bytes, most_tasks)).mapInPandas(_scan, RANGE)
    return stages.cut(scanned.groupBy("warc_file").applyInPandas(_chained, INDEX), "ranges")


def read_warc(spark: SparkSession, path: str, split_bytes: int = 64 << 20, most_tasks: int = 20_000) -> DataFrame:
    """What `warc.read_warc` gives, `seq` included, and each record's member as (offset, length); a file is read by as many tasks as it has ranges."""
    index = member_ranges(spark, path, split_bytes, most_tasks)
    columns = [*warc.COLUMNS, "offset", "length"]

    def rows(r) -> Iterator[dict]:
        if r.error is not None:
            yield {c: None for c in columns} | {"warc_file": r.warc_file, "seq": -1, "rec_type": "failed", "url": r.error}
            return
        with open_file(r.warc_file) as f:
            chain = iter(Chain(f, r.first, 1 << 62, warc.BODY + (1 << 20)))
            for seq in range(r.seq, r.seq + r.n):
                begin, end, data = next(chain)
                found = warc.record(data)
                if found:
                    yield {"warc_file": r.warc_file, "seq": seq, "offset": begin, "length": end - begin} | found

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                yield from warc.framed(rows(r), columns)

    return index.repartition(_tasks(spark, index.count(), split_bytes, most_tasks)).mapInPandas(step, f"{warc.SCHEMA}, offset long, length long")


def fetch(refs: DataFrame, file: str = "warc_file", offset: str = "offset", length: str = "length") -> DataFrame:
    """refs with `http` and `body` of the member at each place: a ranged read for each row, in the order of places within a task. Other columns stay."""
    keep = [f for f in refs.schema.fields if f.name not in ("http", "body")]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, f = None, None
        for b in batches:
            out = []
            for path, at, size in zip(b[file], b[offset].tolist(), b[length].tolist(), strict=True):
                if path != name:
                    if f:
                        f.close()
                    name, f = path, open_file(path)
                f.seek(at)
                found = warc.record(next(warc.members(f, size)))
                out.append((found["http"], found["body"]) if found else (None, None))
            made = b[[x.name for x in keep]].copy()
            made["http"], made["body"] = [x[0] for x in out], [x[1] for x in out]
            yield made
        if f:
            f.close()

    ordered = refs.select(*(x.name for x in keep)).sortWithinPartitions(file, offset)
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in keep)
    return ordered.mapInPandas(step, f"{fields}, http map<string,string>, body binary")
