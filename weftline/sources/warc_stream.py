"""WARC files as a stream: a folder that grows, read file by file, each once.

    spark.dataSource.register(WarcStream)
    spark.readStream.format("warc_stream").option("path", folder).option("log", log).option("files_per_trigger", 8).load()

`log` is a folder of the shared store that belongs to the query, like its checkpoint: entry k lists the files that became known with offset k. An entry is written before Spark
hears of its offset and never changes, so a batch that is run again reads the same files, in whatever order a store lists them. Only names are listed.
Options `rec_type` and `status` (comma-separated) keep other records from leaving the reader; on a batch read (`warc.WarcSource`) filters on these columns are pushed down.
`end` = true adds a record of rec_type "end" after each file's last, for operators that wait for a file's end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import warc


def store(uri: str):
    """The file system of a place and the place in it."""
    import pyarrow.fs as fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return fs.FileSystem.from_uri(uri)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class WarcStreamReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        if not options.get("path") or not options.get("log"):
            raise ValueError("a WARC stream needs the options path and log")
        self.path, self.log = options["path"].rstrip("/"), options["log"].rstrip("/")
        self.most = int(options.get("files_per_trigger", 1000))
        self.wanted = warc.Wanted(options.get("rec_type"), options.get("status"))
        self.end = str(options.get("end", "false")).lower() == "true"
        self.known: set[str] | None = None
        self.entry = -1

    def _load(self) -> None:
        """What the log knows: read once, when the query starts or goes on."""
        import pyarrow.fs as fs

        where, at = store(self.log)
        where.create_dir(at, recursive=True)
        numbers = sorted(int(i.base_name) for i in where.get_file_info(fs.FileSelector(at)) if i.base_name.isdigit())
        self.known = {f for n in numbers for f in self._files(n)}
        self.entry = numbers[-1] if numbers else -1

    def _files(self, entry: int) -> list[str]:
        where, at = store(self.log)
        with where.open_input_stream(f"{at}/{entry}") as f:
            return json.loads(f.read())

    def _new(self) -> list[str]:
        import pyarrow.fs as fs

        where, at = store(self.path)
        scheme = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        found = where.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        names = sorted((i.mtime_ns or 0, i.path) for i in found if i.is_file and not i.base_name.startswith((".", "_")))
        return [name for name in (scheme + p for _, p in names) if name not in self.known][: self.most]

    def initialOffset(self) -> dict:
        return {"entry": -1}

    def latestOffset(self) -> dict:
        if self.known is None:
            self._load()
        new = self._new()
        if new:
            where, at = store(self.log)
            with where.open_output_stream(f"{at}/.{self.entry + 1}") as f:
                f.write(json.dumps(new).encode())
            where.move(f"{at}/.{self.entry + 1}", f"{at}/{self.entry + 1}")
            self.entry += 1
            self.known.update(new)
        return {"entry": self.entry}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(name) for n in range(start["entry"] + 1, end["entry"] + 1) for name in self._files(n)]

    def _records(self, path: str) -> Iterator[dict]:
        last = -1
        for r in warc.streamed(path, 10**12):
            last = max(last, r["seq"])
            if self.wanted(r):
                yield r
        if self.end:
            yield {"warc_file": path, "seq": last + 1, "rec_type": "end"}

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return warc.batched(self._records(partition.path))

    def commit(self, end: dict) -> None:
        """The log stays: it says what was read."""


class WarcStream(DataSource):
    @classmethod
    def name(cls):
        return "warc_stream"

    def schema(self):
        return warc.SCHEMA

    def streamReader(self, schema):
        return WarcStreamReader(self.options)
