"""JSON lines with a manifest that is their commit (SRC-9 to SRC-12, SRC-15).

    path/split=train/part-00003-<attempt>.jsonl      what a task wrote
    path/_manifest.json                              every file of the dataset with its sha256, bytes and rows, and whatever else describes it

Tasks hash their files in blocks of a MiB while they write them and report only names, digests and counts. The driver puts the manifest in place, under its name at once, when all
tasks are done: until then there is no dataset, or still the one before. Files that the manifest does not name, of attempts that were lost, belong to nobody; `read` does not see them.
`check` hashes all named files again, many tasks at once, a block at a time, so no file is ever one value and its size does not matter.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .stages import create
from .warc import open_stream
from .warc_stream import store

BLOCK = 1 << 20
MANIFEST = "_manifest.json"
#: Spark's name for the folder of nulls, and the signs that it writes as %XX in a folder's name.
NULL, UNSAFE = "__HIVE_DEFAULT_PARTITION__", re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


@dataclass
class Written(WriterCommitMessage):
    files: dict[str, dict]


class _Part:
    """A file that is hashed block by block as it is written."""

    def __init__(self, path: str) -> None:
        self.stream, self.held, self.sha, self.bytes, self.rows = create(path), bytearray(), hashlib.sha256(), 0, 0

    def add(self, lines: list[str]) -> None:
        for line in lines:
            self.held += line.encode()
            self.held += b"\n"
            while len(self.held) >= BLOCK:
                self._flush(BLOCK)
        self.rows += len(lines)

    def _flush(self, n: int) -> None:
        block = bytes(self.held[:n])
        del self.held[:n]
        self.sha.update(block)
        self.stream.write(block)
        self.bytes += len(block)

    def done(self) -> dict:
        self._flush(len(self.held))
        self.stream.close()
        return {"sha256": self.sha.hexdigest(), "bytes": self.bytes, "rows": self.rows}


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, partition_by: str, about: str, overwrite: bool) -> None:
        self.path, self.partition_by, self.about, self.overwrite = path.rstrip("/"), partition_by, about, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}.jsonl"
        parts: dict[str, _Part] = {}
        try:
            for b in iterator:
                folders = b.column("folder")
                for folder in folders.unique().to_pylist():
                    rel = f"{self.partition_by}={UNSAFE.sub(lambda c: f'%{ord(c[0]):02X}', folder)}/{name}" if self.partition_by else name
                    if rel not in parts:
                        parts[rel] = _Part(f"{self.path}/{rel}")
                    parts[rel].add(b.column("value").filter(pc.equal(folders, folder)).to_pylist())
            return Written({rel: p.done() for rel, p in parts.items()})
        except Exception:
            self._drop(parts)
            raise

    def commit(self, messages: list[Written | None]) -> None:
        before = manifest(self.path) if self.overwrite and exists(self.path) else {"files": {}}
        files = {rel: f for m in messages if m for rel, f in sorted(m.files.items())}
        where, at = store(f"{self.path}/{MANIFEST}")
        where.create_dir(at.rpartition("/")[0], recursive=True)
        with where.open_output_stream(f"{at}.writing") as f:
            f.write(json.dumps({**json.loads(self.about), "files": files}, ensure_ascii=False).encode())
        where.move(f"{at}.writing", at)
        self._drop(before["files"])

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(rel for m in messages if m for rel in m.files)

    def _drop(self, names) -> None:
        for rel in names:
            where, at = store(f"{self.path}/{rel}")
            with contextlib.suppress(OSError):
                where.delete_file(at)


class DatasetSink(DataSource):
    """Takes (folder string, value string): a line and the value that its file's folder is named after."""

    @classmethod
    def name(cls):
        return "manifested_lines"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("partition_by", ""), self.options.get("about", "{}"), overwrite)


def exists(path: str) -> bool:
    where, at = store(f"{path.rstrip('/')}/{MANIFEST}")
    return where.get_file_info(at).is_file


def manifest(path: str) -> dict:
    """A dataset's manifest; raises if there is none."""
    where, at = store(f"{path.rstrip('/')}/{MANIFEST}")
    with where.open_input_stream(at) as f:
        return json.loads(f.read())


def write(df: DataFrame, path: str, partition_by: str | None = None, about: dict | None = None) -> dict:
    """df as compact JSON lines, non-ASCII kept, keys in the columns' order, a folder for each value of a column; and the manifest, which is returned."""
    rest = df.drop(partition_by) if partition_by else df
    folder = F.coalesce(F.col(partition_by).cast("string"), F.lit(NULL)) if partition_by else F.lit("")
    lines = df.select(folder.alias("folder"), F.to_json(F.struct(*rest.columns), {"ignoreNullFields": "false"}).alias("value"))
    df.sparkSession.dataSource.register(DatasetSink)
    full = {**(about or {}), "partition_by": partition_by, "schema": json.loads(rest.schema.json())}
    lines.write.format(DatasetSink.name()).option("path", path).option("partition_by", partition_by or "").option("about", json.dumps(full, ensure_ascii=False)).mode("overwrite").save()
    return manifest(path)


def digests(files: DataFrame) -> DataFrame:
    """files(path, ...) with sha256 and bytes of each, hashed a block at a time; null where a file cannot be read."""
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for path in b["path"]:
                sha, n = hashlib.sha256(), 0
                try:
                    with open_stream(path) as f:
                        while block := f.read(BLOCK):
                            sha.update(block)
                            n += len(block)
                    found.append((sha.hexdigest(), n))
                except OSError:
                    found.append((None, None))
            out = b.copy()
            out["sha256"], out["bytes"] = [x[0] for x in found], pd.array([x[1] for x in found], "Int64")
            yield out

    return files.mapInPandas(step, ", ".join([*names, "sha256 string", "bytes long"]))


def check(spark: SparkSession, path: str) -> dict:
    """The manifest, once every file it names was found with the digest it has there; else raises with the files' names."""
    made = manifest(path)
    want = [(f"{path.rstrip('/')}/{rel}", rel, f["sha256"]) for rel, f in made["files"].items()]
    if want:
        files = spark.createDataFrame(want, "path string, file string, expected string").repartition(min(len(want), 10_000))
        bad = digests(files).where(~F.col("sha256").eqNullSafe(F.col("expected"))).select("file").orderBy("file").limit(20).collect()
        if bad:
            raise ValueError(f"files that differ from the manifest: {[r[0] for r in bad]}")
    return made


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a dataset's named files, by the manifest's schema."""
    made = manifest(path)
    schema = StructType.fromJson(made["schema"])
    by = made["partition_by"]
    wide = StructType([*schema.fields]).add(by, "string") if by else schema
    if not made["files"]:
        return spark.createDataFrame([], wide)
    return spark.read.schema(wide).option("basePath", path).json([f"{path.rstrip('/')}/{rel}" for rel in made["files"]])
