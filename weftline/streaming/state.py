"""Operators that remember rows from one micro-batch to the next: pages a host may still give, responses that wait for their metadata.

Both keep little: a host's state are the URLs it gave, at most as many as its cap; a file's state is one response. State lives in RocksDB beside the executors, with its
changes in the checkpoint folder, so it survives them and is not bound by their memory.
"""

from __future__ import annotations

import contextlib
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """While a query with these operators is started, the session's state store is RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


# ---------------------------------------------------------------- running cap


def _thinned(group: str, page: str, order: list[str], most: int):
    """Drops what the cap will drop anyway: rows behind so many pages of their group in their own partition.

    Each of those pages is, or follows, a first one of the group, so at least as many are before the row everywhere. A hot group so sends at most its cap
    from each task to the one that has its state. Rows may come in any order: what was seen later only spares less.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: dict = {}  # group -> page -> its least place
        least: dict = {}  # group -> the least places of `most` pages, in order
        for b in batches:
            keep = []
            for g, p, at in zip(b[group], b[page], zip(*(b[c] for c in order), strict=True), strict=True):
                pages, places = first.setdefault(g, {}), least.setdefault(g, [])
                had = pages.get(p)
                if had is not None and had < at or had is None and len(places) >= most and places[-1][0] < at:
                    keep.append(False)
                    continue
                keep.append(True)
                if had != at:
                    if had is not None:
                        places.remove((had, p))
                    insort(places, (at, p))
                    pages[p] = at
                    for _, gone in places[most:]:
                        del pages[gone]
                    del places[most:]
            yield b[keep]

    return step


class _Cap(StatefulProcessor):
    def __init__(self, page: str, order: list[str], most: int, ttl_ms: int | None) -> None:
        self.page, self.order, self.most, self.ttl_ms = page, order, most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getMapState("given", "page string", "place string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        place = lambda r: tuple(r[c] for c in self.order)
        given = {k[0]: v[0] for k, v in self.given.iterator()}
        for r in sorted(rows, key=place):
            page, at = r[self.page], repr(place(r))
            if page not in given:
                if len(given) >= self.most:
                    continue
                given[page] = at
                self.given.updateValue((page,), (at,))
            if given[page] == at:
                yield r

    def close(self) -> None:
        pass


def running_cap(rows: DataFrame, group: str, page: str, order: list[str], most: int, ttl_ms: int | None = None) -> DataFrame:
    """WN-4 and WN-5 on a stream: all rows of the first `most` pages of each group, each page where it came first, over all micro-batches.

    Rows arrive in `order` from one micro-batch to the next, in any order within one; all rows of a page at a place are in one. With a time to live a page is forgotten, and its
    place free again, so long after it was given, and the query needs a trigger by time: Spark gives it batches without end. Without one the result is that of `first_wins`
    and `running_cap` over all that ever came. Start the query within `state_store`.
    """
    slim = rows.mapInPandas(_thinned(group, page, order, most), rows.schema)
    return slim.groupBy(group).transformWithState(_Cap(page, order, most, ttl_ms), rows.schema, "Append", "ProcessingTime" if ttl_ms else "None")


# ---------------------------------------------------------------- metadata


class _Await(StatefulProcessor):
    """One response of a file waits; its metadata, the file's next response, the file's end or the watermark sends it on."""

    def __init__(self, schema: StructType, names: dict[str, str], time: str | None) -> None:
        self.schema, self.names, self.time = schema, names, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", self.schema)

    def _out(self, response, language) -> Row:
        return Row(*self.schema.fieldNames(), "detected_language")(*response, language)

    def _due(self, response) -> int | None:
        """The watermark, which is behind by the wait already, that sends a response on."""
        at = response[self.schema.fieldNames().index(self.time)] if self.time else None
        return None if at is None else int(at.timestamp() * 1000)

    def _settled(self) -> None:
        self.waiting.clear()
        if self.time:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, at = self.names, self.schema.fieldNames().index
        held = self.waiting.get() if self.waiting.exists() else None
        had = held is not None
        if had and self._due(held) is not None and self._due(held) <= timerValues.getCurrentWatermarkInMs():
            yield self._out(held, None)  # its time was over before these rows came
            held = None
        for r in sorted(rows, key=lambda r: r[n["seq"]]):
            kind = r[n["kind"]]
            if kind in ("response", "end"):
                if held is not None:
                    yield self._out(held, None)
                held = tuple(r) if kind == "response" else None
            elif kind == "metadata" and held is not None and r[n["url"]] is not None and r[n["url"]] == held[at(n["url"])]:
                yield self._out(held, r[n["value"]])
                held = None
        if had:
            self._settled()
        if held is not None:
            self.waiting.update(tuple(held))
            if self._due(held) is not None:
                self.handle.registerTimer(self._due(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.waiting.exists():
            yield self._out(self.waiting.get(), None)
            self._settled()

    def close(self) -> None:
        pass


def attach_metadata(records: DataFrame, *, time: str | None = None, wait_seconds: int = 600, file: str = "warc_file", seq: str = "seq", url: str = "url", kind: str = "rec_type", value: str = "lang3") -> DataFrame:
    """JN-1 on a stream: each response with `detected_language`, the value of the first metadata record of its URL before the file's next response.

    A file's records come in order of `seq` from one micro-batch to the next, cut anywhere, in any order within one. A response waits for its metadata until the file's next
    response, or until a record of kind "end" says that the file is over; so a response and its metadata may be many micro-batches apart. With a `time` column, records
    more than `wait_seconds` behind the latest are dropped, and a response that is as far behind is sent on without metadata: a file that never ends holds nothing up.
    Leave bodies out (`warc_ranges.fetch` reads them by offset): a file's micro-batch is sorted in memory. Start the query within `state_store`.
    """
    out = StructType([*records.schema.fields, StructField("detected_language", records.schema[value].dataType)])
    names = {"seq": seq, "url": url, "kind": kind, "value": value}
    came = records.withWatermark(time, f"{wait_seconds} seconds") if time else records
    return came.groupBy(file).transformWithState(_Await(records.schema, names, time), out, "Append", "EventTime" if time else "None")


def to_table(df: DataFrame, out: str, checkpoint: str):
    """Runs a query with such operators over all that is there, to parquet."""
    with state_store(df.sparkSession):
        return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ended(files: DataFrame, file: str, like: StructType, kind: str = "rec_type", seq: str = "seq") -> DataFrame:
    """A record for each file(file) that says it is over."""
    given = {file: F.col(file), kind: F.lit("end"), seq: F.lit((1 << 62))}
    return files.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.fields))
