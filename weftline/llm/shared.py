"""Helpers the corpus operators share: vectorised words, gapless ranks, components."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import cut

#: Bytes of text that one vectorised step works on. It takes about 20 bytes of arrays for each byte; a longer text is a step of its own.
SLICE = 1 << 19


def in_remainder(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text 'null'."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % modulus == remainder


#: Steps of a draw: fine enough for a sample of a few rows out of 10**11.
DRAW = 1 << 40


def drawn(share: float, *keys: str | Column) -> Column:
    """A draw of about that share of rows by a hash of the keys; all rows at 1."""
    return F.pmod(F.xxhash64(*keys), F.lit(DRAW).cast("long")) < F.lit(int(share * DRAW)).cast("long")


def read_parquet(uri: str, columns: list[str]) -> pa.Table:
    """A file of the shared folder, read by a worker itself through Arrow's file systems."""
    from urllib.parse import unquote, urlparse

    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    where, path = (fs.LocalFileSystem(), unquote(urlparse(uri).path)) if urlparse(uri).scheme in ("", "file") else fs.FileSystem.from_uri(uri)
    with where.open_input_file(path) as f:
        return pq.ParquetFile(f).read(columns)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact name: extra or clashing ones do no harm."""
    return df.select(*(F.col(f"`{n}`") for n in names))


# ---------------------------------------------------------------- bytes and words


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and the row offsets (nulls: empty), without a copy where Arrow allows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows of about `most` bytes; a longer row is a run of its own."""
    raw, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def _alnum_table() -> np.ndarray:
    """Each byte's lower-cased word byte, or 0 where it separates words: words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z went to a-z."""
    t = np.zeros(256, np.uint8)
    t[48:58] = np.arange(48, 58)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def _space_table() -> np.ndarray:
    """As above for words [^\\x20\\x09-\\x0D]+; byte 0 is a word byte, told apart by SPACES."""
    t = np.arange(256).astype(np.uint8)
    t[65:91] = np.arange(97, 123)
    return t


ALNUM, LOWER = _alnum_table(), _space_table()
IS_ALNUM = ALNUM != 0
IS_DARK = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each row's first word (one entry more than rows). Words never cross rows."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = inside[raw]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = w[cuts]
    last[cuts - 1] = w[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def kept() -> dict:
    """What a process keeps from task to task. It is no global of this package, which would travel with every function sent to the workers."""
    return sys.modules.setdefault("_weftline_kept", types.ModuleType("_weftline_kept")).__dict__


#: Spans of more bytes are hashed one by one.
LONG = 256


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros behind the end; to be indexed, not computed with as a whole."""
    return _eights(np.concatenate([raw, np.zeros(8, np.uint8)]))


def _eights(padded: np.ndarray) -> np.ndarray:
    return np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))


def low_bytes(n: np.ndarray) -> np.ndarray:
    """A mask of the first n bytes, at most all eight, of such a number."""
    return np.where(n >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(n, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, equal for equal bytes wherever they stand.

    Eight bytes at a time go through a bijective finaliser, so spans of up to eight bytes and one length never share a hash, and no arrangement of
    the bytes is algebraically alike another; spans above LONG go through xxh3.
    """
    raw = np.ascontiguousarray(raw).view(np.uint8)
    size = ends - starts
    h = mix(size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1))
    if not len(size):
        return h
    at = eights(raw)
    h = mix(h ^ (at[starts] & low_bytes(size)))
    live = np.flatnonzero((size > 8) & (size <= LONG))
    done = 8
    while len(live):
        rest = size[live] - done
        h[live] = mix(h[live] ^ (at[starts[live] + done] & low_bytes(rest)))
        done += 8
        live = live[rest > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].data)
    return h


def same_spans(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether each span of raw is, byte by byte, the span of the same size that begins there in other, which has eight bytes to spare."""
    same = np.ones(len(starts), bool)
    if not len(starts):
        return same
    one, two = eights(raw), _eights(other)
    live, done = np.flatnonzero(sizes > 0), 0
    while len(live):
        rest = sizes[live] - done
        alike = ((one[starts[live] + done] ^ two[begins[live] + done]) & low_bytes(rest)) == 0
        same[live[~alike]] = False
        live = live[alike & (rest > 8)]
        done += 8
    return same


def keys128(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of the 128-bit xxh3 of each row's values."""
    flat = np.ascontiguousarray(values).view(np.uint8).data
    step = values.dtype.itemsize
    digests = b"".join(xxhash.xxh3_128_digest(flat[a * step : b * step]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True))
    both = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's 64-bit hash after `table` mapped its bytes, and each row's first word."""
    s, e, rows = word_spans(raw, offsets, inside)
    return span_hash(table[raw], s, e), rows


# ---------------------------------------------------------------- ranks


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_bucket: int = 50_000, buckets: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gaps, and without bringing a key's rows into one task.

    Each key is dealt into buckets by a hash of the order columns; rows are numbered in their bucket, and
    the buckets' counts, a table that is smaller than the input by `rows_per_bucket`, give the first number of each.
    `buckets` says how many a row's key gets, where that is known; else every key gets as many as all rows need.
    `bucket` is a row's bucket itself; where it grows with `order`, so do the numbers. df must be cheap to read twice. `order` should tell rows apart; rows alike in it are numbered arbitrarily.
    """
    if buckets is None and bucket is None:
        buckets = F.lit(max(1, -(-df.count() // rows_per_bucket)))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), buckets) if bucket is None else bucket)
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    on = [ranked[k].eqNullSafe(bases[f"_k{i}"]) for i, k in enumerate(keys)] + [ranked["_bucket"] == bases["_b"]]
    joined = ranked.join(bases, on, "inner")
    return joined.withColumn(out, (F.col("_at") + F.col("_base")).cast("long")).drop("_bucket", "_at", "_b", "_base", *(f"_k{i}" for i in range(len(keys))))


# ---------------------------------------------------------------- components


def join_least(edges: DataFrame, low: DataFrame, common: int = 100_000) -> DataFrame:
    """edges (u, v) with the m of their u from low (u, m, n). Nodes with very many edges, at most 2,000 by their sum, are looked up in a map
    that every task has; so a hub's edges stay spread."""
    total = low.agg(F.sum("n"), F.max("n")).first()
    if (total[1] or 0) <= common:
        return edges.join(low.select("u", "m"), "u")
    hubs = low.where(F.col("n") > max(common, total[0] // 2_000)).select("u", "m").collect()
    if not hubs:
        return edges.join(low.select("u", "m"), "u")
    is_hub = F.col("u").isin([r["u"] for r in hubs])
    held = F.create_map(*(F.lit(x) for r in hubs for x in (r["u"], r["m"])))
    return edges.where(~is_hub).join(low.where(~is_hub).select("u", "m"), "u").unionAll(edges.where(is_hub).select("u", "v", F.try_element_at(held, F.col("u")).alias("m")))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node that each node of the undirected edges (a, b) reaches.

    Alternates large-star and small-star steps, which keep the edge count linear and need O(log^2 n) rounds. Edges of a hub meet its least neighbour without
    a shuffle (`join_least`). Every round is cut to the shared folder. Nodes without edges are not returned.
    """
    e = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_least(both, low).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_least(down, least)
        small = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        new = cut(small, "edges")
        # settled: every edge goes from a node to a root, and no root is itself below another
        changed = new.select("a").intersect(new.select("b")).limit(1).count() or new.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        e = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
