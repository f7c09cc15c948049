"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z) and reduced to words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, one space between and around them.
A benchmark item gives a pattern for each 10 consecutive words, or one of all its words if it has fewer. Patterns of the same
length class are searched together: a table over blocks of 6 bytes tells how far the window can move; where it can't,
the hash of the window's last 8 bytes picks a bucket of patterns, and bytes are compared directly. Many windows of a text move
at once, one for each stretch of it, so that the steps are vectorised.

The patterns are made by the executors and written to the shared folder in blocks of bounded size. Texts are searched in one narrow stage: a task reads the
blocks one after another for each batch of texts and holds at most HELD of them, so memory does not grow with the benchmark.

Nulls, empty texts and texts without words have no words and no hits. Repeated documents are judged each for itself. An item
without words gives no pattern; repeated item ids count once; a null item id is the text "null". Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BLOCK = 6
TABLE = 20
TAIL = 8
SPACE = 32
#: Blocks of patterns that a worker keeps.
HELD = 4


def normal(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words with single spaces around, for all rows one after another: bytes, each row's first byte, each word's
    first byte, each row's first word. A row of words w1..wn is " w1 w2 .. wn "; a row without words is one space."""
    starts, ends, rows = shared.word_spans(raw, offsets, shared.IS_ALNUM)
    keep = shared.IS_ALNUM[raw]
    out = np.full(int(keep.sum()) + len(starts) + len(offsets) - 1, SPACE, np.uint8)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    # before word i of row r stand r+1 row heads, i trailing spaces and all word bytes so far
    size = ends - starts
    first = np.cumsum(size) - size + np.arange(len(starts)) + row_of + 1
    mapped = shared.ALNUM[raw][keep]
    out[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(mapped))] = mapped
    done = np.concatenate([[0], np.cumsum(size)])[rows]
    heads = done + rows + np.arange(len(offsets))
    return out, heads, first, rows


class WuManber:
    """A search for many byte strings. Patterns of up to `short` bytes and the longer ones are searched apart, so that
    one short pattern does not take the long ones' skips away."""

    def __init__(self, patterns: list[bytes], short: int = 16) -> None:
        self.groups = [self._group(sorted(p)) for p in ({x for x in patterns if len(x) <= short}, {x for x in patterns if len(x) > short}) if p]

    @staticmethod
    def _group(patterns: list[bytes]) -> dict:
        m = min(map(len, patterns))
        block, tail = min(BLOCK, m), min(TAIL, m)
        shift = np.full(1 << TABLE, m - block + 1, np.int32)
        heads = np.array([list(p[:m]) for p in patterns], np.uint8)
        for end in range(block, m + 1):
            np.minimum.at(shift, WuManber._block(heads, np.full(len(heads), end), block, rows=np.arange(len(heads))), m - end)
        buckets = defaultdict(list)
        for i, p in enumerate(patterns):
            buckets[p[m - tail : m]].append(i)
        keys = np.array([int.from_bytes(k, "little") for k in buckets], np.uint64)
        order = np.argsort(keys)
        lists = list(buckets.values())
        sizes = np.array([len(lists[i]) for i in order])
        members = np.array([x for i in order for x in lists[i]])
        flat = np.frombuffer(b"".join(patterns), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(p) for p in patterns])])
        return {"m": m, "block": block, "tail": tail, "shift": shift, "keys": keys[order], "first": np.cumsum(sizes) - sizes, "sizes": sizes, "members": members, "flat": flat, "at": at, "patterns": patterns}

    @staticmethod
    def _block(text: np.ndarray, end: np.ndarray, size: int, rows: np.ndarray | None = None) -> np.ndarray:
        """The shift table's entry for the block that ends before `end`."""
        out = np.zeros(len(end), np.uint64)
        for i in range(size):
            out = out * np.uint64(0x100000001B3) + (text[end - size + i] if rows is None else text[rows, end - size + i])
        return ((out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE)).astype(np.int64)

    def find(self, text: np.ndarray, lanes: int = 4096) -> tuple[list[np.ndarray], list[bytes]]:
        """Every occurrence of every pattern: arrays (start, pattern), and the patterns they index."""
        starts, which, names = [], [], []
        for g in self.groups:
            m, n = g["m"], len(text)
            if n < m:
                names += g["patterns"]
                continue
            width = max(64, -(-(n - m + 1) // lanes))
            ends = np.arange(m, n + 1, width)
            limit = np.minimum(ends + width, n + 1)
            at = ends.copy()
            hits = []
            while len(at):
                step = g["shift"][self._block(text, at, g["block"])]
                stop = step == 0
                if stop.any():
                    hits.append(at[stop])
                at = at + np.maximum(step, 1)
                live = at < limit
                at, limit = at[live], limit[live]
            if hits:
                pos = np.concatenate(hits)
                key = np.zeros(len(pos), np.uint64)
                for i in range(g["tail"]):
                    key |= text[pos - g["tail"] + i].astype(np.uint64) << np.uint64(8 * i)
                b = np.minimum(np.searchsorted(g["keys"], key), len(g["keys"]) - 1)
                ok = g["keys"][b] == key
                pos, b = pos[ok] - m, b[ok]
                # every pattern of the bucket, compared byte by byte
                times = g["sizes"][b]
                cand = g["members"][np.repeat(g["first"][b] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
                begin = np.repeat(pos, times)
                size = (g["at"][cand + 1] - g["at"][cand]).astype(np.int64)
                fits = begin + size <= n
                begin, cand, size = begin[fits], cand[fits], size[fits]
                good = np.ones(len(begin), bool)
                for i in range(int(size.max(initial=0))):
                    live = np.flatnonzero(good & (size > i))
                    if not len(live):
                        break
                    good[live] = text[begin[live] + i] == g["flat"][g["at"][cand[live]] + i]
                starts.append(begin[good])
                which.append(cand[good] + len(names))
            names += g["patterns"]
        none = np.zeros(0, np.int64)
        return [np.concatenate([none, *starts]), np.concatenate([none, *which])], names


def windows(text: bytes, size: int) -> list[bytes]:
    """An item's patterns, each with a space before and behind."""
    raw = np.frombuffer(text, np.uint8)
    out, _, _, _ = normal(raw, np.array([0, len(raw)]))
    words = out.tobytes().split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


class Finder:
    """A block's search, and the items of each pattern."""

    def __init__(self, groups: list[dict], items: list[list[str]]) -> None:
        self.search = WuManber([])
        self.search.groups, self.items = groups, items
        self.sizes = np.array([len(p) for g in groups for p in g["patterns"]], np.int64)

    def find(self, text: np.ndarray) -> list[np.ndarray]:
        return self.search.find(text)[0]


def _finder(path: str) -> Finder:
    """A block from the shared folder; the last HELD ones stay with the worker."""
    held = shared.kept().setdefault("patterns", {})
    if path not in held:
        while len(held) >= HELD:
            del held[next(iter(held))]
        held[path] = Finder(*pickle.loads(shared.read_parquet(path, ["payload"])["payload"][0].as_py()))  # noqa: S301  written by _block
    return held[path]


def _search(blocks: list[str]):
    """A mapInArrow step: the words hit and the items found, over all blocks."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, hits, items = np.zeros(n, np.int64), [None] * n, [None] * n
            for lo, hi, raw, offsets in shared.slices(batch.column("text"), shared.SLICE * (1 if len(blocks) <= HELD else 16)):  # blocks that must be read again are read less often
                text, heads, words, rows = normal(raw, offsets)
                n_words[lo:hi] = np.diff(rows)
                cover = np.zeros(len(text) + 1, np.int32)
                found: dict[int, set[str]] = {}
                for path in blocks:
                    finder = _finder(path)
                    begin, which = finder.find(text)
                    # a row's text ends with a space and the next one's begins with its own: no match crosses rows
                    row = np.searchsorted(heads, begin, "right") - 1
                    np.add.at(cover, begin + 1, 1)
                    np.add.at(cover, begin + finder.sizes[which] - 1, -1)
                    for r, k in np.unique(np.stack([row, which]), axis=1).T.tolist() if len(row) else ():
                        found.setdefault(r, set()).update(finder.items[k])
                if found:
                    hit = np.cumsum(cover)[words] > 0
                    for r, ids in found.items():
                        hits[lo + r] = np.flatnonzero(hit[rows[r] : rows[r + 1]]).astype(np.int32)
                        items[lo + r] = sorted(ids)
            cols = [*batch.columns, pa.array(n_words), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "_w_n_words", "_w_hits", "_w_items"])

    return step


def _patterns(size: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = sorted(set(windows(text.encode(), size)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found), pa.string())], names=["pattern", "item"])

    return step


def _block(t: pa.Table) -> pa.Table:
    """A block's search, made once, as one value of plain lists and arrays."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for p, i in zip(t["pattern"].to_pylist(), t["item"].to_pylist(), strict=True):
        found[p].add(i)
    groups = WuManber(list(found)).groups
    payload = pickle.dumps((groups, [sorted(found[p]) for g in groups for p in g["patterns"]]))
    return pa.table({"block": t["block"].slice(0, 1), "payload": pa.array([payload], pa.binary())})


def pattern_blocks(benchmark: DataFrame, size: int, block_bytes: int) -> list[str]:
    """Files in the shared folder, each with the patterns of about `block_bytes` of item text. Only their names come to the driver."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = int(max(1, -(-(named.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)))
    patterns = named.mapInArrow(_patterns(size), "pattern binary, item string").withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks)))
    made = shared.cut(patterns.groupBy("block").applyInArrow(_block, "block long, payload binary"), "patterns", apart="block")
    return sorted(f for f in made.inputFiles() if "block=" in f)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """docs with _w_n_words, _w_hits (indices of the words inside any occurrence) and _w_items (item ids, sorted). One narrow stage."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(_search(pattern_blocks(benchmark, size, block_bytes)), f"{fields}, _w_n_words long, _w_hits array<int>, _w_items array<string>")
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), "_w_n_words", F.coalesce("_w_hits", F.array().cast("array<int>")).alias("_w_hits"), F.coalesce("_w_items", F.array().cast("array<string>")).alias("_w_items"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        F.col("_w_n_words").alias("n_words"),
        F.size("_w_hits").cast("long").alias("n_hit"),
        F.size("_w_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_w_items").cast("binary"), 256).alias("items_sha256"),
        (F.size("_w_hits") > 0).alias("contaminated"),
    )


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a benchmark window, unchanged."""
    cols = docs.columns
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return shared.only(found.where(F.size("_w_hits") == 0), *cols)


def brute_force(texts: dict, items: dict, size: int = 10) -> dict:
    """The same by plain loops, for tests: doc_id -> (n_words, n_hit, sorted item ids)."""
    import re

    def split(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())

    pats = defaultdict(set)
    for i, t in items.items():
        w = split(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            pats[tuple(w[k : k + size])].add(str(i))
    out = {}
    for d, t in texts.items():
        w, hit, ids = split(t), set(), set()
        for p, names in pats.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    ids |= names
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
