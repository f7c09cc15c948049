"""N-gram Jaccard join with Bayesian candidate pruning.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased; a document's set holds its runs of five words (of all its words, if it has fewer).
Documents of equal words form a class; classes are joined, copies never are. MinHash signatures are cut into bands, and classes that share a band's
values are candidates. Buckets of equal members in several bands are kept once, large buckets are split into tiles of chunk pairs, and a pair is
judged only in the first band it shares. Within a tile signatures are compared 16 values at a time: with m of n alike, Jaccard's posterior is
Beta(m+1, n-m+1), and a pair whose posterior probability of reaching the threshold is below `tolerance` is dropped. The rest are verified on their
whole sets. A tile gives back sums and a spanning star of each linked cluster, not its pairs.

A pair at the threshold is missed by all bands with a chance of 3e-6, and above it far less; shingles are told apart by 64-bit hashes, classes by the 128-bit xxh3 of
their words' 64-bit hashes.
Nulls, empty texts and texts without words link with nothing, not even with each other. Repeated rows are copies. An empty table
gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

GRAM = 5
BANDS, ROWS = 24, 4
K = BANDS * ROWS
STEP = 16
_RNG = np.random.default_rng(20260101)
_SEED = _RNG.integers(0, 1 << 63, K, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = [np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each row's shingle hashes one after another, each row's first, the word hashes, each row's first word."""
    words, rows = shared.word_hashes(raw, offsets, shared.ALNUM, shared.IS_ALNUM)
    count = np.diff(rows)
    grams = np.where(count >= GRAM, count - GRAM + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(grams)])
    at = np.repeat(rows[:-1] - first[:-1], grams) + np.arange(first[-1])
    stop = np.repeat(rows[1:], grams)
    out = np.zeros(len(at), np.uint64)
    for i in range(GRAM):  # short rows: the words they have
        here = at + i
        ok = here < stop
        out += np.where(ok, words[np.minimum(here, len(words) - 1)] * _C[i] + _C[i], 0) if len(words) else 0
    return shared.mix(out), first, words, rows


def signatures(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (row, K) of the rows that have shingles; others get the largest value."""
    out = np.full((len(first) - 1, K), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        begin = first[:-1][some]
        for k in range(K):
            out[some, k] = np.minimum.reduceat(((x ^ _SEED[k]) * _ODD[k]) >> np.uint64(32), begin)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw, offsets in shared.slices(b.column("text")):
            x, first, words, rows = shingles(raw, offsets)
            one, two = shared.keys128(words, rows)
            sig = signatures(x, first)
            flat = pa.array(sig.view(np.int32).ravel())
            sigs = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, K, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("tkey").slice(lo, hi - lo), pa.array(np.diff(rows)), pa.array(one), pa.array(two), sigs], names=["doc_id", "tkey", "n_words", "node", "node2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, raw, offsets in shared.slices(b.column("text")):
            x, first, _, _ = shingles(raw, offsets)
            sets = [np.unique(x[i:j]).tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in ("node", "size", "sig")), pa.array(sets, pa.binary())], names=["node", "size", "sig", "grams"])


# ---------------------------------------------------------------- pairs


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each n compared: the fewest alike values at which P(J >= threshold | m of n) is not below the tolerance.

    With a flat prior that is the tail of Beta(m+1, n-m+1), the chance of at most m successes in n+1 draws at the threshold.
    """
    out = {}
    for n in range(STEP, K + 1, STEP):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out[n] = m
    return out


def surviving(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs (left, right) outlive the incremental comparison."""
    alive, alike = np.arange(len(left)), np.zeros(len(left), np.int32)
    for n, m in least.items():
        part = slice(n - STEP, n)
        alike = alike + (sig[left[alive], part] == sig[right[alive], part]).sum(axis=1)
        ok = alike >= m
        alive, alike = alive[ok], alike[ok]
        if not len(alive):
            break
    return alive


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections."""
    if len(left) <= 32:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    size = np.array([len(s) for s in sets])
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(len(sets)), size)
    many = count[back] > 1
    ids = np.full(len(count), -1)
    ids[count > 1] = np.arange(int((count > 1).sum()))
    who, what = who[many], ids[back[many]]
    total = np.zeros(len(left), np.int64)
    every = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int((count > 1).sum()), 4096):
        part = (what >= lo) & (what < lo + 4096)
        has = np.zeros((len(sets), 4096), np.float32)
        has[who[part], what[part] - lo] = 1
        every += has @ has.T
    total += every[left, right].astype(np.int64)
    return total


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index each index is linked with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def judge_tile(node: np.ndarray, chunk: np.ndarray, size: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], band: int, two_sided: bool, threshold: float, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, root index, sum of the partners' sizes) of the members that have links within the tile."""
    n = len(node)
    bands = sig.reshape(n, BANDS, ROWS)
    lefts, rights = [], []
    block = max(1, (1 << 18) // n)
    for lo in range(0, n, block):
        i, j = np.meshgrid(np.arange(lo, min(n, lo + block)), np.arange(n), indexing="ij")
        i, j = i.ravel(), j.ravel()
        ok = (chunk[i] < chunk[j]) if two_sided else (i < j)
        i, j = i[ok], j[ok]
        for k in range(band):  # judged in an earlier band's bucket
            ok = (bands[i, k] != bands[j, k]).any(axis=1)
            i, j = i[ok], j[ok]
        alive = surviving(sig, i, j, least)
        lefts.append(i[alive])
        rights.append(j[alive])
    left, right = np.concatenate(lefts), np.concatenate(rights)
    if not len(left):
        return left, left, left
    count = np.array([len(s) for s in sets])
    both = _overlaps(sets, left, right)
    ok = both >= threshold * (count[left] + count[right] - both) - 1e-9
    left, right = left[ok], right[ok]
    add = np.bincount(left, size[right], n) + np.bincount(right, size[left], n)
    root = _roots(n, left, right)
    linked = np.flatnonzero(add)
    return linked, root[linked], add[linked].astype(np.int64)


def _tiles(threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)

    def judged(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        node = t["node"].to_numpy()
        _, keep = np.unique(node, return_index=True)  # a repeated row's text comes twice
        t = t.take(pa.array(keep))
        node, size, chunk = t["node"].to_numpy(), t["size"].to_numpy(), t["chunk"].to_numpy()
        sig = np.stack([np.asarray(x, np.int32) for x in t["sig"].to_numpy()]).view(np.uint32)
        sets = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
        i, root, add = judge_tile(node, chunk, size, sig, sets, t["band"][0].as_py(), t["ti"][0].as_py() != t["tj"][0].as_py(), threshold, least)
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[root]), pa.array(add)], names=["node", "other", "add"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("bh", "ti", "tj")]
            new = np.ones(b.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            starts = np.flatnonzero(new)
            for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
                this = tuple(int(c[s]) for c in cols)
                if this != key and held:
                    yield judged(held)
                    held = []
                key = this
                held.append(b.slice(s, e - s))
        if held:
            yield judged(held)

    return step


def similar(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, tile: int = 1024) -> DataFrame:
    """(doc_id, tkey, class_id, group_id, n_links, kept) of every row of docs (doc_id, text).

    class_id is the smallest doc_id of the same words, group_id the smallest that links lead to, n_links the number of other documents linked
    directly, copies included. kept: the row stands for its group; of repeated rows all do.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = shared.cut(base.mapInArrow(_sign, f"doc_id {kind}, tkey long, n_words long, node long, node2 long, sig array<int>"), "signed")
    worded = signed.where("n_words > 0")
    classes = shared.cut(worded.groupBy("node", "node2").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "tkey")).alias("first"), F.first("sig").alias("sig")), "classes")
    parts = [F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), *(F.col("sig")[ROWS * i + j] for j in range(ROWS))).alias("bh")) for i in range(BANDS)]
    banded = classes.select("node", F.explode(F.array(*parts)).alias("b")).select("node", "b.band", "b.bh")
    full = banded.groupBy("bh").agg(F.count(F.lit(1)).alias("m"), F.min("band").alias("band"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("m > 1")
    buckets = full.groupBy("members", "m").agg(F.min(F.struct("band", "bh")).alias("b")).select("m", "b.band", "b.bh")
    members = shared.cut(banded.select("node", "bh").join(buckets, "bh"), "members")
    # the candidates' sets, from their texts
    wanted = members.select("node").distinct().join(classes, "node").select("node", "size", "sig", F.col("first.doc_id").alias("d"), F.col("first.tkey").alias("k"))
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k"))).select("node", "size", "sig", "text")
    loaded = texts.mapInArrow(_sets, "node long, size long, sig array<int>, grams binary")
    n = F.ceil(F.col("m") / tile).cast("int")
    dealt = members.withColumn("chunk", F.pmod(F.xxhash64("node", "bh"), n).cast("int")).select("bh", "band", "node", "chunk", F.explode(F.sequence(F.lit(0), n - 1)).alias("j"))
    tiles = dealt.select("bh", "band", "node", "chunk", F.least("chunk", "j").alias("ti"), F.greatest("chunk", "j").alias("tj"))
    rows = tiles.join(loaded, "node").repartition("bh", "ti", "tj").sortWithinPartitions("bh", "ti", "tj")
    links = shared.cut(rows.select("bh", "band", "node", "chunk", "ti", "tj", "size", "sig", "grams").mapInArrow(_tiles(threshold, tolerance), "node long, other long, add long"), "links")
    roots = components(links)
    sums = links.groupBy("node").agg(F.sum("add").alias("add"))
    named = classes.select("node", "node2", "size", F.col("first.doc_id").alias("class_id"), "first").join(sums, "node", "left").join(roots, "node", "left")
    named = named.select("node", "node2", "class_id", "first", (F.col("size") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), F.coalesce("root", F.col("node")).alias("root"))
    named = shared.cut(named, "named")
    firsts = named.groupBy("root").agg(F.min("first").alias("head"))
    decided = named.join(firsts, "root").select(F.col("node").alias("_a"), F.col("node2").alias("_b"), "class_id", "n_links", "head")
    out = signed.drop("sig").join(decided, (F.col("node") == F.col("_a")) & (F.col("node2") == F.col("_b")), "left")
    alone = F.col("_a").isNull() | (F.col("n_words") == 0)
    return out.select(
        "doc_id",
        "tkey",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tkey") == F.col("head.tkey")))).alias("kept"),
        alone.alias("alone"),
    )


def components(links: DataFrame) -> DataFrame:
    return shared.components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "group_id", "kept")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near copies, unchanged; documents without words all stay."""
    cols = docs.columns
    found = shared.cut(similar(docs).where("kept"), "kept")
    # repeated rows of a kept document are alike in id and text: one of them stays, but all of those without words
    kept = found.where("NOT alone").select(F.col("doc_id").alias("_w_d"), F.col("tkey").alias("_w_k")).distinct()
    empty = found.where("alone").select(F.col("doc_id").alias("_w_d"), F.col("tkey").alias("_w_k")).distinct()
    keyed = docs.withColumn("_w_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").eqNullSafe(F.col("_w_d")) & (F.col("_w_key") == F.col("_w_k"))
    one = keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_w_key"])
    return one.unionByName(keyed.join(empty, same, "left_semi")).transform(lambda d: shared.only(d, *cols))


def brute_force(texts: list[tuple], threshold: float = 0.8) -> list[tuple]:
    """The same by plain loops, for tests: (doc_id, class_id, n_links, group_id) for rows with distinct ids."""
    import re

    words = {d: tuple(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())) for d, t in texts}
    sets = {d: {w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))} if w else set() for d, w in words.items()}
    ids = sorted(words)
    links = {d: [e for e in ids if e != d and sets[d] and sets[e] and len(sets[d] & sets[e]) >= threshold * len(sets[d] | sets[e]) - 1e-9] for d in ids}
    out = []
    for d in ids:
        seen, todo = {d}, [d]
        while todo:
            for e in links[todo.pop()]:
                if e not in seen:
                    seen.add(e)
                    todo.append(e)
        out.append((d, min(e for e in ids if e == d or (words[d] and words[e] == words[d])), len(links[d]), min(seen)))
    return out
