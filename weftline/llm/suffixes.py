"""Repeated substrings by a sparse suffix array, built with a common-prefix-aware distributed merge sort.

A byte is removed if a string of `width` bytes that covers it also starts anywhere else. Suffixes are taken at content-defined anchors: each window of
`width` bytes is anchored at its least k-gram hash, leftmost first, so equal windows have their anchors at the same place and only suffixes
at anchors of one k-gram need comparing. An anchor's windows lie in its context, up to width-k bytes before it and width behind it.

1. Every text gives its anchors' k-gram hashes. Anchors whose hash occurs once in the corpus are skipped: their windows surely occur once. That is
   all that hashes decide.
2. Each task sorts the contexts of the other anchors into runs, by the suffix from the anchor on and then by the bytes before it. Equal contexts come to stand
   side by side and leave one entry. A run is split at range bounds (first bytes of a sample of anchors; parts of a range by hash where there
   are many) and each part is front-coded: the length of the prefix shared with the run's last suffix, and the rest.
3. Each range merges its parts with a loser tree that carries common prefix lengths: of two heads the one that shares more with the last
   output is less, only equal lengths compare bytes, and from there on; the merge also yields the suffixes' common prefix array.
4. For every split of the window into d bytes before the anchor and width-d behind, entries whose common prefix reaches width-d and whose d bytes before are
   equal, byte by byte, are repeats of each other.
A range that more than `hot` entries share (a very common k-gram with many contexts) is dealt anew: windows are taken apart by ranges of d, and go by the
bytes that all windows of such a range of d have in common; if that is still too much, every window goes by all its bytes, where equal ones leave one entry
a run. The same runs and the same merge serve all three levels.

Nulls and empty texts have no bytes. Repeated rows repeat each other. Texts below `width` bytes keep all. Very long texts are
read in blocks. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WIDTH, GRAM = 200, 50
#: Into how many ranges of d windows are taken apart, level by level; 0: each d for itself.
LEVELS = (1, 8, 0)
#: Entries and bytes that a run holds at most, bounds of ranges, window starts looked at in one step.
HELD, HELD_BYTES, RANGES, BLOCK = 1 << 16, 24 << 20, 1024, 1 << 19


# ---------------------------------------------------------------- anchors

_P = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64, for i up to n."""
    kept = shared.kept()
    if len(kept.get("powers", ((),))[0]) < n:
        both = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            x = np.full(max(n, BLOCK + 4096), base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        kept["powers"] = tuple(both)
    return kept["powers"]


def _rolling(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from every place on. It picks anchors and skips: unequal bytes that share it cost time, not results."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(shared.mix(np.arange(1, 257, dtype=np.uint64))[raw] * up[: len(raw)], out=sums[1:])
    return shared.mix((sums[k:] - sums[:-k]) * down[: len(raw) - k + 1])


def _anchors(raw: np.ndarray, offsets: np.ndarray, width: int, k: int, base: int) -> tuple[np.ndarray, ...]:
    """(at, lo, hi, gram) of the windows that start in these bytes, which begin at `base` of the whole."""
    n, w = len(raw), width - k + 1
    h = _rolling(raw, k)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    # minima of all runs of w, from minima up to and from the ends of blocks of w
    x = np.concatenate([key, np.full(-len(key) % w, 0xFFFFFFFFFFFFFFFF, np.uint64)]).reshape(-1, w)
    up = np.minimum.accumulate(x, axis=1).ravel()
    down = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    least = (np.minimum(down[:windows], up[w - 1 : w - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(windows + 1, bool)  # windows that no row's end cuts
    for e in offsets[(offsets > base) & (offsets < base + n)] - base:
        inside[max(0, e - width + 1) : e] = False
    start = np.flatnonzero(inside[:windows])
    at = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    at = at[first]
    return at + base, start[first] + base, start[np.append(first[1:], len(start)) - 1][: len(first)] + base if len(start) else at, h[at]


def anchors(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH, k: int = GRAM, block: int = BLOCK) -> dict[str, np.ndarray]:
    """The rows' anchors in order: position, first and last window start, k-gram hash, row; positions within all rows' bytes."""
    none = np.zeros(0, np.int64)
    parts = [_anchors(raw[a : a + block + width - 1], offsets, width, k, a) for a in range(0, len(raw) - width + 1, block)]
    at, lo, hi, gram = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none, none.astype(np.uint64))
    if len(parts) > 1:  # an anchor whose windows start in two blocks
        goes_on = np.zeros(len(at), bool)
        goes_on[1:] = (at[1:] == at[:-1]) & (lo[1:] == hi[:-1] + 1) & ~np.isin(lo[1:], offsets)
        first = np.flatnonzero(~goes_on)
        at, lo, gram, hi = at[first], lo[first], gram[first], hi[np.append(first[1:], len(at)) - 1]
    return {"at": at, "lo": lo, "hi": hi, "gram": gram, "row": np.searchsorted(offsets, lo, "right") - 1}


def _first_bytes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from there on as a number that sorts as they do."""
    return (shared.eights(raw)[at].byteswap() ^ np.uint64(1 << 63)).view(np.int64)


def _scan(width: int, k: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offsets in shared.slices(b.column("text")):
                x = anchors(raw, offsets, width, k)
                bounds = np.searchsorted(x["row"], np.arange(hi - lo + 1)).astype(np.int32)
                some = x["gram"] % np.uint64(256) == 0  # for the ranges' bounds
                cols = [b.column(c).slice(lo, hi - lo) for c in ("doc_id", "tkey")]
                cols.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(x["gram"].view(np.int64))))
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)])[bounds].astype(np.int32)), pa.array(_first_bytes(raw, x["at"][some]))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "tkey", "g", "sample"])

    return step


# ---------------------------------------------------------------- runs


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Of sorted suffixes: the length each shares with the one before, and the rests one after another."""
    shares, rests, last = np.zeros(len(suffixes), np.uint16), [], b""
    for i, s in enumerate(suffixes):
        h = common(last, s, 0)
        shares[i] = h
        rests.append(s[h:])
        last = s
    return shares, b"".join(rests)


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix of a and b, of which h bytes are known."""
    n = min(len(a), len(b))
    step = 8
    while h < n:
        e = min(n, h + step)
        if a[h:e] == b[h:e]:
            h, step = e, step * 2
        elif step == 1 or e - h == 1:
            return h
        else:
            step = max(1, (e - h) // 2)
            n = e  # the difference lies before e
    return h


def decoded(shares: np.ndarray, sizes: np.ndarray, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """The suffixes of a run, each with the length it shares with the one before."""
    at, last = 0, b""
    for h, n in zip(shares.tolist(), sizes.tolist(), strict=True):
        last = last[:h] + rests[at : at + n - h]
        at += n - h
        yield last, h


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, suffix, common prefix with the output before) in order, by a loser tree over the runs' heads.

    share[r] is what head r shares with the last output that passed it. Heads are compared by it first, and by bytes only from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [None] * k
    share = [0] * k
    for r, run in enumerate(runs):
        heads[r], share[r] = next(run, (None, 0))[0], 0
    loser = [0] * k

    def better(a: int, b: int) -> int:
        """The lesser of two heads that were last beaten by the same output; the other's share is set against it."""
        x, y = heads[a], heads[b]
        if y is None:
            return a
        if x is None:
            return b
        p, q = share[a], share[b]
        if p != q:
            return a if p > q else b
        h = common(x, y, p)
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            share[b] = h
            return a
        share[a] = h
        return b

    win = list(range(k)) if k > 1 else [0]
    level = win
    base = k
    while len(level) > 1:
        base //= 2
        up = []
        for i in range(0, len(level), 2):
            w = better(level[i], level[i + 1])
            loser[base + i // 2] = level[i] + level[i + 1] - w
            up.append(w)
        level = up
    w = level[0]
    while heads[w] is not None:
        yield w, heads[w], share[w]
        heads[w], share[w] = next(runs[w], (None, 0))  # what it shares with its run's last suffix, which was just put out
        node = (w + k) // 2
        while node:
            v = loser[node]
            x = better(w, v)
            if x != w:
                loser[node], w = w, v
            node //= 2


#: An entry: its text and place there, the least and most bytes before the anchor, and whether it is still to be answered. Its suffix has width-lo bytes.
_META = np.dtype([("rid", "<i8"), ("at", "<i8"), ("lo", "<i2"), ("hi", "<i2"), ("asks", "?")])
RUN = "bucket long, entries int, shares binary, rests binary, befores binary, meta binary, rids array<long>, starts array<long>, ends array<long>"
_NAMES = ["bucket", "entries", "shares", "rests", "befores", "meta", "rids", "starts", "ends"]


def united(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of each text, those that touch made one."""
    if not len(rid):
        return rid, start, end
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    _, nth = np.unique(rid, return_inverse=True)
    room = int(end.max()) + 1
    far = np.maximum.accumulate(end + nth * room)
    new = np.ones(len(rid), bool)
    new[1:] = start[1:] + nth[1:] * room > far[:-1]
    first = np.flatnonzero(new)
    return rid[first], start[first], far[np.append(first[1:], len(rid)) - 1] - nth[first] * room


class _Run:
    """Contexts held by a task until they are a run."""

    def __init__(self, width: int, held: int) -> None:
        self.width, self.held, self.size = width, held, 0
        self.pairs: list[tuple[bytes, bytes]] = []  # the suffix; the bytes before, nearest first
        self.meta: list[tuple] = []
        self.buckets: list[int] = []

    def add(self, bucket: int, suffix: bytes, before: bytes, meta: tuple) -> None:
        self.pairs.append((suffix, before))
        self.meta.append(meta)
        self.buckets.append(bucket)
        self.size += len(suffix) + len(before)

    def full(self) -> bool:
        return len(self.pairs) >= self.held or self.size >= HELD_BYTES

    def out(self) -> pa.RecordBatch:
        """A front-coded part for each bucket; equal contexts leave one entry, and their occurrences are answered: all their windows are repeated."""
        pairs, width = self.pairs, self.width
        meta = np.array(self.meta, _META)
        order = np.array(sorted(range(len(pairs)), key=pairs.__getitem__), np.int64)
        buckets = np.array(self.buckets, np.int64)[order]
        deal = np.argsort(buckets, kind="stable")
        order, buckets = order[deal], buckets[deal]
        cuts = np.flatnonzero(np.diff(buckets, prepend=buckets[0] - 1))
        rows, again = [], []
        for a, e in zip(cuts, [*cuts[1:], len(order)], strict=True):
            part = order[a:e].tolist()
            head, last, suffixes = [], None, []
            for i in part:
                if pairs[i] == last:
                    again += [i, head[-1]]
                else:
                    head.append(i)
                    last = pairs[i]
                    suffixes.append(last[0])
            shares, rests = front_code(suffixes)
            rows.append((int(buckets[a]), len(head), shares.tobytes(), rests, b"".join(pairs[i][1] for i in head), head))
        again = np.unique(np.array(again, np.int64))
        found = meta[again]
        found = found[found["asks"]]
        rid, start, end = united(found["rid"], found["at"] - found["hi"], found["at"] - found["lo"] + width)
        meta["asks"][again] = False
        rows = [(*r[:5], meta[r[5]].tobytes(), None, None, None) for r in rows]
        if len(rid):
            rows.append((None,) * 6 + (rid, start, end))
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 4, *[pa.list_(pa.int64())] * 3]
        self.__init__(width, self.held)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_NAMES)


def _runs(width: int, k: int, bounds: np.ndarray, parts: int, held: int):
    """Runs of the wanted anchors' contexts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run(width, held)
        for b in batches:
            rids, wants = b.column("rid").to_numpy(), b.column("wants").to_pylist()
            for lo, hi, raw, offsets in shared.slices(b.column("text")):
                x = anchors(raw, offsets, width, k)
                first = np.searchsorted(x["row"], np.arange(hi - lo + 1))
                j = np.concatenate([first[r] + np.array(wants[lo + r], np.int64) for r in range(hi - lo)])
                at, begin, end = x["at"][j], x["lo"][j], x["hi"][j] + width
                row = x["row"][j]
                bucket = np.searchsorted(bounds, _first_bytes(raw, at), "right") * parts + (x["gram"][j] % np.uint64(parts)).astype(np.int64)
                data = raw.tobytes()
                for t, a, e, u, r, p, q, w in zip(at.tolist(), begin.tolist(), end.tolist(), bucket.tolist(), rids[lo + row].tolist(), (at - offsets[row]).tolist(), (at + width - end).tolist(), (at - begin).tolist(), strict=True):
                    run.add(u, data[t:e], data[a:t][::-1], (r, p, q, w, True))
                    if run.full():
                        yield run.out()
        if run.pairs:
            yield run.out()

    return step


def _entries(width: int, row: tuple) -> Iterator[tuple[bytes, bytes, tuple]]:
    """(suffix, bytes before, meta) of a run's part."""
    shares, rests, befores, meta = row
    meta = np.frombuffer(meta, _META)
    at = 0
    for (suffix, _), m in zip(decoded(np.frombuffer(shares, np.uint16), width - meta["lo"], rests), meta.tolist(), strict=True):
        yield suffix, befores[at : at + m[3]], m
        at += m[3]


def split_ranges(width: int, k: int, n: int) -> list[tuple[int, int]]:
    """The splits 0 to width-k in n ranges of about the same size; n=0: each for itself."""
    bounds = np.linspace(0, width - k + 1, (n or width - k + 1) + 1).astype(int)
    return [(int(a), int(b) - 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]


def _dealt(width: int, k: int, level: int, buckets: int, held: int = HELD):
    """Runs taken apart: by ranges of d, each entry by the bytes that all its windows of the range have."""
    ranges = split_ranges(width, k, LEVELS[level])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run(width, held)
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in _NAMES[2:6]), strict=True):
                for suffix, before, (rid, at, lo, hi, asks) in _entries(width, row):
                    for first, last in ranges:
                        if first > hi or last < lo:
                            continue
                        core = before[:first][::-1] + suffix[: width - last]
                        p, q = max(first, lo), min(last, hi)
                        run.add(xxhash.xxh3_64_intdigest(core, first) % buckets, suffix[: width - p], before[:q], (rid, at, p, q, asks))
                        if run.full():
                            yield run.out()
        if run.pairs:
            yield run.out()

    return step


# ---------------------------------------------------------------- merge


def repeats(share: np.ndarray, meta: np.ndarray, befores: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Which windows (entry, d) of sorted entries occur with another entry too.

    share: common prefix with the suffix before; befores: the bytes before each anchor, nearest first, padded with zeros.
    """
    n, most = befores.shape
    out = np.zeros((n, most + 1), bool)
    # the bytes before in order, and what neighbours there share: those that agree in d bytes are one class
    by = np.lexsort(befores.T[::-1]) if most else np.arange(n)
    alike = np.full(n, -1)
    if n > 1 and most:
        differs = befores[by[1:]] != befores[by[:-1]]
        alike[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), most)
    cls = np.empty(n, np.int64)
    for d in range(most + 1):
        live = np.flatnonzero((meta["lo"] <= d) & (d <= meta["hi"]))
        if len(live) < 2:
            continue
        cls[by] = np.cumsum(alike < d) if d else 0
        key = np.cumsum(share < width - d)[live] * np.int64(n + 1) + cls[live]
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        hit = np.zeros(len(s), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[live[order[hit]], d] = True
    return out


def _merged(width: int):
    def judged(runs: list[tuple]) -> pa.RecordBatch:
        metas = [np.frombuffer(r[3], _META) for r in runs]
        streams = [decoded(np.frombuffer(r[0], np.uint16), width - m["lo"], r[1]) for r, m in zip(runs, metas, strict=True)]
        out = [(r, h) for r, _, h in merge(streams)]
        which, share = np.array(out, np.int64).reshape(-1, 2).T
        base = np.cumsum([0, *(len(m) for m in metas)])
        nth = np.zeros(len(which), np.int64)
        by_run = np.argsort(which, kind="stable")
        nth[by_run] = base[which[by_run]] + np.arange(len(which)) - np.searchsorted(which[by_run], which[by_run])
        meta = np.concatenate(metas)
        most = int(meta["hi"].max())
        befores = np.zeros((len(meta), most), np.uint8)
        befores[np.arange(most) < meta["hi"][:, None]] = np.frombuffer(b"".join(r[2] for r in runs), np.uint8)
        meta, befores = meta[nth], befores[nth]
        hit = repeats(share, meta, befores, width) & meta["asks"][:, None]
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        i, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1  # d runs backwards in the text
        at = meta["at"][i]
        rid, start, end = united(meta["rid"][i], at - last, at - first + width)
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(start), pa.array(end)], names=["rid", "start", "end"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("bucket", *_NAMES[2:6])), strict=True):
                if row[0] != key and held:
                    yield judged(held)
                    held = []
                key = row[0]
                held.append(row[1:])
        if held:
            yield judged(held)

    return step


# ---------------------------------------------------------------- whole


def _cover(width: int, keep_text: bool):
    """What is left of each text without its repeated stretches."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            removed, spans, digests, texts, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64), [], [], np.zeros(n, np.int64)
            starts, ends = (b.column(c).to_pylist() for c in ("_w_starts", "_w_ends"))
            for lo, hi, raw, offsets in shared.slices(b.column("text")):
                sizes[lo:hi] = np.diff(offsets)
                for r in range(hi - lo):
                    left = raw[offsets[r] : offsets[r + 1]]
                    if starts[lo + r]:
                        edge = np.zeros(len(left) + 1, np.int32)
                        np.add.at(edge, np.array(starts[lo + r]), 1)
                        np.add.at(edge, np.array(ends[lo + r]), -1)
                        c = np.cumsum(edge)[:-1] > 0
                        removed[lo + r] = c.sum()
                        spans[lo + r] = int(c[0]) + int((c[1:] & ~c[:-1]).sum())
                        left = left[~c]
                    left = left.tobytes()
                    if keep_text:
                        texts.append(left.decode("utf-8", "ignore"))
                    else:
                        digests.append(hashlib.sha256(left).hexdigest())
            keep = [c for c in b.schema.names if c not in ("_w_starts", "_w_ends", *(["text"] if not keep_text else []))]
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in keep]
            tail = [pa.array(sizes), pa.array(removed), pa.array(spans)]
            names = [*keep, "_w_n_bytes", "_w_n_removed", "_w_n_spans"]
            if not keep_text:
                tail.append(pa.array(digests, pa.string()))
                names.append("_w_kept_sha256")
            yield pa.RecordBatch.from_arrays([*cols, *tail], names=names)

    return step


def _wanted(table: DataFrame) -> DataFrame:
    """(rid, nth) of the anchors whose k-gram hash occurs again. Very common ones, at most 5,000 by their sum, need no shuffle of their rows."""
    heads = table.select("rid", F.posexplode("g").alias("nth", "g"))
    often = shared.cut(heads.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    least = max(10_000, (often.agg(F.sum("n")).first()[0] or 0) // 5_000)
    common = [r["g"] for r in often.where(F.col("n") > least).select("g").collect()]
    rest = heads.where(~F.col("g").isin(common)).join(often.where(F.col("n") <= least), "g", "left_semi").select("rid", "nth")
    return rest.unionAll(heads.where(F.col("g").isin(common)).select("rid", "nth")) if common else rest


def _spans(runs: DataFrame) -> DataFrame:
    return runs.where("rids IS NOT NULL").select(F.explode(F.arrays_zip("rids", "starts", "ends")).alias("x")).select(F.col("x.rids").alias("rid"), F.col("x.starts").alias("start"), F.col("x.ends").alias("end"))


def _among(runs: DataFrame, buckets: DataFrame, how: str) -> DataFrame:
    few = buckets.limit(10_001).count() <= 10_000
    return runs.where("bucket IS NOT NULL").join(F.broadcast(buckets) if few else buckets, "bucket", how)


def _sorted_spans(runs: DataFrame, width: int, k: int, per_bucket: int, hot: int) -> DataFrame:
    """(rid, start, end) of what the runs and their merge find repeated; ranges that hold too much are dealt anew, level by level."""
    out = None
    for level in range(len(LEVELS)):
        found = _spans(runs)
        loads = runs.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("entries").alias("n"))
        heavy = shared.cut(loads.where(F.col("n") > hot), "heavy") if level + 1 < len(LEVELS) else None
        much = heavy.agg(F.sum("n")).first()[0] if heavy else None
        light = _among(runs, heavy.select("bucket"), "left_anti") if much else runs.where("bucket IS NOT NULL")
        total = loads.agg(F.sum("n")).first()[0] or 0
        tasks = max(1, -(-total // per_bucket))
        light = light.select("bucket", *_NAMES[2:6]).repartition(tasks, "bucket").sortWithinPartitions("bucket")
        found = found.unionAll(light.mapInArrow(_merged(width), "rid long, start long, end long"))
        out = found if out is None else out.unionAll(found)
        if not much:
            break
        spread = much * (LEVELS[level + 1] or width - k + 1) // (LEVELS[level] or 1)
        runs = shared.cut(_among(runs, heavy.select("bucket"), "left_semi").mapInArrow(_dealt(width, k, level + 1, max(1, -(-spread // per_bucket))), RUN), "runs")
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, k: int = GRAM, per_bucket: int = 20_000, hot: int = 100_000, held: int = HELD, keep_text: bool = True) -> DataFrame:
    """docs without the repeated bytes (characters that a cut would split are dropped), with _w_n_bytes, _w_n_removed, _w_n_spans; or, with
    keep_text=False, without the texts and with _w_kept_sha256 of the exact remaining bytes."""
    keyed = docs.withColumn("_w_tkey", F.xxhash64(F.coalesce("text", F.lit(""))))
    base = keyed.select("doc_id", F.col("_w_tkey").alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = base.mapInArrow(_scan(width, k), f"doc_id {kind}, tkey long, g array<long>, sample array<long>")
    table = shared.cut(scanned.where("size(g) > 0").withColumn("rid", F.monotonically_increasing_id()), "anchors")
    per = shared.cut(_wanted(table).groupBy("rid").agg(F.sort_array(F.collect_list("nth")).alias("wants")), "wanted")
    size = per.agg(F.sum(F.size("wants")).alias("n")).first()["n"] or 0
    ranges = int(min(RANGES, max(1, -(-size // per_bucket))))
    sample = table.select(F.explode("sample").alias("x"))
    share = min(1.0, 64 * RANGES / max(1, sample.count()))
    drawn = np.sort(sample.where(shared.drawn(share, "x")).toPandas()["x"].to_numpy(np.int64)) if ranges > 1 else np.zeros(0, np.int64)
    bounds = np.unique(drawn[np.linspace(0, len(drawn), ranges + 1).astype(int)[1:-1]]) if len(drawn) > ranges else np.zeros(0, np.int64)
    parts = int(max(1, -(-size // (per_bucket * (len(bounds) + 1)))))
    # rows alike in id and text share their anchors: one stands for all here, and meets all of them in the join
    wanted = per.join(table.select("rid", F.col("doc_id").alias("d"), F.col("tkey").alias("t")), "rid").groupBy("d", "t").agg(F.min(F.struct("rid", "wants")).alias("x")).select("d", "t", "x.rid", "x.wants")
    texts = base.where(F.octet_length("text") >= width).join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t"))).select("rid", "wants", "text")
    runs = shared.cut(texts.mapInArrow(_runs(width, k, bounds, parts, held), RUN), "runs")
    spans = shared.cut(_sorted_spans(runs, width, k, per_bucket, hot), "spans").groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("x"))
    found = table.select("rid", F.col("doc_id").alias("_w_d"), F.col("tkey").alias("_w_t")).join(spans, "rid").select("_w_d", "_w_t", F.col("x.start").alias("_w_starts"), F.col("x.end").alias("_w_ends"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_w_d")) & (F.col("_w_tkey") == F.col("_w_t")), "left").drop("_w_d", "_w_t", "_w_tkey")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep_text or f.name != "text")
    return joined.mapInArrow(_cover(width, keep_text), f"{fields}, _w_n_bytes long, _w_n_removed long, _w_n_spans long" + ", _w_kept_sha256 string" * (not keep_text))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs, keep_text=False)
    return found.select("doc_id", *(F.col(f"_w_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the texts without their repeated passages and n_chars to match; documents of which nothing is left go."""
    cols = docs.columns
    left = remove_repeats(docs).where((F.col("_w_n_removed") == 0) | (F.trim(F.col("text")) != ""))
    changed = F.col("_w_n_removed") > 0
    if "n_chars" in cols:
        left = left.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return shared.only(left, *cols)


def brute_force(texts: list[bytes], width: int = WIDTH) -> list[tuple[int, int, bytes]]:
    """The same by counting all windows, for tests: (removed, spans, left) of each text."""
    from collections import Counter

    count = Counter(t[s : s + width] for t in texts for s in range(len(t) - width + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for s in range(len(t) - width + 1):
            if count[t[s : s + width]] > 1:
                cover[s : s + width] = True
        edge = np.diff(np.concatenate([[0], cover.astype(int)]))
        out.append((int(cover.sum()), int((edge == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~cover].tobytes())))
    return out
