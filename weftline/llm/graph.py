"""Embedding near-duplicates over a robust-pruned flat graph.

Equal vectors form a class; classes are indexed. Centroids are fitted on a bounded sample, every class joins the shards of its nearest ones (so
shards overlap). A shard that would exceed `limit` members gets centroids of its own, fitted on a sample of it by one task each, and its members
join the shards of their nearest ones there; what still exceeds it, as near copies in great number do, is dealt into sub-shards. In each a graph is built: a member's
candidates are its nearest members and some of every ring of falling similarity, robust pruning keeps those that no kept nearer one makes needless, and edges go
both ways. The adjacency lists of a class from all its shards are united. Then every class is searched in its shards: a greedy beam from
the shard's medoids, and once it is within range, an expansion over neighbours that are within range (less a slack) until none is new. Found pairs are
verified in double precision. A shard gives back a spanning star of each linked cluster, the pairs of vectors with few links, each counted once whichever shard finds it, and for vectors with many links sums in
place of pairs: such a pair counts in the first shard that both are in (between sub-shards: in the later one). It joins their components in whichever finds it. At last recall is audited: a bounded sample of vectors is compared with all
others by brute force, and with too low a recall the index is built anew with more overlap; if the most overlap fails too, an error is raised.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths don't link. Repeated rows are
vectors of their own. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Nearest candidates, candidates of each ring beyond; edges to near ones, to far ones, and with edges back; the pruning's slack.
NEAR, FAR, CLOSE, WIDE, DEGREE, ALPHA = 32, 6, 20, 14, 48, 1.2
BEAM, ENTRIES, SLACK = 12, 16, 0.03
#: Links in one shard up to which a vector's pairs are kept as pairs, and the kinds of rows a shard gives back: a cluster's star with sums, a pair that counts in the shard, one that counts in an
#: earlier shard of both, a vector with more links than that.
FEW = 64
STAR, PAIR, LATE, DENSE = range(4)


def _unit(x: np.ndarray) -> np.ndarray:
    # the scale first, so that squares neither overflow nor vanish
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5, apart: float | None = None) -> np.ndarray:
    """Spherical k-means: unit centroids, the largest clusters' first. apart: of centroids that similar one stays, so that a dense group of near
    copies, which draws many, is one shard and not torn."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    near = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    c = c[np.argsort(-np.bincount(near, minlength=len(c)), kind="stable")]
    if apart is None:
        return c
    alike, free = c @ c.T >= apart, np.ones(len(c), bool)
    for i in range(len(c)):
        if free[i]:
            free[i + 1 :] &= ~alike[i, i + 1 :]
    return c[free]


# ---------------------------------------------------------------- graph of a shard


def robust_prune(x: np.ndarray, base: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours (row, degree; -1: none) of the members `base` out of their candidates (-1: none), nearest first; one is left out
    if a kept one is nearer to it, times alpha, than the member is."""
    ok = (cand >= 0) & (cand != base[:, None])
    ok &= np.concatenate([np.ones((len(cand), 1), bool), np.diff(np.sort(cand, axis=1), axis=1) != 0], axis=1)[np.arange(len(cand))[:, None], np.argsort(np.argsort(cand, axis=1, kind="stable"), axis=1)]
    y = x[np.maximum(cand, 0)]
    d = 1 - np.einsum("bcd,bd->bc", y, x[base])
    between = 1 - y @ y.transpose(0, 2, 1)
    out = np.full((len(base), degree), -1)
    row = np.arange(len(base))
    d = np.where(ok, d, np.inf)
    for t in range(degree):
        i = d.argmin(axis=1)
        live = np.isfinite(d[row, i])
        if not live.any():
            break
        out[live, t] = cand[row, i][live]
        away = alpha * between[row, i] <= d + 1e-12
        away[row, i] = True
        d[away & live[:, None]] = np.inf
    return out


def build(x: np.ndarray, seed: int = 3, block: int = 256) -> np.ndarray:
    """The shard's graph: member, up to DEGREE neighbours (-1: none)."""
    n = len(x)
    rng = np.random.default_rng(seed)
    if n < 2:
        return np.full((n, DEGREE), -1)
    near = min(NEAR, n - 1)
    rings = [near]
    while rings[-1] * 2 < n:
        rings.append(rings[-1] * 2)
    first = np.full((n, CLOSE + WIDE), -1)
    for lo in range(0, n, block):
        base = np.arange(lo, min(n, lo + block))
        s = x[base] @ x.T
        s[np.arange(len(base)), base] = -np.inf
        by = np.argpartition(-s, [r - 1 for r in rings], axis=1)
        # some of every ring of falling similarity: without them two groups of copies side by side would not meet
        far = np.concatenate([by[:, a + rng.integers(0, e - a, FAR)] for a, e in zip(rings, [*rings[1:], n], strict=True)], axis=1)
        first[base, :CLOSE] = robust_prune(x, base, by[:, :near], CLOSE)
        first[base, CLOSE:] = robust_prune(x, base, far, WIDE)
    # edges back, pruned where they are too many
    src, at = np.nonzero(first >= 0)
    dst = first[src, at]
    order = np.lexsort((rng.random(len(dst)), dst))
    dst, src = dst[order], src[order]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
    keep = rank < 2 * DEGREE
    back = np.full((n, 2 * DEGREE), -1)
    back[dst[keep], rank[keep]] = src[keep]
    extra = np.full((n, DEGREE - CLOSE - WIDE), -1)
    for lo in range(0, n, block):
        base = np.arange(lo, min(n, lo + block))
        extra[base] = robust_prune(x, base, back[base], extra.shape[1])
    return np.concatenate([first, extra], axis=1)


def medoids(x: np.ndarray, k: int = ENTRIES) -> np.ndarray:
    """The members nearest to the centroids of the shard."""
    c = kmeans(x, min(k, len(x)), 4)
    return np.unique((c @ x.T).argmax(axis=1))


def search(x: np.ndarray, adj: np.ndarray, entries: np.ndarray, q: np.ndarray, threshold: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) of the members found within range: greedy beam, then range expansion. Candidates only; the caller verifies.

    own: the queries' places as members (-1: none). Where the beam did not come to a query's own place, expansion starts there as well.
    """
    n, m = len(q), len(x)
    row = np.arange(n)[:, None]
    beam = np.broadcast_to(entries, (n, len(entries)))
    sim = q @ x[entries].T
    done = np.zeros(beam.shape, bool)
    for _ in range(200):
        width = min(BEAM, beam.shape[1])
        top = np.argpartition(-sim, width - 1, axis=1)[:, :width]
        beam, sim, done = beam[row, top], sim[row, top], done[row, top]
        best = np.where(done, -np.inf, sim).argmax(axis=1)
        live = ~done[np.arange(n), best]
        if not live.any():
            break
        node = beam[np.arange(n), best]
        done[np.arange(n), best] = True
        new = np.where(live[:, None], adj[node], -1)
        # not what the beam holds
        known = (new[:, :, None] == beam[:, None, :]).any(axis=2) | (new < 0)
        s = np.where(known, -np.inf, np.einsum("qad,qd->qa", x[np.maximum(new, 0)], q))
        beam, sim, done = np.concatenate([beam, new], axis=1), np.concatenate([sim, s], axis=1), np.concatenate([done, known], axis=1)
    within = threshold - SLACK
    i, j = np.nonzero(sim >= within)
    key = i * m + beam[i, j]
    if own is not None:
        key = np.concatenate([key, (np.arange(n) * m + own)[own >= 0]])
    key = np.unique(key)
    seen, fresh = key, key
    while len(fresh):
        keys = []
        for lo in range(0, len(fresh), 1 << 16):  # a dense group's frontier is large
            i, node = fresh[lo : lo + (1 << 16)] // m, fresh[lo : lo + (1 << 16)] % m
            new = adj[node]
            i = np.repeat(i, new.shape[1])[(new >= 0).ravel()]
            keys.append(np.unique(i * m + new[new >= 0]))
        key = np.setdiff1d(np.unique(np.concatenate(keys)), seen, assume_unique=True)
        if not len(key):
            break
        hit = np.empty(len(key), bool)
        for lo in range(0, len(key), 1 << 16):
            part = key[lo : lo + (1 << 16)]
            hit[lo : lo + len(part)] = np.einsum("ij,ij->i", q[part // m], x[part % m]) >= within
        fresh = key[hit]
        seen = np.union1d(seen, fresh)
    return seen // m, seen % m


# ---------------------------------------------------------------- shards


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from sorted batches."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in keys]
        new = np.ones(b.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        starts = np.flatnonzero(new)
        for s, e in zip(starts, [*starts[1:], b.num_rows], strict=True):
            this = tuple(int(c[s]) for c in cols)
            if this != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = this
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _vectors(t: pa.Table) -> np.ndarray:
    flat = t["emb"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return _unit(flat.reshape(t.num_rows, -1))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _grouped(batches, ("dim", "shard", "sub")):
        x = _vectors(t).astype(np.float32)
        adj = build(x)
        node = t["node"].to_numpy()
        size = (adj >= 0).sum(axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(node[adj[adj >= 0]]))
        yield pa.RecordBatch.from_arrays([pa.array(node), lists], names=["node", "adj"])


def _even(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of shards as rows of one length, filled up with their first."""
    flat = lists.combine_chunks()
    at = flat.offsets.to_numpy()
    at, values, size = at - at[0], flat.flatten().to_numpy(), np.diff(at)
    out = np.repeat(values[at[:-1]][:, None], size.max(), axis=1)
    out[np.arange(size.max()) < size[:, None]] = values
    return out


def _search(threshold: float):
    def judged(t: pa.Table) -> pa.RecordBatch:
        node, size, role = t["node"].to_numpy(), t["size"].to_numpy(), t["role"].to_numpy()
        exact = _vectors(t)
        shards = _even(t["shards"])
        here = t["shard"][0].as_py()
        member = np.flatnonzero(role == 0)
        out = (*(np.zeros(0, np.int64),) * 2, np.zeros(0, bool))
        if len(member):
            x = exact[member].astype(np.float32)
            place = {v: i for i, v in enumerate(node[member].tolist())}
            lists = [[place[v] for v in a if v in place] for a in t["adj"].take(pa.array(member)).to_pylist()]
            adj = np.full((len(member), max(1, max(map(len, lists)))), -1)
            for i, a in enumerate(lists):
                adj[i, : len(a)] = a
            entries = medoids(x)
            own = np.full(len(node), -1)
            own[member] = np.arange(len(member))
            found = []
            for lo in range(0, len(node), 512):
                part = np.arange(lo, min(len(node), lo + 512))
                i, j = search(x, adj, entries, exact[part].astype(np.float32), threshold, own[part])
                i, j = part[i], member[j]
                # links count in the first shard that both are in; each pair once. Components take a pair from any shard
                both = (shards[i][:, :, None] == shards[j][:, None, :]).any(axis=2)
                first = np.where(both, shards[i], np.iinfo(np.int32).max).min(axis=1)
                first, i, j = first[i != j] == here, i[i != j], j[i != j]
                ok = np.concatenate([np.einsum("ij,ij->i", exact[i[a : a + 65536]], exact[j[a : a + 65536]]) >= threshold for a in range(0, len(i), 65536)] or [np.zeros(0, bool)])
                first, i, j = first[ok], i[ok], j[ok]
                low, high = np.minimum(i, j), np.maximum(i, j)
                found.append((low * len(node) + high) * 2 + first)
            pairs = np.unique(np.concatenate(found))
            out = pairs // 2 // len(node), pairs // 2 % len(node), pairs % 2 == 1
        left, right, first = out
        root = _roots(len(node), left, right)
        linked = np.unique(np.concatenate([left, right]))
        # a vector with few links here gives its pairs; one with many gives sums, of the pairs that count here
        many = np.bincount(np.concatenate([left, right]), minlength=len(node)) > FEW
        summed = many[left] | many[right]
        a, b = left[summed & first], right[summed & first]
        add = np.bincount(a, size[b], len(node)) + np.bincount(b, size[a], len(node)) if len(a) else np.zeros(len(node))
        u, v, own = left[~summed], right[~summed], first[~summed]
        both = (shards[u][:, :, None] == shards[v][:, None, :]).any(axis=2)
        counts_in = np.where(own, here, np.where(both, shards[u], np.iinfo(np.int32).max).min(axis=1)) if len(u) else np.zeros(0, np.int64)
        dense = np.flatnonzero(many)
        parts = (
            (STAR, node[linked], node[root[linked]], add[linked], np.zeros(len(linked)), np.zeros(len(linked))),
            (None, node[u], node[v], size[v], size[u], counts_in),
            (DENSE, node[dense], node[dense], np.zeros(len(dense)), np.zeros(len(dense)), np.full(len(dense), here)),
        )
        kinds = [np.full(len(p[1]), p[0]) if p[0] is not None else np.where(own, PAIR, LATE) for p in parts]
        cols = [np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(1, 6)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds).astype(np.int32)), *map(pa.array, cols)], names=["kind", "node", "other", "add", "back", "shard"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ("dim", "shard", "sub")):
            yield judged(t)

    return step


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[left], root[right])
        for at in (left, right, root[left], root[right]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _assign(centroids: dict[int, np.ndarray], overlap: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            out = np.zeros((b.num_rows, overlap), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _unit(b.column("emb").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                c = centroids.get(int(dim))
                k = min(overlap, 0 if c is None else len(c))
                if k:
                    near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :k].astype(np.int32)
                    out[at] = np.concatenate([near, np.repeat(near[:, :1], overlap - k, axis=1)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, overlap, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "shards"])

    return step


#: Room for the shards that one of the first level is split into.
FINE = 4096


def _fit(members: int, most: int, apart: float):
    """A sample of a shard to its own centroids."""

    def step(t: pa.Table) -> pa.Table:
        x = _vectors(t.sort_by("node"))
        k = int(min(most, len(x), max(2, -(-t["total"][0].as_py() // members))))
        return pa.table({"dim": t["dim"].slice(0, 1), "coarse": t["coarse"].slice(0, 1), "centroids": pa.array([kmeans(x, k, apart=apart).astype("<f4").tobytes()], pa.binary())})

    return step


def _assign_fine(overlap: int):
    """Members of large shards to the nearest centroids of their own; a group's first row holds them."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, key = None, None
        for b in batches:
            nodes, near = [], []
            for t in _grouped(iter([b]), ("dim", "coarse", "salt")):
                this = tuple(t[k][0].as_py() for k in ("dim", "coarse", "salt"))
                if this != key:  # a new group, or one that goes on from the last batch
                    key, c = this, np.frombuffer(t["centroids"][0].as_py(), "<f4").reshape(-1, this[0]).astype(float)
                    t = t.slice(1)
                if not t.num_rows:
                    continue
                x, k = _vectors(t), min(overlap, len(c))
                for i in range(0, len(x), 4096):
                    near.append(this[1] * FINE + 1 + np.argsort(-(x[i : i + 4096] @ c.T), axis=1, kind="stable")[:, :k].astype(np.int32))
                nodes.append(t["node"].to_numpy())
            if nodes:
                size = np.repeat([x.shape[1] for x in near], [len(x) for x in near])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate([x.ravel() for x in near])))], names=["node", "fine"])

    return step


def _refined(placed: DataFrame, overlap: int, members: int, limit: int, most: int, apart: float) -> DataFrame:
    """placed with shards numbered with room for those that large ones are split into, and large ones split."""
    each = placed.select("node", "dim", "emb", F.explode(F.array_distinct("shards")).alias("coarse"))
    loads = {(r["dim"], r["coarse"]): r["n"] for r in each.groupBy("dim", "coarse").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).collect()}  # at most a row for each centroid
    whole = F.transform(F.array_distinct("shards"), lambda x: (x * FINE).cast("int"))
    if not loads:
        return placed.withColumn("shards", whole)
    spark = placed.sparkSession
    facts = [(d, c, n, min(1.0, 16_384 / n, 8.0 * max(2, n // members) / n), -(-n // 200_000)) for (d, c), n in loads.items()]
    large = F.broadcast(spark.createDataFrame(facts, "dim int, coarse int, total long, share double, salts int"))
    inside = each.join(large, ["dim", "coarse"])
    draw = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(shared.DRAW).cast("long")) < (F.col("share") * shared.DRAW).cast("long")
    fits = shared.cut(inside.where(draw).select("dim", "coarse", "total", "node", "emb").groupBy("dim", "coarse").applyInArrow(_fit(members, most, apart), "dim int, coarse int, centroids binary"), "centroids")
    heads = fits.join(large, ["dim", "coarse"]).select("dim", "coarse", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<float>").alias("emb"), "centroids")
    rows = inside.select("dim", "coarse", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "node", "emb", F.lit(None).cast("binary").alias("centroids"))
    keys = ["dim", "coarse", "salt"]
    dealt = heads.unionByName(rows).repartition(*keys).sortWithinPartitions(*keys, "role", "node").mapInArrow(_assign_fine(overlap), "node long, fine array<int>")
    fine = dealt.groupBy(F.col("node").alias("_n")).agg(F.flatten(F.collect_list("fine")).alias("fine"))  # at most overlap * overlap
    names = F.create_map(*(F.lit(x) for d in {d for d, _ in loads} for x in (d, [c for e, c in loads if e == d])))
    is_large = lambda x: F.array_contains(F.coalesce(F.try_element_at(names, F.col("dim")), F.array().cast("array<int>")), x)
    small = F.transform(F.filter(F.array_distinct("shards"), lambda x: ~is_large(x)), lambda x: (x * FINE).cast("int"))
    out = placed.join(fine, F.col("node") == F.col("_n"), "left")
    return out.withColumn("shards", F.array_sort(F.concat(small, F.coalesce("fine", F.array().cast("array<int>"))))).drop("_n", "fine")


def _index(classes: DataFrame, threshold: float, overlap: int, members: int, limit: int, sample: int, most: int) -> DataFrame:
    """(node, other, add): sums and stars of the links found."""
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = min(1.0, sample / max(1, total))
    rows = classes.where(shared.drawn(share, "node")).select("node", "dim", "emb").orderBy("node").toLocalIterator()
    drawn: dict[int, list] = {}
    for r in rows:
        drawn.setdefault(r["dim"], []).append(r["emb"])
    centroids = {}
    for dim, v in drawn.items():
        x = _unit(np.array(v, np.float64))
        centroids[dim] = kmeans(x, int(min(most, len(x), max(1, -(-counts[dim] // members)))), apart=threshold)
    schema = "node long, size long, dim int, emb array<float>, shards array<int>"
    placed = shared.cut(classes.select("node", "size", "dim", "emb").mapInArrow(_assign(centroids, overlap), schema), "placed")
    placed = shared.cut(_refined(placed, overlap, members, limit, most, threshold), "refined")
    each = placed.select("node", "size", "dim", "emb", "shards", F.explode(F.array_distinct("shards")).alias("shard"))
    subs = each.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("subs")).where("subs > 1")
    dealt = each.join(subs, ["dim", "shard"], "left").withColumn("subs", F.coalesce("subs", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int"))
    keys = ["dim", "shard", "sub"]
    built = dealt.withColumnRenamed("own", "sub").select(*keys, "node", "emb").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(_build, "node long, adj array<long>")
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("adj"))).alias("adj"))  # at most overlap * overlap * DEGREE
    spread = dealt.select("dim", "shard", "node", "size", "emb", "shards", "own", F.explode(F.sequence(F.col("own"), F.col("subs") - 1)).alias("sub"))
    rows = spread.withColumn("role", (F.col("sub") > F.col("own")).cast("int")).join(united, "node")
    found = rows.select(*keys, "role", "node", "size", "emb", "shards", "adj").repartition(*keys).sortWithinPartitions(*keys, "role", "node").mapInArrow(_search(threshold), "kind int, node long, other long, add long, back long, shard long")
    return _united(shared.cut(found, "found"))


def _brute(queries: list[tuple[int, list[float]]], threshold: float):
    """Counts of links of each query with the rows of a partition."""
    by_dim: dict[int, list] = {}
    for n, v in queries:
        by_dim.setdefault(len(v), []).append((n, v))
    units = {d: (np.array([n for n, _ in v]), _unit(np.array([x for _, x in v]))) for d, v in by_dim.items()}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, node, size = (b.column(c).to_numpy() for c in ("dim", "node", "size"))
            for d, (names, q) in units.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    x = _unit(b.column("emb").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                    hit = (q @ x.T >= threshold) & (names[:, None] != node[at])
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(hit @ size[at])], names=["node", "n"])

    return step


def _united(found: DataFrame) -> DataFrame:
    """(node, other, add) of what the shards gave back: stars, and every pair once with what it adds on both sides.

    A pair that a later shard found counts too, unless the shard it counts in made sums for one of its vectors: it may be among them.
    """
    pair = lambda kind: found.where(F.col("kind") == kind).select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"), F.when(F.col("node") < F.col("other"), F.col("add")).otherwise(F.col("back")).alias("of_v"), F.when(F.col("node") < F.col("other"), F.col("back")).otherwise(F.col("add")).alias("of_u"), "shard")
    late = pair(LATE)
    for end in ("u", "v"):
        dense = found.where(F.col("kind") == DENSE).select(F.col("node").alias(end), "shard").distinct()
        late = late.join(dense, [end, "shard"], "left_anti")
    once = pair(PAIR).unionByName(late).drop("shard").dropDuplicates(["u", "v"])
    sides = once.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other"), F.col("of_v").alias("add")), F.struct(F.col("v").alias("node"), F.col("u").alias("other"), F.col("of_u").alias("add")))).alias("x")).select("x.*")
    return found.where(F.col("kind") == STAR).select("node", "other", "add").unionAll(sides)


def _sketch(tables: int, bits: int, seed: int = 11):
    """For every table, on which sides of random planes each vector lies, as one number."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, node = b.column("dim").to_numpy(), b.column("node").to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _unit(b.column("emb").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                side = x @ np.random.default_rng([seed, int(d)]).normal(size=(int(d), tables * bits)) > 0
                sign = (side.reshape(len(at), tables, bits) << np.arange(bits, dtype=np.int64)).sum(2)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(dims[at], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(sign.ravel()), pa.array(np.repeat(node[at], tables))], names=["dim", "table", "sign", "node"])

    return step


def linked_by_sketches(classes: DataFrame, threshold: float, total: int, tables: int = 16) -> DataFrame:
    """(node, emb) of classes that have a link, found without the index: of every group with one sketch in a table, the first and the last class are compared.

    With about log2 of the classes and four bits more, few groups have two classes by chance; of pairs that are within 0.95, one table of 18 bits joins a seventh, 16 tables nine tenths.
    """
    bits = min(60, int(np.log2(max(2, total))) + 4)
    signs = classes.select("dim", "node", "emb").mapInArrow(_sketch(tables, bits), "dim int, table int, sign long, node long")
    pairs = signs.groupBy("dim", "table", "sign").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b").distinct()
    one, two = (classes.select(F.col("node").alias(n), F.col("emb").alias(f"e{n}")) for n in ("a", "b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    met = pairs.join(one, "a").join(two, "b")
    cosine = dot("ea", "eb") / F.sqrt(dot("ea", "ea") * dot("eb", "eb"))
    return met.where(cosine >= threshold).select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ea").alias("emb")), F.struct(F.col("b").alias("node"), F.col("eb").alias("emb")))).alias("x")).select("x.*").dropDuplicates(["node"])


def audit(classes: DataFrame, links: DataFrame, threshold: float, queries: int = 256, enough: int = 32, most: int = 4096) -> float:
    """Mean over drawn classes that have links of the share of their brute-force links that were found, so that no large group outvotes the others.

    About `queries` classes are drawn, and four times as many, up to `most`, until `enough` have links or all classes are drawn. Where links are so rare that even then too few
    have any, classes that have some are sought without the index, by sketches, and up to four times `enough` of them are compared with all others as well.
    1 is returned without a measure only if neither way found a single linked class.
    """
    total = classes.count()
    got = links.groupBy("node").agg(F.sum("add").alias("add"))

    def measured(drawn: list[tuple[int, list[float]]]) -> tuple[int, float | None]:
        true = classes.select("node", "size", "dim", "emb").mapInArrow(_brute(drawn, threshold), "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).where("n > 0")
        r = true.join(got, "node", "left").agg(F.count(F.lit(1)).alias("n"), F.avg(F.least("n", F.coalesce("add", F.lit(0))) / F.col("n")).alias("recall")).first()
        return r["n"], r["recall"]

    while total:
        share = min(1.0, queries / total)
        drawn = [(r["node"], r["emb"]) for r in classes.where(shared.drawn(share, "node", F.lit(1))).select("node", "emb").collect()]
        n, recall = measured(drawn) if drawn else (0, None)
        if share == 1.0 or n >= enough:
            return recall if n else 1.0
        if queries >= most:
            sought = linked_by_sketches(classes, threshold, total).orderBy(F.xxhash64("node"), "node").limit(4 * enough).collect()
            if sought:
                m, other = measured([(r["node"], r["emb"]) for r in sought])
                n, recall = n + m, ((recall or 0.0) * n + (other or 0.0) * m) / max(1, n + m)
            return recall if n else 1.0
        queries = min(most, queries * 4)
    return 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, overlap: int = 2, members: int = 1500, limit: int = 6000, sample: int = 16_384, recall: float = 0.98, most_overlap: int = 32, most: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding)."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("emb"))
    fine = F.col("emb").isNotNull() & F.forall("emb", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("emb", lambda v: v != 0)
    good = rows.where(F.coalesce(fine, F.lit(False)))
    classes = good.groupBy("emb").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("first")).select(F.monotonically_increasing_id().alias("node"), "size", "first", F.size("emb").alias("dim"), "emb")
    classes = shared.cut(classes, "classes")
    while True:
        links = shared.cut(_index(classes, threshold, overlap, members, limit, sample, most), "links")
        found = audit(classes, links, threshold)
        if found >= recall:
            break
        if overlap >= most_overlap:
            raise RuntimeError(f"the index found {found:.4f} of the links at overlap {overlap}, less than {recall}")
        overlap *= 2
    roots = shared.components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    sums = links.groupBy("node").agg(F.sum("add").alias("add"))
    named = shared.cut(classes.select("node", "size", "first", "emb").join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", F.col("node"))), "named")
    heads = named.groupBy("root").agg(F.min("first").alias("component"))
    decided = named.join(heads, "root").select("emb", (F.col("size") - 1 + F.coalesce("add", F.lit(0))).alias("links"), "component")
    out = good.join(decided, "emb").select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    rest = rows.where(~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
