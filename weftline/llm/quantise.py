"""Vector code compression: product codebooks by Lloyd rounds with Yinyang bounds, in whole numbers.

Components become floor(1024 * x); a vector is cut into equal parts, each with a codebook of its own. The entries of a codebook are clustered into groups once, at the
start. Every row keeps, for each part, its entry and one lower bound for each group: no entry of that group, other than its own, is nearer than that.
After the entries moved, a group's bound loses the group's largest drift. Where every bound is still above the distance to the own entry, nothing is compared; else
only the groups whose bounds failed are scanned. Distances of a scan are floating-point products; every entry that could be the nearest by their error bound is
compared again in whole numbers, so ties go to the lower index exactly, whatever the rounding.

Each round is two jobs: one writes the rows with entries and bounds to the shared folder, one sums the parts by entry (each task sums its rows first) and brings
those sums, as many as the codebooks have numbers, to the driver. The rows of the round before are removed then. What is broadcast are the codebooks.

Rows whose vector is null or holds null or non-finite components are dropped, and so are rows whose vector's length is not the table's commonest length that can be cut into
the parts (the shorter of two as common ones). Rows with equal ids are rows of their own; the first codebook takes vec_ids in ascending order, null ids last, rows with one id
by their vectors. With fewer rows than entries the codebooks are as long as there are rows. Null labels are one label. An empty table gives an empty result.
Extra columns are dropped. Distances that a long cannot hold raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stages
from . import shared

#: Whole numbers below this have squared distances of up to 512 components in 64 bits; others are computed with Python's.
SMALL = 1 << 26
#: Rows of one step.
ROWS = 4096
#: Floats that must not be above the true number are lowered by this share, twice a float32's rounding.
LOWER = 1 - 2.0**-22


@dataclass(frozen=True)
class Codebooks:
    """entries[part][entry]: its whole components; group[part][entry]: its group; drift[part][group]: the largest move of an entry since the last round."""

    entries: list[np.ndarray]
    group: list[np.ndarray]
    drift: list[np.ndarray] | None = None

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for part in self.entries for entry in part for x in entry).encode()).hexdigest()


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x), in 64 bits or, where squares would not fit, as Python's numbers."""
    scaled = np.floor(vectors.astype(np.float64) * 1024.0)
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], object).reshape(scaled.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    if max((int(np.abs(x).max()) for x in (a, b) if x.size), default=0) >= SMALL:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(axis=-1)


def grouped(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """Each entry's group: a few Lloyd rounds over the entries, seeded by entries at even steps."""
    x = entries.astype(np.float64)
    n = len(x)
    centres = x[np.linspace(0, n - 1, min(groups, n)).astype(int)] if n else x
    found = np.zeros(n, np.int64)
    for _ in range(rounds if n else 0):
        found = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([x[found == g].mean(0) if (found == g).any() else centres[g] for g in range(len(centres))])
    return np.unique(found, return_inverse=True)[1]


class Part:
    """One codebook as a task works with it."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, drift: np.ndarray | None) -> None:
        self.entries, self.drift = entries, drift
        self.real = entries.astype(np.float64)
        self.norms = (self.real**2).sum(1)
        self.groups = [np.flatnonzero(group == g) for g in range(int(group.max(initial=-1)) + 1)]
        self.group = group
        self.compared = 0  # distances computed by scans

    def _scan(self, x: np.ndarray, real: np.ndarray, norms: np.ndarray, g: int, best: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, ...]:
        """The rows against a group: the better of what they had and its nearest entry, that entry, and bounds below the distances to it and to the others."""
        at = self.groups[g]
        self.compared += len(x) * len(at)
        near = norms[:, None] + self.norms[at] - 2.0 * (real @ self.real[at].T)
        slack = (x.shape[1] + 8) * 2.0**-51 * (norms[:, None] + self.norms[at])
        low, high = near - slack, near + slack
        # all that may be the nearest by the error bound are verified in whole numbers
        row, col = np.nonzero(low <= high.min(1)[:, None])
        exact = squared(x[row], self.entries[at[col]])
        order = np.lexsort((at[col], exact, row)) if exact.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], exact[i], at[col[i]])), np.int64)
        first = order[np.flatnonzero(np.r_[True, np.diff(row[order]) > 0])]
        d, own = exact[first], at[col[first]]
        better = (d < best) | ((d == best) & (own < entry))
        others = low.copy()
        others[np.arange(len(x)), col[first]] = np.inf
        return np.where(better, d, best), np.where(better, own, entry), own, low[np.arange(len(x)), col[first]], others.min(1)

    def nearest(self, x: np.ndarray, entry: np.ndarray | None, bounds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's nearest entry, the lower of equally near ones; its squared distance; and its bounds. entry and bounds are those of the round before."""
        n, k = len(x), len(self.groups)
        real = x.astype(np.float64)
        norms = (real**2).sum(1)
        start = entry
        if entry is None:
            entry, best, low = np.full(n, len(self.entries), np.int64), np.full(n, -1, np.int64), np.zeros((n, k))
        else:
            entry, best = entry.astype(np.int64), squared(x, self.entries[entry])
            low = np.maximum((bounds.astype(np.float64) - self.drift * (1 + 2.0**-40)) * LOWER, 0.0)
        own = [None] * k
        at_least = low * low * (1 - 2.0**-40)
        moved = np.zeros(n, bool)
        first_best = best.copy()
        for g in range(k):
            rows = np.flatnonzero(at_least[:, g] <= best.astype(np.float64) * (1 + 2.0**-50)) if start is not None else np.arange(n)
            if not len(rows):
                continue
            have = best[rows] if start is not None or g else np.full(len(rows), np.iinfo(np.int64).max) if x.dtype != object else np.full(len(rows), 1 << 400, object)
            d, e, nearest, one, two = self._scan(x[rows], real[rows], norms[rows], g, have, entry[rows])
            if d.dtype != best.dtype:
                best = best.astype(object)
            best[rows], entry[rows] = d, e
            own[g] = (rows, nearest, one, two)
        root = lambda v: np.sqrt(np.maximum(v, 0.0)) * LOWER
        for g, seen in enumerate(own):
            if seen is not None:
                rows, nearest, one, two = seen
                low[rows, g] = root(np.where(entry[rows] == nearest, two, one))
        if start is not None:
            # the entry left behind is one of its group's others now
            moved = entry != start
            rows = np.flatnonzero(moved)
            g = self.group[start[rows]]
            low[rows, g] = np.minimum(low[rows, g], root(first_best[rows].astype(np.float64) * (1 - 2.0**-50)))
        return entry, best, np.minimum(low, np.finfo(np.float32).max).astype(np.float32)


def _lists(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _assign(books: Codebooks, last: bool):
    """Rows with their entries, bounds and, at last, errors."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [Part(*x) for x in zip(books.entries, books.group, books.drift or [None] * len(books.entries), strict=True)]
        ends = np.cumsum([0, *(len(p.groups) for p in parts)])
        for b in (whole_batch.slice(i, ROWS) for whole_batch in batches for i in range(0, whole_batch.num_rows, ROWS)):
            n = b.num_rows
            pieces = np.split(whole(_lists(b.column("emb"), n)), len(parts), axis=1)
            old = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, -1) if books.drift else None
            bounds = np.frombuffer(b"".join(b.column("bounds").to_pylist()), "<f4").reshape(n, -1) if books.drift else None
            found = [p.nearest(x, old[:, i] if books.drift else None, bounds[:, ends[i] : ends[i + 1]] if books.drift else None) for i, (p, x) in enumerate(zip(parts, pieces, strict=True))]
            code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            rows = [b.column("vec_id"), b.column("label")]
            if last:
                error = sum(f[1].astype(object) for f in found)
                yield pa.RecordBatch.from_arrays([*rows, pa.array([bytes(c).hex() for c in code], pa.string()), pa.array(error.tolist(), pa.int64())], names=["vec_id", "label", "code", "error"])
            else:
                low = np.ascontiguousarray(np.concatenate([f[2] for f in found], axis=1), "<f4")
                yield pa.RecordBatch.from_arrays([*rows, b.column("emb"), pa.array([bytes(c) for c in code], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary())], names=["vec_id", "label", "emb", "code", "bounds"])

    return step


def _sums(parts: int):
    """A task's sums of the parts by entry, a row for each component."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, -1)
            for p, x in enumerate(np.split(whole(_lists(b.column("emb"), n)), parts, axis=1)):
                order = np.argsort(code[:, p], kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(code[order, p].astype(np.int64)) != 0])
                for e, total, count in zip(code[order[heads], p].tolist(), np.add.reduceat(x[order], heads, axis=0), np.diff(np.r_[heads, n]).tolist(), strict=True):
                    c, t = held.get((p, e), (0, 0))
                    held[p, e] = (c + count, t + total.astype(object))
        keys = [(p, e, c, j, str(s)) for (p, e), (c, t) in held.items() for j, s in enumerate(t.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*keys, strict=True) if keys else [[]] * 5, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["part", "entry", "n", "j", "total"])

    return step


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after a round: the floored means of their parts; unused entries stay. A row for each number of the codebooks comes to the driver."""
    sums = rows.select("emb", "code").mapInArrow(_sums(len(books.entries)), "part int, entry int, n long, j int, total string")
    found = sums.groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    new = [e.astype(object) for e in books.entries]
    for r in found:
        new[r["part"]][r["entry"], r["j"]] = int(r["total"]) // r["n"]
    new = [e.astype(np.int64) if not e.size or max(map(abs, e.ravel().tolist())) < SMALL else e for e in new]
    drift = []
    for was, now, group in zip(books.entries, new, books.group, strict=True):
        far = np.sqrt(squared(was, now).astype(np.float64)) * (1 + 2.0**-40)
        drift.append(np.array([far[group == g].max() for g in range(int(group.max(initial=-1)) + 1)]))
    return Codebooks(new, books.group, drift)


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, per_group: int = 16) -> tuple[DataFrame, Codebooks | None]:
    """Rows (vec_id, label, code, error) of vectors(vec_id, embedding, label) and the codebooks; without rows there are none. `entries` are at most 256."""
    spark = vectors.sparkSession
    kind = "array<double>" if "double" in dict(vectors.dtypes)["embedding"] else "array<float>"
    slim = vectors.select("vec_id", "label", F.col("embedding").cast(kind).alias("emb"))
    fine = slim.where(F.col("emb").isNotNull() & F.forall("emb", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))))
    length = fine.groupBy(F.size("emb").alias("n")).count().where((F.col("n") % parts == 0) & (F.col("n") > 0)).orderBy(F.desc("count"), "n").first()
    if length is None:
        return slim.where(F.lit(False)).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    rows = fine.where(F.size("emb") == length["n"])
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "emb").limit(entries).select("emb").collect()
    start = np.split(whole(np.array([r["emb"] for r in first], np.float64)), parts, axis=1)
    books = Codebooks(start, [grouped(e, -(-len(first) // per_group)) for e in start])
    ids = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "emb")
    path = None
    for _ in range(rounds):
        assigned = rows.mapInArrow(_assign(books, False), f"{ids}, emb {kind}, code binary, bounds binary")
        before, path = path, stages.folder(spark, "codes")
        assigned.write.parquet(path)
        rows = spark.read.schema(assigned.schema).parquet(path)
        books = moved(rows, books)
        if before:
            stages.remove(spark, before)
    out = shared.cut(rows.mapInArrow(_assign(books, True), f"{ids}, code string, error long"), "coded")
    if path:
        stages.remove(spark, path)
    return out, books


def with_label_error(coded: DataFrame, broadcast_labels: int = 100_000, salts: int = 64) -> DataFrame:
    """coded with label_error, the errors summed over its label. A label's rows are summed up before the shuffle and stay spread: the sums are broadcast if
    there are at most so many labels, else each is copied for every salt and the rows are dealt by label and salt."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if sums.limit(broadcast_labels + 1).count() <= broadcast_labels:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    spread = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = coded.withColumn("_own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_own") == F.col("_salt"))).drop("_label", "_own", "_salt")


def op12_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = books.digest() if books else None
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds without bounds: every part against every entry."""
    assign = lambda i: f"a{i} AS MATERIALIZED (SELECT p.r, p.q, min(list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x)) AS d, arg_min(c.e, (list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x)) * {entries} + c.e) AS e FROM p JOIN c{i} c ON p.q = c.q GROUP BY p.r, p.q)"
    move = lambda i: f"""m{i} AS (SELECT q, e, list(floor(s / n) ORDER BY j) AS x FROM (SELECT a.q, a.e, j, sum(p.x[j]) AS s, count(*) AS n FROM a{i} a JOIN p ON a.r = p.r AND a.q = p.q, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS j) GROUP BY ALL) GROUP BY q, e),
c{i + 1} AS MATERIALIZED (SELECT c.q, c.e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON c.q = m.q AND c.e = m.e)"""  # noqa: E731
    steps = ",\n".join(f"{assign(i)},\n{move(i)}" for i in range(rounds))
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS r, * FROM k),
p AS MATERIALIZED (SELECT r, q, v[q * len(v) // {parts} + 1 : (q + 1) * len(v) // {parts}] AS x FROM n, (SELECT unnest(range({parts})) AS q)),
c0 AS MATERIALIZED (SELECT q, r AS e, x FROM p WHERE r < {entries}),
{steps},
{assign(rounds)},
o AS MATERIALIZED (SELECT n.vec_id, n.label, c.code, c.error FROM n JOIN (SELECT r, string_agg(printf('%02x', e), '' ORDER BY q) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r) c USING (r)),
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY q, e, j)) AS sha FROM (SELECT q, e, unnest(x) AS y, unnest(range(len(x))) AS j FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha FROM h) AS codebooks_sha256 FROM o
"""


ORACLE_SQL = _oracle()


def brute_force(vectors: list[tuple], parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[list[tuple], str]:
    """The same by whole distance tables, for tests: ((vec_id, label, code, error) of each of the kept (vec_id, vector, label) in order, codebooks' digest)."""
    kept = sorted(((i, v, label) for i, v, label in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(1024 * np.array([v for _, v, _ in kept], np.float32).astype(np.float64)).astype(np.int64)
    pieces = np.split(x, parts, axis=1)
    books = [p[:entries].copy() for p in pieces]
    for r in range(rounds + 1):
        d = [((p[:, None, :] - b[None]) ** 2).sum(2) for p, b in zip(pieces, books, strict=True)]
        code = [t.argmin(1) for t in d]
        for p, b, c in zip(pieces, books, code, strict=True) if r < rounds else ():
            for e in set(c.tolist()):
                b[e] = p[c == e].sum(0) // (c == e).sum()
    error = sum(t.min(1) for t in d)
    rows = [(i, label, "".join(f"{int(c[j]):02x}" for c in code), int(error[j])) for j, (i, _, label) in enumerate(kept)]
    return rows, hashlib.sha256(",".join(str(int(y)) for b in books for e in b for y in e).encode()).hexdigest()
