"""A trained option scorer: a linear head over hashed features, fitted by sums of gradients (MD-6, MD-7, SF-21, AG-24).

Features of an option are its text within its question, and that text crossed with each word of the state; they are hashed into `dims` places, the first `bias` of them for the former. A second
head over the state's words says whether the question can be answered. The loss is the mean soft cross entropy of answerable rows and, weighted, the mean binary cross
entropy of answerability.

Rows become feature places once, in a table in the shared folder. A step is one job: every task sums the gradients of its rows, the shuffle adds up a number for each place, and
at most 2 * dims of them come to the driver, whatever the number of rows; the weights, as many, are broadcast. The rows of an epoch are dealt to `parts` steps by a hash of
their key, so steps are the same however rows are dealt. Rates differ by group of places and follow a schedule; a moving average of the weights is what is evaluated, and
the epoch whose average has the least loss on the development rows is returned.

Null states and questions are empty; a row without target mass counts as unanswerable. Without training rows all weights are 0: every option is as likely.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow
from ..functions import exprs as E
from ..sources import stages

ANSWERABLE = "\0answerable"


@dataclass(frozen=True)
class Settings:
    dims: int = 1 << 16
    bias: int = 1 << 10
    rates: dict[str, float] = field(default_factory=lambda: {"bias": 0.3, "cross": 0.6})
    epochs: int = 6
    parts: int = 3
    warmup: float = 0.1
    schedule: str = "cosine"
    decay: float = 0.8
    answer_weight: float = 0.25


def _crossed(words: np.ndarray, option: int, s: Settings) -> np.ndarray:
    x = (words ^ np.uint64(option * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x >> np.uint64(33)) % np.uint64(s.dims - s.bias)).astype(np.int64) + s.bias


def features(state: str | None, text: str | None, options: list[str], s: Settings) -> tuple[list[np.ndarray], float]:
    """The places of the state's answerability and of each option, each option's own place first, and the value of the places of words."""
    words = np.array([zlib.crc32(w.encode()) for w in sorted(set((state or "").lower().split()))], np.uint64)
    own = [zlib.crc32(x.encode()) for x in (ANSWERABLE, *(f"{text or ''}\0{o}" for o in options))]
    return [np.concatenate([[h % s.bias], _crossed(words, h, s)]).astype(np.int64) for h in own], float(max(1, len(words)) ** -0.5)


@dataclass
class Rows:
    """Encoded rows: the places of all groups one after another, where each group begins, its row and value."""

    places: np.ndarray
    begins: np.ndarray
    groups: np.ndarray  # groups of each row, the first for answerability
    scale: np.ndarray
    target: np.ndarray  # of all options one after another
    yes: np.ndarray

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Rows:
        places = b.column("places").flatten().to_numpy().astype(np.int64)
        sizes = b.column("sizes").flatten().to_numpy()
        return cls(places, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), b.column("groups").to_numpy().astype(np.int64), b.column("scale").to_numpy(), b.column("target").flatten().to_numpy(), b.column("yes").to_numpy(zero_copy_only=False))


def loss_sums(weights: np.ndarray, r: Rows, with_gradient: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(cross entropy, answerable rows, binary cross entropy, rows), summed, and the gradients of the two losses: those of the options' places, then those of answerability's."""
    dims = len(weights) // 2
    n = len(r.groups)
    row = np.repeat(np.arange(n), r.groups)  # of each group
    first = np.zeros(len(row), bool)
    first[np.concatenate([[0], np.cumsum(r.groups)[:-1]]).astype(np.int64)] = True
    sizes = np.diff(np.concatenate([r.begins, [len(r.places)]]))
    group = np.repeat(np.arange(len(row)), sizes)  # of each place
    value = r.scale[row][group]
    value[r.begins] = 1.0
    at = r.places + np.where(first[group], dims, 0)
    z = np.add.reduceat(weights[at] * value, r.begins)
    answer, options = z[first], z[~first]
    heads = np.concatenate([[0], np.cumsum(r.groups - 1)[:-1]]).astype(np.int64)
    option_row = np.repeat(np.arange(n), r.groups - 1)
    top = np.maximum.reduceat(options, heads)
    e = np.exp(options - top[option_row])
    p = e / np.add.reduceat(e, heads)[option_row]
    ce = -np.add.reduceat(r.target * np.log(np.maximum(p, 1e-12)), heads)
    bce = np.logaddexp(0.0, answer) - r.yes * answer
    sums = np.array([ce[r.yes].sum(), r.yes.sum(), bce.sum(), n])
    if not with_gradient:
        return sums, None
    dz = np.empty(len(z))
    dz[first] = 1 / (1 + np.exp(-answer)) - r.yes
    dz[~first] = np.where(r.yes[option_row], p * np.add.reduceat(r.target, heads)[option_row] - r.target, 0.0)
    return sums, np.bincount(at, dz[group] * value, len(weights))


def loss_of(sums: np.ndarray, answer_weight: float) -> float:
    return float(sums[0] / max(1, sums[1]) + answer_weight * sums[2] / max(1, sums[3]))


class OptionHead:
    """A fitted head, a `typed.Scorer`."""

    def __init__(self, weights: np.ndarray, settings: Settings) -> None:
        self.weights, self.settings = weights, settings

    def _z(self, places: np.ndarray, scale: float, shift: int = 0) -> float:
        w = self.weights[places + shift]
        return float(w[0] + scale * w[1:].sum())

    def logits(self, state, text, options):
        out = []
        for s, t, o in zip(state, text, options, strict=True):
            places, scale = features(s, t, o, self.settings)
            out.append([self._z(p, scale) for p in places[1:]])
        return out

    def tokens(self, state, text, options):
        return [(len((s or "").split()), 0) for s in state]

    def answerability(self, state: list[str]) -> list[float]:
        """The logit that a question about each state can be answered."""
        found = (features(s, "", [], self.settings) for s in state)
        return [self._z(p[0], scale, self.settings.dims) for p, scale in found]


def encoded(items: DataFrame, s: Settings) -> DataFrame:
    """items(item_id, state, text, texts, target) as feature places, and the step of an epoch that each row is in."""
    part = F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(s.parts)).cast("int")
    mass = F.aggregate("target", F.lit(0.0), lambda a, x: a + x)
    given = items.select("state", "text", "texts", F.col("target").cast("array<double>").alias("target"), (mass > 0).alias("yes"), part.alias("part")).where(F.size("texts") > 0)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.pieces(batches):
            found = [features(*row, s) for row in zip(*(b.column(c).to_pylist() for c in ("state", "text", "texts")), strict=True)]
            places = pa.array([np.concatenate(p).astype(np.int32) for p, _ in found], pa.list_(pa.int32()))
            sizes = pa.array([[len(x) for x in p] for p, _ in found], pa.list_(pa.int32()))
            cols = [places, sizes, pa.array([len(p) for p, _ in found], pa.int32()), pa.array([x for _, x in found], pa.float64()), b.column("target"), b.column("yes"), b.column("part")]
            yield pa.RecordBatch.from_arrays(cols, names=["places", "sizes", "groups", "scale", "target", "yes", "part"])

    return given.mapInArrow(step, "places array<int>, sizes array<int>, groups int, scale double, target array<double>, yes boolean, part int")


def _by_places(batches: Iterable[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many places, which is what `loss_sums` takes memory for; a row that has more is a piece of its own."""
    for whole in batches:
        begin, size = 0, 0
        for i, n in enumerate(pc.list_value_length(whole.column("places")).to_pylist()):
            if i > begin and size + n > most:
                yield whole.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        if begin < whole.num_rows:
            yield whole.slice(begin)


def _summed(rows: DataFrame, weights: np.ndarray, with_gradient: bool) -> tuple[np.ndarray, np.ndarray]:
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, gradient = np.zeros(4), np.zeros(len(sent.value))
        for b in _by_places(batches):
            more, g = loss_sums(sent.value, Rows.of(b), with_gradient)
            sums += more
            if g is not None:
                gradient += g
        some = np.flatnonzero(gradient)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(-4, 0), some])), pa.array(np.concatenate([sums, gradient[some]]))], names=["place", "value"])

    found = rows.mapInArrow(step, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    sent.unpersist()
    out = np.zeros(len(weights) + 4)
    out[found["place"].to_numpy() + 4] = found["value"].to_numpy()
    return out[:4], out[4:]


def fit(train: DataFrame, development: DataFrame, settings: Settings | None = None) -> tuple[OptionHead, list[dict]]:
    """The head of the best epoch, and each epoch's losses: `train`, summed over its steps as they were taken, and `development`, of the moving average after it."""
    s = settings or Settings()
    spark = train.sparkSession
    rows, dev = stages.cut(encoded(train, s), "encoded"), stages.cut(encoded(development, s), "encoded")
    steps = s.epochs * s.parts
    factors = [r[0] for r in spark.range(steps).orderBy("id").select(E.lr_factor(F.col("id"), steps, s.warmup, s.schedule)).collect()]  # a number for each step
    rate = np.tile(np.where(np.arange(s.dims) < s.bias, s.rates["bias"], s.rates["cross"]), 2)
    weights, average, squares = np.zeros(2 * s.dims), np.zeros(2 * s.dims), np.zeros(2 * s.dims)
    best, history = (np.inf, average.copy()), []
    for epoch in range(s.epochs):
        total = np.zeros(4)
        for part in range(s.parts):
            sums, g = _summed(rows.where(F.col("part") == part), weights, True)
            total += sums
            g[: s.dims] /= max(1, sums[1])
            g[s.dims :] *= s.answer_weight / max(1, sums[3])
            squares += g * g
            weights = weights - factors[epoch * s.parts + part] * rate * g / (np.sqrt(squares) + 1e-8)
            average = s.decay * average + (1 - s.decay) * weights
        now = loss_of(_summed(dev, average, False)[0], s.answer_weight)
        history.append({"epoch": epoch, "train": loss_of(total, s.answer_weight), "development": now})
        if now < best[0]:
            best = (now, average.copy())
    return OptionHead(best[1], s), history
