"""Toxicity by weak supervision.

Voters look at a text: lexicon voters (a word or a word's stem that speaks for or against toxicity, mined from the training labels), and pattern voters
(shouting, repeated exclamation marks, insults next to "you", no lexicon word at all, ...). The given label is one more voter on training rows. A
generative label model with a latent class is fitted by EM, in which the given label anchors the class: it counts as right in at least 85 % of either (a stated
assumption, not an estimate). The others are estimated: each voter's probabilities of voting yes, no and abstaining under each class, and the
correlations between voters within a class, by which voters that repeat each other share their weight. Its posteriors are the soft labels on
which a linear (logistic) classifier over words and patterns is trained; that classifier scores every text.

Bounds: the model is fitted on at most about `most_rows` labelled training rows, drawn by a hash of the id, and has at most `most_words` words; these
bounds are parameters. Every text is scored whole.

Null and empty texts have no words and score as such. Repeated rows score alike; of several labels for an id the highest counts, null labels
don't. Without labels of both classes every score is the share of toxic ones (0 without labels). Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

PATTERNS = ("shouting", "exclaims", "addresses", "insult_near_you", "several_insults", "no_insult", "repeats")
#: Bytes of a word's stem, which is written with a star: patterns such as `abcde*` catch a word's forms.
STEMS = (4, 5, 6, 7, 8)
#: A stem may have to occur so often in a text.
LEVELS = 3
#: A log-likelihood ratio from which a word votes.
CLEAR = 25
_YOU = ("you", "your", "youre", "u")


# ---------------------------------------------------------------- features


def _bytes(word: str) -> bytes:
    return word.encode("utf-8", "surrogateescape")


def _hash(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    each = [_bytes(w) for w in words]
    raw, ends = np.frombuffer(b"".join(each), np.uint8), np.cumsum([len(x) for x in each])
    return shared.span_hash(raw, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64))


class Reader:
    """Which words and patterns are in each row. A feature is a word, `stem*` (a word that begins so and goes on) or `stem*2`, `stem*3` (so many of them)."""

    def __init__(self, words: list[str], insults: int) -> None:
        """The first `insults` features speak for toxicity."""
        self.n, self.insults = len(words), insults
        self.you = np.sort(_hash(list(_YOU)))
        self.tables = {}  # by stem size in bytes, 0 for words: sorted hashes, and the feature of each level
        by: dict[int, dict[str, dict[int, int]]] = {}
        for f, w in enumerate(words):
            stem, star, level = w.partition("*")
            by.setdefault(len(_bytes(stem)) if star else 0, {}).setdefault(stem, {})[int(level or 1)] = f
        for size, stems in by.items():
            h = _hash(list(stems))
            order = np.argsort(h)
            levels = np.full((len(stems), LEVELS + 1), -1)
            for k, found in enumerate(stems.values()):
                for level, f in found.items():
                    levels[k, level] = f
            self.tables[size] = h[order], levels[order]

    def read(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) pairs without repeats; features are the words, then PATTERNS."""
        n = len(offsets) - 1
        starts, ends, rows = shared.word_spans(raw, offsets, shared.IS_ALNUM)
        low = shared.ALNUM[raw]
        h = shared.span_hash(low, starts, ends)
        row_of = np.repeat(np.arange(n), np.diff(rows))
        insult = np.zeros(len(h), bool)
        row, feature = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, (keys, levels) in self.tables.items():
            which = np.arange(len(h)) if not size else np.flatnonzero(ends - starts > size)
            if not len(which):
                continue
            key = h if not size else shared.span_hash(low, starts[which], starts[which] + size)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            which, stem = which[hit], at[hit]
            insult[which[(levels[stem, 1] >= 0) & (levels[stem, 1] < self.insults)]] = True
            pair, count = np.unique(row_of[which] * len(keys) + stem, return_counts=True)
            r, stem = pair // len(keys), pair % len(keys)
            for level in range(1, LEVELS + 1):
                ok = (count >= level) & (levels[stem, level] >= 0)
                row.append(r[ok])
                feature.append(levels[stem[ok], level])
        row, feature = np.concatenate(row), np.concatenate(feature)
        spoken = np.bincount(row[feature < self.insults], minlength=n)
        flags = np.zeros((len(PATTERNS), n), bool)
        size = np.maximum(np.diff(offsets), 1)
        per_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        upper, lower = per_row((raw >= 65) & (raw <= 90)), per_row((raw >= 97) & (raw <= 122))
        flags[0] = upper > np.maximum(lower, 20)
        bang = raw == 33
        double = np.concatenate([bang[1:] & bang[:-1], [False]]) if len(raw) else bang
        double[offsets[(offsets > 0) & (offsets <= len(raw))] - 1] = False  # not with the next row's
        flags[1] = per_row(double) * 200 > size
        you = np.isin(h, self.you)
        count = lambda x: np.bincount(row_of[x], minlength=n)
        flags[2] = count(you) * 30 > np.maximum(np.diff(rows), 1)
        near = np.zeros(len(h), bool)
        for d in range(1, 4):
            near[d:] |= insult[d:] & you[:-d] & (row_of[d:] == row_of[:-d])
            near[:-d] |= insult[:-d] & you[d:] & (row_of[d:] == row_of[:-d])
        flags[3] = count(near) > 0
        flags[4] = (count(insult) > 1) | (spoken > 1)
        flags[5] = spoken == 0
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row_of[1:] == row_of[:-1])
        flags[6] = count(same) * 10 > np.maximum(np.diff(rows), 1)
        pattern, r = np.nonzero(flags)
        return np.concatenate([row, r]), np.concatenate([feature, self.n + pattern])


# ---------------------------------------------------------------- label model


@dataclass
class LabelModel:
    prior: float
    votes: np.ndarray  # voter, class, vote (-1, 0, 1): probabilities
    correlations: np.ndarray  # voter, voter, within the classes
    weight: np.ndarray  # a voter's share among those it repeats

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        j = np.arange(votes.shape[1])
        ratio = np.log(self.votes[:, 1] / self.votes[:, 0])  # voter, vote
        total = np.log(self.prior / (1 - self.prior)) + (ratio[j, votes + 1] * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_label_model(votes: np.ndarray, first: np.ndarray, rounds: int = 25, anchor: int | None = None, least: float = 0.85) -> LabelModel:
    """EM from a first guess of the posteriors. votes: row, voter, in -1, 0, 1.

    anchor: a voter who never abstains and is right at least that often in either class. It keeps the latent class from drifting to another
    that splits the votes as well, such as a language, and does not share its weight.
    """
    n, m = votes.shape
    q = np.clip(first, 0.02, 0.98)
    weight, corr = np.ones(m), np.eye(m)
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float32)
    for k in range(rounds):
        prior = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
        table = np.stack([np.tensordot(1 - q, hot, (0, 0)), np.tensordot(q, hot, (0, 0))], axis=1) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        if anchor is not None:
            for c, right in ((0, 0), (1, 2)):
                p = max(table[anchor, c, right], least)
                table[anchor, c] = [p, 1e-6, 1 - p] if right == 0 else [1 - p, 1e-6, p]
        if k in (5, 15):
            mean = (table[:, :, 2] - table[:, :, 0]).T  # class, voter
            left = votes - (q[:, None] * mean[1] + (1 - q)[:, None] * mean[0])
            cov = left.T @ left / max(1, n)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = cov / sd / sd[:, None]
            strong = np.where(np.abs(corr) > 0.25, np.abs(corr), 0)
            np.fill_diagonal(strong, 1)
            weight = 1 / strong.sum(axis=1)
            if anchor is not None:
                weight[anchor] = 1
        model = LabelModel(prior, table, corr, weight)
        q = model.posterior(votes)
    return model


def fit_linear(rows: np.ndarray, features: np.ndarray, n: int, m: int, target: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on sparse 0/1 features and soft labels; the last weight is the intercept. Nesterov's gradient steps."""
    w = np.zeros(m + 1)
    v, size = w.copy(), 4.0 / max(1.0, np.bincount(rows, minlength=n).mean() + 1)
    for k in range(rounds):
        score = np.bincount(rows, v[features], n) + v[m]
        gap = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        grad = np.append(np.bincount(features, gap[rows], m), gap.sum()) / n + ridge * np.append(v[:m], 0)
        new = v - size * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w


# ---------------------------------------------------------------- training


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of words by label, summed over a partition."""
    from collections import Counter

    yes, every = Counter(), Counter()
    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            split = shared.ALNUM[raw].tobytes().replace(b"\0", b" ").split()
            stems = Counter(w[:k] for w in split for k in STEMS if len(w) > k)
            words = set(split) | {w + b"*" for w in stems} | {w + b"*%d" % level for w, c in stems.items() for level in range(2, min(c, LEVELS) + 1)}
            every.update(words)
            if toxic:
                yes.update(words)
    rows = list(every)
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array([yes[w] for w in rows], pa.int64()), pa.array([every[w] for w in rows], pa.int64())], names=["word", "yes", "n"])


def _apart(found: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Without what a stronger one says already: words below a chosen stem, stems that extend or shorten a chosen one."""
    out, stems, heads = [], set(), set()
    for w, g in found:
        stem, star, _ = w.partition("*")
        under = any(stem[:k] in stems for k in range(1, len(stem) + 1))
        if under or (star and stem in heads):
            continue
        out.append((w, g))
        if star:
            stems.add(stem)
        heads.update(stem[:k] for k in range(1, len(stem) + 1))
    return out


@dataclass
class Model:
    words: list[str]
    insults: int
    weights: np.ndarray
    label_model: LabelModel | None = None


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, most_rows: int = 20_000, most_words: int = 512, lexicon: int = 64) -> Model:
    known = labels.where(F.col("toxic").isNotNull() & train_rows).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    share = min(1.0, most_rows / max(1, total))
    drawn = known.where(shared.drawn(share, "doc_id"))
    # at most about `most_rows` small rows, so they can be sent to every worker, and the texts stay where they are; copies of a text count once
    sample = shared.cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "labelled")
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("yes")).first()
    n, yes = size["n"], size["yes"]
    if not 0 < yes < n:
        p = (yes + 1e-9) / (n + 2e-9) if n else 0.0
        return Model([], 0, np.append(np.zeros(len(PATTERNS)), np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9)))))
    # the log-likelihood ratio of word and label: rare words with a few labelled copies do not pass frequent ones
    a, b = F.col("yes"), F.col("n") - F.col("yes")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    rate = yes / n
    g = 2 * (part(a, F.col("n") * rate) + part(b, F.col("n") * (1 - rate)) + part(yes - a, (n - F.col("n")) * rate) + part(n - yes - b, (n - F.col("n")) * (1 - rate)))
    mined = sample.mapInArrow(_df, "word binary, yes long, n long").groupBy("word").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n")).where("n >= 3")
    mined = mined.withColumn("g", F.when(a > F.col("n") * rate, g).otherwise(-g))
    mined_rows = [(r["word"].decode("utf-8", "surrogateescape"), r["g"], r["yes"] / r["n"]) for r in mined.orderBy(F.abs("g").desc(), F.octet_length("word").desc(), F.desc("word")).limit(8 * most_words).collect()]
    found = _apart([x[:2] for x in mined_rows])[:most_words]
    precision = {w: p for w, _, p in mined_rows}
    # a lexicon voter is right more often than not; a word that merely goes with toxic texts, as of one language, is left to the classifier
    insults = [w for w, x in found if x > CLEAR and precision[w] > 0.5][:lexicon]
    words = insults + [w for w, _ in found if w not in set(insults)]
    signs = dict(found)
    reader = Reader(words, len(insults))
    m = len(words) + len(PATTERNS)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offsets in shared.slices(b.column("text")):
                row, feature = reader.read(raw, offsets)
                order = np.argsort(row, kind="stable")
                at = np.searchsorted(row[order], np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("toxic").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(feature[order].astype(np.int32)))], names=["doc_id", "toxic", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(sample.mapInArrow(step, f"doc_id {kind}, toxic int, features array<int>").collect(), key=lambda r: (r["doc_id"], r["features"]))
    rows = np.repeat(np.arange(len(got)), [len(r["features"]) for r in got])
    features = np.array([f for r in got for f in r["features"]], np.int64)
    label = np.array([r["toxic"] for r in got])
    # voters: the mined words that speak clearly, the patterns, and the given label
    speak = [i for i, w in enumerate(words) if i < len(insults) or signs[w] < -CLEAR][: 2 * lexicon]
    voters = speak + list(range(len(words), m))
    votes = np.zeros((len(got), len(voters) + 1), np.int8)
    column = np.full(m, -1)
    column[voters] = np.arange(len(voters))
    in_no = len(words) + PATTERNS.index("no_insult")
    sign = np.array([-1 if (v < len(words) and signs[words[v]] < 0) or v == in_no else 1 for v in voters])
    hit = column[features] >= 0
    votes[rows[hit], column[features[hit]]] = sign[column[features[hit]]]
    votes[:, -1] = np.where(label > 0, 1, -1)
    model = fit_label_model(votes, np.where(label > 0, 0.9, 0.1), anchor=votes.shape[1] - 1)
    soft = model.posterior(votes)
    return Model(words, len(insults), fit_linear(rows, features, len(got), m, soft), model)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) of every row of docs (doc_id, text, held_out)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # `most_words` bounds it

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, w = Reader(sent.value.words, sent.value.insults), sent.value.weights
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, hi, raw, offsets in shared.slices(b.column("text")):
                row, feature = reader.read(raw, offsets)
                out[lo:hi] = np.bincount(row, w[feature], hi - lo) + w[-1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], names=["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "held_out").mapInArrow(step, f"doc_id {kind}, held_out boolean, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = shared.in_remainder("doc_id", 5, 0)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held.alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels, ~held)
    return score(docs, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def brute_force(model: Model, text: str | None) -> float:
    """A text's score by plain loops over its words, for tests."""
    import re

    raw = (text or "").encode()
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw))
    found, insults = set(), set()
    for f, w in enumerate(model.words):
        stem, star, level = w.partition("*")
        hits = [i for i, x in enumerate(words) if (x.startswith(_bytes(stem)) and len(x) > len(_bytes(stem)) if star else x == _bytes(stem))]
        if len(hits) >= int(level or 1):
            found.add(f)
        if f < model.insults and int(level or 1) == 1:
            insults |= set(hits)
    n = max(len(words), 1)
    you = [i for i, x in enumerate(words) if x in {_bytes(y) for y in _YOU}]
    upper, lower = len(re.findall(rb"[A-Z]", raw)), len(re.findall(rb"[a-z]", raw))
    spoken = sum(f < model.insults for f in found)
    flags = [
        upper > max(lower, 20),
        len(re.findall(rb"!(?=!)", raw)) * 200 > max(len(raw), 1),
        len(you) * 30 > n,
        any(0 < abs(i - j) < 4 for i in insults for j in you),
        len(insults) > 1 or spoken > 1,
        spoken == 0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) * 10 > n,
    ]
    total = sum(model.weights[f] for f in found) + sum(model.weights[len(model.words) + i] for i, x in enumerate(flags) if x) + model.weights[-1]
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))
