"""Language identification by word-first backoff.

Words are maximal runs of letters, lower-cased. A word of the vocabulary scores its log frequency in each language; any other word
falls back to its character 5-grams (with word ends), where none of those is known to its 4-grams, and so on down to single
characters, and scores the mean log frequency of the known ones. N-grams are counted once for each distinct word they are in, not by the words'
frequency, as they stand for words that were not seen. A text's language has the highest prior plus sum over its words; its
score is the posterior with that sum divided by the square root of the number of words, as words of a text are not independent.

Learning: rows with text and language that `train` selects. Counts are taken on a sample drawn by a hash of the id, with at most about
`sample_bytes` of text, shared equally by the languages (a documented bound of the classifier's sample); the vocabulary and each order of
n-grams hold at most `most` entries. That bounds the model, which is sent to every worker.

Texts that are null or have no letter are `und` with score 0, and so is every text if nothing could be learned. Repeated rows are predicted each
for itself. Ties go to the first language by name. Extra columns are dropped by the query and kept by `predict`; the stage's own columns start with _w_.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

ORDERS = (5, 4, 3, 2, 1)
_WORD = re.compile(r"[^\W\d_]+")
_EDGE = 0x110000  # stands for a word's ends


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case (where that is one code point). Made once a worker."""
    if "letters" not in shared.kept():
        every = np.arange(0x110000, dtype=np.int32)
        text = every.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        letter = np.zeros(0x110000, bool)
        for m in _WORD.finditer(text):
            letter[m.start() : m.end()] = True
        lower = every.copy()
        for i in np.flatnonzero(letter[:0x20000]).tolist():  # no letter beyond has case
            x = text[i].lower()
            if len(x) == 1:
                lower[i] = ord(x)
        shared.kept()["letters"] = letter, lower
    return shared.kept()["letters"]


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of code points, by their four bytes each."""
    return shared.span_hash(points, starts * 4, ends * 4)


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' code points and their offsets."""
    begins = (raw & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(begins)])[offsets]
    return np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.int32), at


def _spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = _tables()[0][points]
    return shared.word_spans(np.zeros(len(points), np.uint8) + inside, offsets, np.array([False, True]))


def _framed(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after another, an edge before and behind each; their first and last place."""
    size = ends - starts + 2
    stop = np.cumsum(size)
    begin = stop - size
    out = np.full(int(stop[-1]) if len(stop) else 0, _EDGE, np.int32)
    inner = np.repeat(begin + 1 - (np.cumsum(size - 2) - (size - 2)), size - 2) + np.arange(int((size - 2).sum()))
    out[inner] = points[np.repeat(starts - (np.cumsum(size - 2) - (size - 2)), size - 2) + np.arange(len(inner))]
    return out, begin, stop


def _grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the framed words and how many each word has."""
    flat, begin, stop = _framed(points, starts, ends)
    if n == 1:  # single characters, without the edges
        begin, stop = begin + 1, stop - 1
    count = np.maximum(stop - begin - n + 1, 0)
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return _hashes(flat, at, at + n), count


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    tables: dict[int, tuple[np.ndarray, np.ndarray]]  # 0: words, n: n-grams; sorted hashes, log frequencies by language

    def words(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Log frequency of each word in each language."""
        known, rows = self.find(0, hashes)
        out = np.zeros((len(hashes), len(self.languages)), np.float32)
        out[known] = self.tables[0][1][rows]
        left = np.flatnonzero(~known)
        for n in ORDERS:
            if not len(left):
                break
            grams, count = _grams(points, starts[left], ends[left], n)
            known, rows = self.find(n, grams)
            word = np.repeat(np.arange(len(left)), count)[known]
            hit = np.bincount(word, minlength=len(left))
            for j in range(len(self.languages)):
                total = np.bincount(word, self.tables[n][1][rows, j], len(left))
                out[left[hit > 0], j] = total[hit > 0] / hit[hit > 0]
            left = left[hit == 0]
        return out

    def find(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.tables[n][0]
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        known = keys[at] == hashes
        return known, at[known]

    def predict(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, -1 for none, and the score."""
        n = len(text)
        best, score = np.full(n, -1), np.zeros(n)
        if not self.languages:
            return best, score
        for lo, _, raw, offsets in shared.slices(text):
            points, at = code_points(raw, offsets)
            starts, ends, rows = _spans(points, at)
            if not len(starts):
                continue
            points = _tables()[1][points]
            uniq, first, back = np.unique(_hashes(points, starts, ends), return_index=True, return_inverse=True)
            each = self.words(points, starts[first], ends[first], uniq)
            sums = np.zeros((len(starts) + 1, len(self.languages)))
            np.cumsum(each[back], axis=0, out=sums[1:], dtype=np.float64)
            count = np.diff(rows)
            some = np.flatnonzero(count)
            total = (sums[rows[1:]] - sums[rows[:-1]])[some] / np.sqrt(count[some])[:, None] + self.prior
            total -= total.max(axis=1, keepdims=True)
            p = np.exp(total)
            p /= p.sum(axis=1, keepdims=True)
            best[lo + some] = p.argmax(axis=1)
            score[lo + some] = p.max(axis=1)
        return best, score


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            counts.update((lang, w) for w in _WORD.findall(text.lower()))
    rows = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([counts[r] for r in rows], pa.int64())], names=["lang", "word", "n"])


def _table(counts: dict[str, Counter], langs: list[str], most: int, least: int) -> tuple[list[str], np.ndarray]:
    """The most frequent entries, and their smoothed log frequencies by language."""
    total = Counter()
    for c in counts.values():
        total.update(c)
    names = [k for k, v in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most] if v >= least]
    out = np.array([[counts[x].get(k, 0) for x in langs] for k in names], float).reshape(-1, len(langs))
    sums = np.array([sum(counts[x].values()) for x in langs], float)
    return names, np.log((out + 0.1) / (sums + 0.1 * (len(total) + 1))).astype(np.float32)


def learn(docs: DataFrame, train: Column, sample_bytes: int = 24 << 20, most: int = 60_000) -> Model:
    rows = docs.where(train & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    size = {r["lang"]: (r["b"], r["n"]) for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(size)
    if not langs:
        return Model([], np.zeros(0), {})
    share = [min(1.0, sample_bytes / len(langs) / max(1, size[x][0])) for x in langs]
    draw = F.lit(False)
    for x, p in zip(langs, share, strict=True):
        draw = draw | ((F.col("lang") == x) & shared.drawn(p, "doc_id"))
    found = rows.where(draw).select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator()
    words: dict[str, Counter] = {x: Counter() for x in langs}
    for r in found:
        words[r["lang"]][r["word"]] = r["n"]
    names, values = _table(words, langs, most, 2)
    tables = {0: _edges(names, values)}
    edge = "\0"
    for n in ORDERS:
        grams: dict[str, Counter] = defaultdict(Counter)
        for x in langs:
            c = grams[x]
            for w in words[x]:
                f = w if n == 1 else f"{edge}{w}{edge}"
                for i in range(len(f) - n + 1):
                    c[f[i : i + n]] += 1
        names, values = _table(grams, langs, most, 2 if n > 1 else 1)
        tables[n] = _edges(names, values)
    prior = np.array([size[x][1] for x in langs], float)
    return Model(langs, np.log(prior / prior.sum()), tables)


def _edges(names: list[str], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the entries and their values. A zero in a name stands for a word's end."""
    if not names:
        return np.zeros(0, np.uint64), values
    points = np.frombuffer("".join(names).encode("utf-32-le"), np.int32).copy()
    points[points == 0] = _EDGE
    ends = np.cumsum([len(x) for x in names]).astype(np.int64)
    h = _hashes(points, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
    order = np.argsort(h)
    return h[order], values[order]


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language and the score in columns of these names, which docs must not have."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # `most` bounds it

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*sent.value.languages, "und"])
        for b in batches:
            best, sure = sent.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[best].tolist(), pa.string()), pa.array(sure)], names=[*b.schema.names, lang, score])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(step, f"{fields}, `{lang}` string, `{score}` double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs, ~shared.in_remainder("doc_id", 4, 2))
    found = predict(docs.select("doc_id", "text", shared.in_remainder("doc_id", 4, 2).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that get a language, however close the next one is, unchanged."""
    cols = docs.columns
    model = learn(docs, ~shared.in_remainder("doc_id", 4, 2))
    found = predict(docs, model, "_w_lang", "_w_score").where(F.col("_w_lang") != "und")
    return shared.only(found, *cols)


def brute_force(train: list[tuple[str, str]], texts: list[str | None], most: int = 60_000) -> list[tuple[str, float]]:
    """The same by dictionaries, for tests: language and score of each text, learned from (text, language)."""
    from math import exp, log, sqrt

    low = lambda w: "".join(c.lower() if len(c.lower()) == 1 else c for c in w)
    langs = sorted({x for _, x in train})
    words = {x: Counter(w for t, y in train if y == x for w in _WORD.findall(t.lower())) for x in langs}
    grams = lambda w, n: [w[i : i + n] for i in range(len(w))] if n == 1 else [f[i : i + n] for f in [f"\0{w}\0"] for i in range(len(f) - n + 1)]
    tables = []
    for n in (0, *ORDERS):
        counts = words if n == 0 else {x: Counter(g for w in words[x] for g in grams(w, n)) for x in langs}
        every = sum(counts.values(), Counter())
        kept = [k for k, v in sorted(every.items(), key=lambda e: (-e[1], e[0]))[:most] if v >= (1 if n == 1 else 2)]
        tables.append({k: [log((counts[x][k] + 0.1) / (sum(counts[x].values()) + 0.1 * (len(every) + 1))) for x in langs] for k in kept})
    prior = [log(sum(y == x for _, y in train) / len(train)) for x in langs]

    def logs(w: str) -> list[float]:
        if w in tables[0]:
            return tables[0][w]
        for n, table in zip(ORDERS, tables[1:], strict=True):
            known = [table[g] for g in grams(w, n) if g in table]
            if known:
                return [sum(k) / len(known) for k in zip(*known, strict=True)]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        found = [logs(low(w)) for w in _WORD.findall(t or "")]
        if not found or not langs:
            out.append(("und", 0.0))
            continue
        total = [sum(x) / sqrt(len(found)) + p for x, p in zip(zip(*found, strict=True), prior, strict=True)]
        share = [exp(x - max(total)) for x in total]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        out.append((langs[best], share[best] / sum(share)))
    return out
