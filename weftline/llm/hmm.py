"""Hidden Markov language model: Baum-Welch over all training texts, scaled forward recursion for scores.

Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end token. The most frequent tokens, at most `most`, are symbols of their own; any other
token emits the symbol of its class, made from its last two bytes, and within the class its own share, (c+1) / (N_class + V_class + 1)
for training count c, the class's tokens N_class and distinct tokens V_class; the one left over is for all unseen tokens. So each state emits a
proper distribution over all tokens, the part that depends on states is bounded by `most`, and the counts of all others stay distributed:
they are joined to the texts' tokens, never collected.

Training: word counts over all training texts; Baum-Welch on a bounded sample (`sample_tokens`) gives a start; from there Baum-Welch over growing shares of
the training texts (SHARES) and then over all of them, whose expected counts each partition sums and the shuffle adds up. A share is left when a round
gains less than `gain` log10 per token over the one before, all texts likewise, after `rounds` at most. There texts are taken in stretches of `STRETCH` tokens, written once as symbols; scores take whole texts.
Which share a text is in is a hash of its id and itself, so neither the order of rows nor how they are dealt to files changes more than the last digits of a score.
Where a share has not settled after `rounds`, a warning says so and the next one goes on from there.
A text's score is the log10 of its exact probability, summed over all state paths.

Null and empty texts are one end token. Repeated rows score alike. With nothing to train on, every token has the probability of an
unseen one. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import contextlib
import logging
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

CLASSES = 256
STRETCH = 512
END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: Shares of the texts, in sixteenths, that Baum-Welch settles on one after another. Early rounds move the model far and need few texts for it.
SHARES = (1, 4, 16)
_BLOCK = 1 << 18  # tokens that Baum-Welch holds at once, about 300 bytes each; scores hold twice as many


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's hash and class, ends included, and each text's first token."""
    low = shared.LOWER[raw]
    starts, ends, rows = shared.word_spans(raw, offsets, shared.IS_DARK)
    h = shared.span_hash(low, starts, ends)
    last = low[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.uint64) if len(ends) else last
    cls = (shared.mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int16)
    n = len(offsets) - 1
    first = rows + np.arange(n + 1)
    out_h, out_c = np.full(first[-1], END, np.uint64), np.zeros(first[-1], np.int16)
    word = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(rows))
    out_h[word], out_c[word] = h, cls
    return out_h, out_c, first


# ---------------------------------------------------------------- counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def merged(parts: list) -> list:
        h, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        return [(uniq, c[first], np.bincount(back, n, len(uniq)).astype(np.int64))]

    def out(part: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1]), pa.array(part[2])], names=["h", "cls", "n"])

    parts, held = [], 0
    for b in batches:
        for _, _, raw, offsets in shared.slices(b.column("text")):
            h, cls, _ = tokens(raw, offsets)
            uniq, first, n = np.unique(h, return_index=True, return_counts=True)
            parts.append((uniq, cls[first], n))
            held += len(uniq)
            if held > 3 << 18:
                parts = merged(parts)
                held = len(parts[0][0])
                if held > 3 << 17:
                    yield out(parts[0])
                    parts, held = [], 0
    if parts:
        yield out(merged(parts)[0])


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, cls, c): the training count of every distinct token."""
    return shared.cut(texts.mapInArrow(_count, "h long, cls short, n long").groupBy("h", "cls").agg(F.sum("n").alias("c")), "counts")


# ---------------------------------------------------------------- model


@dataclass
class Model:
    start: np.ndarray  # of a text
    inner: np.ndarray  # of a later stretch
    move: np.ndarray
    emit: np.ndarray  # symbol, state
    hashes: np.ndarray  # sorted, of the symbols that are tokens
    counts: np.ndarray  # theirs
    share: np.ndarray  # log10(N_class + V_class + 1)
    total: int = 0
    distinct: int = 0
    back: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def symbols(self, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
        k = len(self.hashes)
        if not k:
            return cls.astype(np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), k - 1)
        return np.where(self.hashes[at] == h, at, k + cls.astype(np.int32)).astype(np.int32)


def _by_length(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the sequences by falling length, their starts, and how many are longer than t."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size = size[order]
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    return order, first[:-1][order], live


def forward(model: Model, sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Natural log of each sequence's probability, by the scaled forward recursion; all sequences move a token at a time."""
    order, at, live = _by_length(first)
    out = np.zeros(len(order))
    if not len(live):
        return out
    off = np.concatenate([[0], np.cumsum(live)])
    scales, one = np.empty(off[-1]), np.ones(len(model.start))
    a = np.tile(model.start, (len(order), 1))
    for t, n in enumerate(live):
        a = a[:n] @ model.move if t else a[:n]
        a *= model.emit[sym[at[:n] + t]]
        now = scales[off[t] : off[t + 1]]
        np.matmul(a, one, out=now)
        a /= now[:, None]
    out[order] = np.bincount(np.arange(off[-1]) - np.repeat(off[:-1], live), np.log(scales), len(order))
    return out


def expected(model: Model, sym: np.ndarray, first: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch's expected counts: emissions (symbol, state), moves (state, state), starts (two rows: of texts, of later stretches)."""
    return _expected(model, sym, first, heads)[:3]


def _expected(model: Model, sym: np.ndarray, first: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """As above, and the natural log of the sequences' probability. Works in the precision of the model's emissions."""
    states = len(model.start)
    order, at, live = _by_length(first)
    emits, moves, starts = np.zeros((len(model.emit), states)), np.zeros((states, states)), np.zeros((2, states))
    if not len(live):
        return emits, moves, starts, 0.0
    # token by token of all sequences: those at t are the rows off[t] to off[t + 1]
    off = np.concatenate([[0], np.cumsum(live)])
    who = sym[at[np.arange(off[-1]) - np.repeat(off[:-1], live)] + np.repeat(np.arange(len(live)), live)]
    emit, one, turned = model.emit[who], np.ones(states, model.emit.dtype), np.ascontiguousarray(model.move.T)
    alpha, scales = np.empty_like(emit), np.empty(len(who), emit.dtype)
    for t, n in enumerate(live):
        a, now = alpha[off[t] : off[t + 1]], slice(off[t], off[t + 1])
        if t:
            np.matmul(alpha[off[t - 1] : off[t - 1] + n], model.move, out=a)
        else:
            a[:] = np.where(heads[order][:, None], model.start, model.inner)
        a *= emit[now]
        np.matmul(a, one, out=scales[now])
        a /= scales[now, None]
    # backwards; a step's part of alpha becomes its states' posterior while it is at hand
    beta = np.ones((live[-1], states), emit.dtype)
    for t in range(len(live) - 1, -1, -1):
        now = slice(off[t], off[t + 1])
        a = alpha[now]
        ahead = beta
        if t:
            ahead = emit[now]
            ahead *= beta
            ahead /= scales[now, None]
        a *= beta
        a /= (a @ one)[:, None]
        if t:
            moves += alpha[off[t - 1] : off[t - 1] + live[t]].T @ ahead
            beta = np.ones((live[t - 1], states), emit.dtype)
            np.matmul(ahead, turned, out=beta[: live[t]])
    h = heads[order]
    starts[0], starts[1] = alpha[: live[0]][h].sum(axis=0), alpha[: live[0]][~h].sum(axis=0)
    who = who.astype(np.intp)  # once, not once a state
    for s in range(states):
        emits[:, s] = np.bincount(who, alpha[:, s], len(emits))
    return emits, moves * model.move, starts, float(np.log(scales, dtype=np.float64).sum())


def reestimated(model: Model, emits: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> Model:
    """The next model. Emissions lean on the overall frequencies with the weight of 2000 tokens, so none is zero."""
    emit = emits + 2000 * model.back[:, None]
    put = lambda x: (x + 1) / (x + 1).sum(axis=-1, keepdims=True)
    return Model(put(starts[0]), put(starts.sum(axis=0)), put(moves), emit / emit.sum(axis=0), model.hashes, model.counts, model.share, model.total, model.distinct, model.back)


def _stretches(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut at every STRETCH tokens: the pieces' bounds, and whether a piece begins a text."""
    cuts = np.unique(np.concatenate([first, *(np.arange(a, b, STRETCH) for a, b in zip(first[:-1], first[1:], strict=True) if b - a > STRETCH)]))
    return cuts, np.isin(cuts[:-1], first)


def _fed(model: Model, column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, symbols, first tokens, classes) of runs of rows of about `most` tokens."""
    parts, n, begin = [], 0, 0
    for _, hi, raw, offsets in shared.slices(column):
        h, cls, first = tokens(raw, offsets)
        parts.append((h, cls, first))
        n += len(h)
        if n >= most or hi == len(column):
            h, cls = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            base = np.cumsum([0, *(len(p[0]) for p in parts)])
            first = np.concatenate([*(p[2][:-1] + b for p, b in zip(parts, base, strict=False)), [len(h)]])
            yield begin, hi, h, model.symbols(h, cls), first, cls
            parts, n, begin = [], 0, hi


def _encode(sent):
    """Blocks of texts of one share each. A text's own draw says which shares it is in, not the rows it comes with: how rows are dealt to files changes nothing."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            draws = b.column("draw").to_numpy()
            for low, high in zip((0, *SHARES), SHARES, strict=False):
                own = np.flatnonzero((draws >= low) & (draws < high))
                if not len(own):
                    continue
                for _, _, _, sym, first, _ in _fed(sent.value, b.column("text").take(pa.array(own)), _BLOCK):
                    cuts, heads = _stretches(first)
                    # byte by byte: the upper ones are almost all zero, and compression takes them away
                    cols = [sym.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), cuts.astype("<i8").tobytes(), heads.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([low], pa.int32()), pa.array([len(sym)]), *(pa.array([c], pa.binary()) for c in cols)], names=["draw", "n", "sym", "cuts", "heads"])

    return step


def _expect(sent):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        states = len(model.start)
        total = [np.zeros((len(model.emit), states)), np.zeros((states, states)), np.zeros((2, states)), 0.0]
        for b in batches:
            for r in range(b.num_rows):
                sym, cuts, heads = (b.column(c)[r].as_py() for c in ("sym", "cuts", "heads"))
                sym = np.frombuffer(sym, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
                got = _expected(model, sym, np.frombuffer(cuts, "<i8"), np.frombuffer(heads, bool))
                total = [x + y for x, y in zip(total, got, strict=True)]
        last = np.zeros((1, states))
        last[0, 0] = total[3]
        rows = np.concatenate([*total[:3], last]).astype(np.float32)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(rows[some, s]) for s in range(states))], names=["row", *(f"s{s}" for s in range(states))])

    return step


def _single(model: Model) -> Model:
    """In single precision; the counts that come of it are summed in double."""
    return replace(model, **{x: getattr(model, x).astype(np.float32) for x in ("start", "inner", "move", "emit")})


def _least_count(counts: DataFrame, most: int) -> float:
    """A count that at most `most` tokens reach, from a histogram in steps of a sixteenth of a power of two."""
    step = F.floor(F.log2(F.col("c")) * 16).cast("int")
    room, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["step"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["c"]
    return float("inf") if least is None else least


@contextlib.contextmanager
def _no_shuffle_files(spark: SparkSession):
    """A round's shuffle files go with its query; else the rounds' add up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def train(texts: DataFrame, counts: DataFrame, states: int = 12, most: int = 65_536, sample_tokens: int = 300_000, rounds: int = 40, gain: float = 0.001, seed: int = 7) -> Model:
    spark = texts.sparkSession
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = whole["n"] or 0, whole["v"]
    top = counts.where(F.col("c") >= _least_count(counts, most)).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, c, cls = h[order], top["c"].to_numpy(np.int64)[order], top["cls"].to_numpy(np.int64)[order]
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n_class[r["cls"]], v_class[r["cls"]] = r["n"], r["v"]
    n_class -= np.bincount(cls, c, CLASSES)
    v_class -= np.bincount(cls, minlength=CLASSES)
    back = np.concatenate([c, n_class + 1]).astype(float)
    back /= back.sum()
    rng = np.random.default_rng(seed)
    emit = back[:, None] * np.exp(rng.normal(0, 1, (len(back), states)))
    move = np.eye(states) * 0.8 + 0.2 / states
    even = np.full(states, 1 / states)
    model = Model(even, even, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), h, c, np.log10(n_class + v_class + 1), total, distinct, back)
    if not total:
        return model
    share = min(1.0, sample_tokens / total)
    drawn = texts.where(shared.drawn(share, "doc_id", F.lit(seed))).orderBy("doc_id", F.xxhash64("text"))
    held = pa.array([r["text"] for r in drawn.select(F.coalesce("text", F.lit("")).alias("text")).toLocalIterator()], pa.string())
    for _, _, _, sym, first, _ in _fed(model, held, 1 << 40):
        cuts, heads = _stretches(first)
        for _ in range(20):
            model = reestimated(model, *expected(model, sym, cuts, heads))
    k = len(back)
    cols = ", ".join(f"s{s} float" for s in range(states))
    sent = spark.sparkContext.broadcast(model)  # `most` bounds it
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARES[-1])).cast("int")
    coded = shared.cut(texts.select("text", draw.alias("draw")).mapInArrow(_encode(sent), "draw int, n long, sym binary, cuts binary, heads binary"), "coded")
    sent.unpersist()
    with _no_shuffle_files(spark):
        for share in SHARES:
            part = coded.where(F.col("draw") < share)
            n = total if share == SHARES[-1] else part.agg(F.sum("n")).first()[0]
            if not n:  # few texts: none of them is in the share
                continue
            if share < SHARES[-1]:  # a task sends a row for each symbol, however little it read: a few blocks are one task's
                part = part.coalesce(max(1, n // (8 * _BLOCK)))
            last = gained = -np.inf
            for _ in range(rounds):
                sent = spark.sparkContext.broadcast(_single(model))
                sums = part.select("sym", "cuts", "heads").mapInArrow(_expect(sent), f"row int, {cols}").groupBy("row").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(states))).toPandas()
                rows = np.zeros((k + states + 3, states))
                rows[sums["row"].to_numpy()] = sums[[f"s{s}" for s in range(states)]].to_numpy()
                model = reestimated(model, rows[:k], rows[k : k + states], rows[k + states : k + states + 2])
                sent.unpersist()
                now = rows[-1, 0] / np.log(10) / n
                gained, last = now - last, now
                if gained < gain:
                    break
            else:
                logging.getLogger(__name__).warning("Baum-Welch still gains %.4f log10 a token after %d rounds over %d of %d parts of the texts", gained, rounds, share, SHARES[-1])
    return model


# ---------------------------------------------------------------- scores


def _score(sent):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = len(model.hashes)
        log_c = np.concatenate([np.log10(model.counts + 1), np.zeros(CLASSES)])
        log_share = np.concatenate([np.zeros(k), model.share])
        for b in batches:
            for lo, hi, h, sym, first, _ in _fed(model, b.column("text"), 2 * _BLOCK):
                rare = sym >= k
                at = np.concatenate([[0], np.cumsum(rare)])[first]
                score = forward(model, sym, first) / np.log(10) - np.add.reduceat(log_share[sym], first[:-1])
                cols = [b.column("doc_id").slice(lo, hi - lo), b.column("held_out").slice(lo, hi - lo), b.column("key").slice(lo, hi - lo)]
                cols += [pa.array(np.diff(first)), pa.array(np.diff(at)), pa.array(np.add.reduceat(log_c[sym], first[:-1])), pa.array(score)]
                cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h[rare].view(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "key", "n_tokens", "n_rare", "log_c", "score", "rare"])

    return step


def score_texts(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text, held_out)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keyed = docs.select("doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = shared.cut(keyed.mapInArrow(_score(sent), f"doc_id {kind}, held_out boolean, key long, n_tokens long, n_rare long, log_c double, score double, rare array<long>"), "scored")
    # rows with one id and one text share what is looked up for them
    wanted = scored.where("n_rare > 0").dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.explode("rare").alias("h"))
    found = wanted.join(counts.select("h", "c"), "h", "inner").groupBy("d", "k").agg(F.sum(F.log10(F.col("c") + 1)).alias("log_rare"), F.count(F.lit(1)).alias("known"))
    joined = scored.drop("rare").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    rare = F.coalesce("log_rare", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - F.col("n_rare") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("log_c") + rare - F.col("n_tokens") * F.lit(float(np.log10(model.total + model.distinct + 1)))).alias("base_score"),
        (F.col("score") + rare).alias("score"),
    )


def hmm_scores(docs: DataFrame, held_out: Column, **kw) -> DataFrame:
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    texts = docs.where(~F.col("held_out")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = token_counts(texts)
    return score_texts(docs, train(texts, counts, **kw), counts)


def op6_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return hmm_scores(docs, shared.in_remainder("doc_id", 7, 2))
