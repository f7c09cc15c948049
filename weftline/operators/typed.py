"""Typed questions, option orders, scorers and answers."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import exprs as E

PREFIX = {"choice": "", "noul": K.NOUL_PREFIX, "score": K.SCORE_PREFIX}
QUESTION = "struct<type:string,text:string,ids:array<string>,texts:array<string>,error:string>"


def question(spec: object) -> dict:
    """EV-2, EV-8: a question as (type, text, ids, texts), or its error."""

    def fail(why: str) -> dict:
        return {"type": None, "text": None, "ids": None, "texts": None, "error": why}

    if not isinstance(spec, dict):
        return fail("question must be an object")
    kind = spec.get("type", "choice")
    kind = kind.strip().lower() if isinstance(kind, str) else None
    if kind not in PREFIX:
        return fail("question type must be choice, noul or score")
    text, options = spec.get("instructions"), spec.get("criteria")
    if not isinstance(text, str) or not text.strip():
        return fail("question needs non-empty instructions")
    if kind == "score":
        if not isinstance(options, list) or not 2 <= len(options) <= 10:
            return fail("score criteria must be a list of 2-10 levels")
        options = {str(i): x for i, x in enumerate(options)}
    elif kind == "noul":
        options = K.NOUL_DEFAULT if options is None else options
        if not isinstance(options, dict) or set(options) != {"false", "true"}:
            return fail("noul criteria must have exactly false and true")
        options = {k: options[k] for k in ("false", "true")}
    elif not isinstance(options, dict) or not 2 <= len(options) <= 255:
        return fail("choice criteria must be an object with 2-255 options")
    if any(not isinstance(x, str) or not x.strip() for x in options.values()):
        return fail("options need non-empty descriptions")
    return {"type": kind, "text": PREFIX[kind] + text, "ids": [str(k) for k in options], "texts": list(options.values()), "error": None}


def expand_requests(requests: DataFrame, max_state: int = 50_000, max_questions: int = 64) -> DataFrame:
    """A row for each question of requests(request_id, body JSON): request_id, qid, state, q. A bad request gives one row with an error."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, body in zip(b["request_id"], b["body"], strict=True):
                try:
                    r = json.loads(body or "")
                    if not isinstance(r, dict) or not isinstance(r.get("questions"), dict) or not 1 <= len(r["questions"]) <= max_questions:
                        raise ValueError("request needs an object of 1-64 questions")
                    state = r.get("state")
                    state = state if isinstance(state, str) else json.dumps(state, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
                    if len(state) > max_state:
                        raise ValueError("state is too long")
                    rows += [(rid, k, state, question(v)) for k, v in r["questions"].items()]
                except ValueError as why:
                    rows.append((rid, None, None, {"type": None, "text": None, "ids": None, "texts": None, "error": str(why)}))
            yield pd.DataFrame(rows, columns=["request_id", "qid", "state", "q"])

    return requests.select("request_id", "body").mapInPandas(step, f"request_id long, qid string, state string, q {QUESTION}")


class Scorer(Protocol):
    """The one extension point: logits for each option of each row."""

    def logits(self, state: list[str], text: list[str], options: list[list[str]]) -> list[list[float]]: ...

    def tokens(self, state: list[str], text: list[str], options: list[list[str]]) -> list[tuple[int, int]]:
        """Each row's input tokens and how many were dropped to fit; only asked for where usage is wanted."""


class OverlapScorer:
    """A deterministic stand-in without weights: shared words of state and option, and a bias for the first place. No claim of quality."""

    def __init__(self, bias: float = 0.0) -> None:
        self.bias = bias

    def logits(self, state, text, options):
        out = []
        for s, o in zip(state, options, strict=True):
            words = set(s.lower().split())
            out.append([len(words & set(x.lower().split())) * 0.5 + self.bias * (i == 0) for i, x in enumerate(o)])
        return out

    def tokens(self, state, text, options):
        """Words stand for tokens; none is dropped."""
        return [(len(s.split()) + len(t.split()) + sum(len(x.split()) for x in o), 0) for s, t, o in zip(state, text, options, strict=True)]


class OnnxScorer:
    """Scores packed rows with an ONNX session, one for each Python worker. Needs a model file that all workers can read.

    `pack` makes a row's (ids, spans of its options, number of dropped tokens) of its state, text and options. Rows are run `batch` at a time, the longest together, as the arrays
    that `batch_arrays` makes of them, under the names of the graph's inputs in its order; the first output has a row of logits for each.
    """

    def __init__(self, model: str, pack: Callable, threads: int = 1, batch: int = 16, pad: int = 0, shared: bool = False) -> None:
        self.model, self.pack, self.threads, self.batch, self.pad, self.shared, self.session = model, pack, threads, batch, pad, shared, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"session": None}  # a session stays with its worker

    def tokens(self, state, text, options):
        return [(len(ids), dropped) for ids, _, dropped in map(self.pack, state, text, options)]

    def logits(self, state, text, options):
        if self.session is None:
            import onnxruntime as ort

            o = ort.SessionOptions()
            o.intra_op_num_threads = self.threads
            self.session = ort.InferenceSession(self.model, o, providers=["CPUExecutionProvider"])
        packed = [self.pack(*row)[:2] for row in zip(state, text, options, strict=True)]
        order = sorted(range(len(packed)), key=lambda i: len(packed[i][0]))
        out: list = [None] * len(packed)
        names = [i.name for i in self.session.get_inputs()]
        for at in range(0, len(order), self.batch):
            rows = order[at : at + self.batch]
            found = self.session.run(None, dict(zip(names, batch_arrays([packed[i] for i in rows], self.pad, self.shared), strict=True)))[0]
            for i, logits in zip(rows, found, strict=True):
                out[i] = [float(x) for x in logits[: len(packed[i][1])]]
        return out


def batch_arrays(packed: list[tuple[list[int], list[tuple[int, int]]]], pad: int, shared: bool = False) -> tuple:
    """SC-3: packed rows (ids, spans of their options) as arrays for a model: ids and mask (row, place), spans (row, option, place), and with
    `shared` positions that start every option right after the prefix."""
    width, most = max(len(ids) for ids, _ in packed), max(len(spans) for _, spans in packed)
    ids, mask = np.full((len(packed), width), pad, np.int64), np.zeros((len(packed), width), np.int64)
    marks, places = np.zeros((len(packed), most, width), np.float32), np.zeros((len(packed), width), np.int64)
    at = np.arange(width)
    for row, (given, spans) in enumerate(packed):
        ids[row, : len(given)] = given
        mask[row] = at < len(given)
        begins, ends = (np.array(x)[:, None] for x in zip(*spans, strict=True))
        marks[row, : len(spans)] = (begins <= at) & (at < ends)
        # a place in an option counts from the first option's begin
        since = np.where(at >= begins, begins, 0).max(axis=0)
        places[row] = np.where(mask[row] > 0, np.where(at >= begins[0], at - since + begins[0], at), 0)
    return (ids, mask, marks, places) if shared else (ids, mask, marks)


def _offsets(count: int, orders: int) -> list[int]:
    m = min(count, orders)
    return [i * count // m for i in range(m)]


def mean_probabilities(scorer: Scorer, state: list[str], text: list[str], options: list[list[str]], temperature: list[float], orders: int) -> list[list[float]]:
    """SC-4 for a batch: the mean over rotated option orders of the options' probabilities. One call of the scorer for each order."""
    turns = [_offsets(len(o), orders) for o in options]
    sums = [np.zeros(len(o)) for o in options]
    for k in range(max(map(len, turns), default=0)):
        rows = [r for r, t in enumerate(turns) if k < len(t)]
        shown = [[*options[r][turns[r][k] :], *options[r][: turns[r][k]]] for r in rows]
        for r, logits in zip(rows, scorer.logits([state[r] for r in rows], [text[r] for r in rows], shown), strict=True):
            x = np.asarray(logits, float) / temperature[r]
            p = np.exp(x - x.max())
            sums[r] += np.roll(p / p.sum(), turns[r][k])
    return [(s / len(t)).tolist() for s, t in zip(sums, turns, strict=True)]


def _used(scorer: Scorer, state: list[str], text: list[str], options: list[list[str]], orders: int) -> list[tuple[int, int]]:
    """Each row's input and dropped tokens, over all the option orders it is shown in."""
    per_order = scorer.tokens(state, text, options)
    times = [len(_offsets(len(o), orders)) for o in options]
    return [(n * k, d * k) for (n, d), k in zip(per_order, times, strict=True)]


def score(items: DataFrame, scorer: Scorer, *, orders: int = 1, temperature: dict[str, float] | float = 1.0, usage: bool = False) -> DataFrame:
    """SC-4: adds p, the mean over rotated option orders of the options' probabilities, to items(item_id, kind, state, text, ids, texts). No shuffle.

    With `usage` also input_tokens and dropped_tokens, and ms, a row's share of its batch's time.
    """
    if orders < 1:
        raise ValueError("orders must be at least 1")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                kinds, state, text, texts = (b.column(c).to_pylist() for c in ("kind", "state", "text", "texts"))
                t = [temperature.get(k, 1.0) if isinstance(temperature, dict) else float(temperature) for k in kinds]
                began = time.perf_counter()
                p = mean_probabilities(scorer, state, text, texts, t, orders)
                cols, names = [pa.array(p, pa.list_(pa.float64()))], ["p"]
                if usage:
                    ms = (time.perf_counter() - began) * 1000 / max(1, b.num_rows)
                    used = _used(scorer, state, text, texts, orders)
                    cols += [pa.array([u[0] for u in used], pa.int64()), pa.array([u[1] for u in used], pa.int64()), pa.array([ms] * b.num_rows)]
                    names += ["input_tokens", "dropped_tokens", "ms"]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    return items.mapInArrow(step, f"{fields}, p array<double>" + ", input_tokens long, dropped_tokens long, ms double" * usage)


USAGE = ("input_tokens", "dropped_tokens", "ms")


def predict(requests: DataFrame, scorer: Scorer, *, orders: int = 1, temperature: dict[str, float] | float = 1.0, abstain_below: float | None = None, usage: bool = False) -> DataFrame:
    """SC-5: (request_id, qid, answer, error) for each question of requests(request_id, body); with `usage` also its tokens and milliseconds."""
    rows = expand_requests(requests)
    good = rows.where(F.col("q.error").isNull()).select(F.struct("request_id", "qid").alias("item_id"), F.col("q.type").alias("kind"), "state", F.col("q.text").alias("text"), F.col("q.ids").alias("ids"), F.col("q.texts").alias("texts"))
    done = score(good, scorer, orders=orders, temperature=temperature, usage=usage)
    extra = USAGE if usage else ()
    answers = done.select("item_id.request_id", "item_id.qid", E.answer(F.col("kind"), F.col("ids"), F.col("texts"), F.col("p"), abstain_below).alias("answer"), F.lit(None).cast("string").alias("error"), *extra)
    bad = rows.where(F.col("q.error").isNotNull()).select("request_id", "qid", F.col("q.error").alias("error"))
    return answers.unionByName(bad, allowMissingColumns=True)


def metered(answers: DataFrame, name: str = "usage") -> tuple[DataFrame, Observation]:
    """AG-23: answers with usage, and what is observed while they are written or collected: no second pass. Once an action ran, `.get` has the numbers of answers and
    errors, the tokens, and the p50 and p95 of milliseconds an answer (p50 and p95 within a ten-thousandth of the ranks)."""
    seen = Observation(name)
    ms = F.percentile_approx("ms", F.array(F.lit(0.5), F.lit(0.95)), F.lit(10_000))
    totals = [F.count_if(F.col("error").isNull()).alias("answers"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("dropped_tokens"), F.lit(0)).alias("dropped_tokens"), ms[0].alias("ms_p50"), ms[1].alias("ms_p95")]
    return answers.observe(seen, *totals), seen


def by_request(answers: DataFrame, name: str = "engine") -> DataFrame:
    """SC-5: one row for each request: the model's name, its answers by question, its usage and its latency, the sum of its questions' milliseconds.

    A request with an invalid question has `error`, the least of its questions' errors, and no answers. A request has at most 64 questions, so a group is small.
    """
    grouped = answers.groupBy("request_id").agg(
        F.min("error").alias("error"),
        F.map_from_entries(F.collect_list(F.when(F.col("answer").isNotNull(), F.struct("qid", "answer")))).alias("answers"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("dropped_tokens").alias("dropped_tokens"),
        F.round(F.sum("ms"), 2).alias("latency_ms"),
    )
    fine = F.col("error").isNull()
    usage = F.struct("input_tokens", F.lit(0).cast("long").alias("output_tokens"), "dropped_tokens")
    return grouped.select("request_id", F.lit(name).alias("model"), F.when(fine, F.col("answers")).alias("answers"), F.when(fine, usage).alias("usage"), F.when(fine, F.col("latency_ms")).alias("latency_ms"), "error")


@dataclass(frozen=True)
class Engine:
    """A scorer with its settings (HX-5): orders averaged over, temperatures, the bound to abstain below."""

    scorer: Scorer
    name: str = "engine"
    orders: int = 1
    temperature: float = 1.0
    temperature_by_type: dict[str, float] = field(default_factory=dict)
    abstain_below: float | None = None

    def __post_init__(self) -> None:
        if self.orders < 1:
            raise ValueError("orders must be at least 1")
        for t in (self.temperature, *self.temperature_by_type.values()):
            if not (0 < t < float("inf")):
                raise ValueError("temperature must be positive")

    @classmethod
    def load(cls, spark: SparkSession, path: str, scorer: Scorer, **changed) -> Engine:
        """Settings from a JSON file on any store Spark reads (SC-6); the scorer brings its own weights."""
        found = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))  # one small file of settings
        known = {k: found[k] for k in ("name", "orders", "temperature", "temperature_by_type", "abstain_below") if found.get(k) is not None}
        return cls(scorer, **(known | changed))

    def predict(self, requests: DataFrame) -> DataFrame:
        temperatures = {k: self.temperature_by_type.get(k, self.temperature) for k in PREFIX}
        return predict(requests, self.scorer, orders=self.orders, temperature=temperatures, abstain_below=self.abstain_below)

    def answer(self, requests: DataFrame) -> DataFrame:
        """A row for each request, with usage and latency."""
        temperatures = {k: self.temperature_by_type.get(k, self.temperature) for k in PREFIX}
        return by_request(predict(requests, self.scorer, orders=self.orders, temperature=temperatures, abstain_below=self.abstain_below, usage=True), self.name)


def benchmark_rows(cases: DataFrame, types: tuple[str, ...] = ("choice",)) -> DataFrame:
    """DS-9: decision rows of cases(id, workflow, state, questions, gold), the last three JSON text."""
    spec = "map<string,struct<type:string,instructions:string,criteria:string>>"
    q = cases.select("id", "workflow", "state", F.from_json("gold", "map<string,struct<probabilities:map<string,double>>>").alias("gold"), F.explode(F.map_entries(F.from_json("questions", spec))).alias("q"))
    q = q.where(F.col("q.value.type").isin(*types) & F.map_contains_key("gold", F.col("q.key")))
    kind, raw = F.col("q.value.type"), F.col("q.value.criteria")
    levels = F.from_json(raw, "array<string>")
    score_options = F.transform(levels, lambda x, i: F.struct(i.cast("string").alias("id"), x.alias("text")))
    given = F.coalesce(raw, F.when(kind == "noul", F.lit(json.dumps(K.NOUL_DEFAULT))))
    options = F.when((kind == "score") & levels.isNotNull(), score_options).otherwise(F.transform(F.map_entries(F.from_json(given, "map<string,string>")), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("text"))))
    rows = q.withColumn("candidates", options).withColumn("p", F.try_element_at("gold", F.col("q.key"))["probabilities"])
    target = F.transform("candidates", lambda c: F.try_element_at(F.col("p"), c["id"]))
    rows = rows.withColumn("target", target)
    total = E.total(F.col("target"))
    fine = (F.size("candidates") >= 2) & ~F.exists("target", lambda t: t.isNull() | (t < 0)) & (total > 0)
    prefix = F.when(kind == "noul", K.NOUL_PREFIX).when(kind == "score", K.SCORE_PREFIX).otherwise("")
    return rows.select(
        F.concat("id", F.lit("::"), "q.key").alias("case_id"),
        F.concat("workflow", F.lit("::"), "id").alias("source_group"),
        "workflow",
        "state",
        F.concat(prefix, "q.value.instructions").alias("question"),
        "candidates",
        F.when(fine, F.transform("target", lambda t: t / total)).otherwise(F.raise_error(F.concat(F.lit("invalid gold distribution in "), "id", F.lit(":"), "q.key")).cast("array<double>")).alias("target"),
        F.nullif(kind, F.lit("choice")).alias("question_type"),
    )


# ---------------------------------------------------------------- packing of token ids


def packed(question, state, options, *, cls: int, sep: int, max_tokens: int = 512):
    """SC-1 on arrays of ids: (ids, state tokens, dropped) with the state cut in its middle; null ids if fewer than 32 state tokens fit."""
    schema = F.lit(3) + F.size(question) + F.aggregate(options, F.lit(0), lambda a, o: a + F.size(o) + 1)
    budget = F.lit(max_tokens) - schema
    left = F.floor((budget + 1) / 2).cast("int")
    right = budget - left
    cut = F.concat(F.slice(state, F.lit(1), left), F.slice(state, F.size(state) - right + 1, right))
    kept = F.when(F.size(state) > budget, cut).otherwise(state)
    tail = F.flatten(F.transform(options, lambda o: F.concat(o, F.array(F.lit(sep)))))
    ids = F.concat(F.array(F.lit(cls)), question, F.array(F.lit(sep)), kept, F.array(F.lit(sep)), tail)
    return F.when(budget >= 32, F.struct(ids.alias("ids"), F.size(state).alias("state_tokens"), F.greatest(F.size(state) - budget, F.lit(0)).alias("state_tokens_dropped")))


def shared_positions(prefix, sizes):
    """SC-2: positions that start every option, of the given sizes and a separator, right after the prefix."""
    options = F.flatten(F.transform(sizes, lambda n: F.sequence(prefix, prefix + n)))
    return F.concat(F.sequence(F.lit(0), prefix - 1), options)
