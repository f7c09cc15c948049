"""Judges under a token budget, usage and latency, batched ONNX sessions, samples and temperatures."""

import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weftline.functions import exprs as E
from weftline.operators import dataset as D
from weftline.operators import evaluation as V
from weftline.operators import judging
from weftline.operators import typed as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests

# ---------------------------------------------------------------- judges


@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(1, 300))
def test_batches(lengths, budget):
    lengths, at, seen = sorted(lengths), 0, []
    while at < len(lengths):
        end = judging.batches(lengths, budget, at)
        size = (end - at) * lengths[end - 1]
        assert end > at and (size <= budget or end == at + 1)
        assert end == len(lengths) or (end + 1 - at) * lengths[end] > budget  # no batch could have been longer
        seen += range(at, end)
        at = end
    assert seen == list(range(len(lengths)))


class Recording(judging.OverlapJudge):
    """Says in its probabilities how often each row was judged, and refuses two rows that are too large together."""

    def probabilities(self, prompts, letters):
        made = super().probabilities(prompts, letters)
        assert len(prompts) * max(self.lengths(prompts)) <= self.room
        return made


@pytest.mark.parametrize("room", [60, 300, 1 << 40])
def test_each_row_is_judged_once(spark, room):
    rows = [(i, " ".join(["w"] * (i * 7 % 50)) + "\n\nWhich?\n\nA. w\nB. v", 2, "kept") for i in range(200)] + [(200, None, 0, "kept")]
    items = spark.createDataFrame(rows, "i int, prompt string, letters int, tokens_of string").repartition(5)
    got = judging.judged(items, Recording(room), 1000, tasks=3).collect()
    assert sorted(r.i for r in got) == list(range(201)) and got[0].__fields__[:4] == items.columns
    for r in got:
        assert r.tokens == len((r.prompt or "").split()) and r.batch_tokens <= max(room, r.tokens) and (r.batch_tokens <= 1000 or r.batch_rows == 1)
        if r.i < 200:
            assert (r.probabilities[0] > r.probabilities[1]) == (r.i * 7 % 50 > 0) and sum(r.probabilities) == pytest.approx(1)
    if room > 1000:
        assert max(r.batch_rows for r in got) > 10


def test_a_row_that_does_not_fit_raises(spark):
    items = spark.createDataFrame([(0, "w " * 50, 2)], "i int, prompt string, letters int")
    with pytest.raises(Exception, match="out of memory"):
        judging.judged(items, judging.OverlapJudge(10), 1000).collect()


# ---------------------------------------------------------------- usage


def test_usage_and_latency(spark):
    good = '{"state":"one two","questions":{"a":{"type":"choice","instructions":"Which one?","criteria":{"x":"one","y":"two three"}},"b":{"type":"score","instructions":"How?","criteria":["l","m","h"]}}}'
    requests = spark.createDataFrame([(1, good), (2, good), (3, "no json"), (4, '{"state":"s","questions":{"a":{"type":"choice","instructions":" "}}}')], "request_id long, body string")
    engine = T.Engine(T.OverlapScorer(), name="e", orders=2)
    answers, seen = T.metered(T.predict(requests, engine.scorer, orders=2, usage=True))
    rows = answers.collect()
    said = seen.get
    # two orders of: two words of state, two and seven of the questions, three words of options each
    tokens = {("a", 2 * (2 + 2 + 3)), ("b", 2 * (2 + len((T.PREFIX["score"] + "How?").split()) + 3))}
    assert {(r.qid, r.input_tokens) for r in rows if r.error is None} == tokens and said["input_tokens"] == 2 * sum(n for _, n in tokens)
    assert (said["answers"], said["errors"], said["dropped_tokens"]) == (4, 2, 0) and 0 <= said["ms_p50"] <= said["ms_p95"]
    out = {r.request_id: r for r in engine.answer(requests).collect()}
    assert out[1].model == "e" and set(out[1].answers) == {"a", "b"} and out[1].usage.input_tokens == said["input_tokens"] / 2 and out[1].usage.output_tokens == 0 and out[1].latency_ms >= 0
    assert out[3].error and out[3].answers is None and out[3].usage is None and out[4].error
    assert "input_tokens" not in T.predict(requests, engine.scorer).columns


# ---------------------------------------------------------------- ONNX


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _node(op, inputs, output, **attributes):
    made = b"".join(_field(1, i) for i in inputs) + _field(2, output) + _field(4, op)
    for name, v in attributes.items():
        made += _field(5, _field(1, name) + (_field(3, v) + _field(20, 2) if isinstance(v, int) else b"".join(_field(8, x) for x in v) + _field(20, 7)))
    return made


def _value(name, kind, *dims):
    shape = b"".join(_field(1, _field(2, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def sum_graph():
    """A graph whose logit of an option is the sum of its token ids."""
    graph = _field(1, _node("Cast", ["ids"], "x", to=1)) + _field(1, _node("Unsqueeze", ["x"], "y", axes=[2])) + _field(1, _node("MatMul", ["marks", "y"], "z")) + _field(1, _node("Squeeze", ["z"], "logits", axes=[2])) + _field(2, "sum")
    graph += _field(11, _value("ids", 7, "b", "w")) + _field(11, _value("mask", 7, "b", "w")) + _field(11, _value("marks", 1, "b", "o", "w")) + _field(12, _value("logits", 1, "b", "o"))
    return _field(1, 6) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 11))


def pack(state, text, options):
    ids, spans = [len(w) for w in (state + " " + text).split()], []
    for o in options:
        own = [len(w) for w in o.split()]
        spans.append((len(ids), len(ids) + len(own)))
        ids += own
    return ids, spans, len(state) % 3


def test_onnx_in_batches(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    (tmp_path / "sum.onnx").write_bytes(sum_graph())
    rows = [(i, "choice", "s " * (i % 9), "which", [str(k) for k in range(2 + i % 4)], ["a" * (1 + (i + k) % 5) + " bb" for k in range(2 + i % 4)]) for i in range(100)]
    scorer = T.OnnxScorer(f"{tmp_path}/sum.onnx", pack, batch=7)
    runs = []
    direct = scorer.logits([r[2] for r in rows], [r[3] for r in rows], [r[5] for r in rows])
    assert direct == [[float(sum(map(len, o.split()))) for o in r[5]] for r in rows]
    plain = scorer.session.run
    scorer.session = type("S", (), {"run": lambda _, *a: runs.append(1) or plain(*a), "get_inputs": scorer.session.get_inputs})()
    scorer.logits([r[2] for r in rows], [r[3] for r in rows], [r[5] for r in rows])
    assert len(runs) == 15  # of 100 rows, 7 at a time
    fresh = T.OnnxScorer(f"{tmp_path}/sum.onnx", pack, batch=7)
    df = spark.createDataFrame(rows, "item_id int, kind string, state string, text string, ids array<string>, texts array<string>").repartition(3)
    for r in T.score(df, fresh, usage=True).collect():
        want = [float(sum(map(len, o.split()))) for o in r.texts]
        assert max(range(len(want)), key=want.__getitem__) == max(range(len(r.p)), key=r.p.__getitem__) and r.input_tokens == len(pack(r.state, r.text, r.texts)[0])


# ---------------------------------------------------------------- samples and temperatures


@pytest.mark.parametrize("n", [0, 1, 500, 2999, 3000, 5000])
def test_large_samples_are_the_small_ones(spark, n):
    df = spark.range(3000).withColumn("x", F.lit("y")).repartition(4)
    want = {r.id for r in D.sample_n(df, n, "id", 3).collect()}
    made = D.sample_n(df, n, "id", 3, direct=-1)
    assert {r.id for r in made.collect()} == want and made.count() == min(n, 3000)


def _by_whole_grid(df, keys):
    grid = df.select(*keys, "logits", "target", F.explode(F.sequence(F.lit(50), F.lit(500))).alias("t"))
    sums = grid.groupBy(*keys, "t").agg(F.sum(E.soft_ce(E.softmax(F.col("logits"), F.col("t") / F.lit(100.0)), F.col("target"))).alias("ce"))
    return {tuple(r[k] for k in keys): r["b"]["t"] / 100 for r in sums.groupBy(*keys).agg(F.min(F.struct(F.round("ce", 6).alias("ce"), "t")).alias("b")).collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.lists(st.floats(-30, 30), min_size=2, max_size=4), st.integers(0, 3)), min_size=1, max_size=12))
def test_two_grids_find_what_the_whole_one_finds(spark, rows):
    df = spark.createDataFrame([(k, z, [1.0 if i == y % len(z) else 0.0 for i in range(len(z))]) for k, z, y in rows], "kind string, logits array<double>, target array<double>")
    got = {(r["kind"],): r["temperature"] for r in V.fit_temperature(df, ["kind"]).collect()}
    assert got == _by_whole_grid(df, ["kind"])
    assert V.fit_temperature(df).first()["temperature"] == next(iter(_by_whole_grid(df, []).values()))
