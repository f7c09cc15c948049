"""Each query over hard small tables against brute force, and over empty ones."""

import hashlib
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, graph, hmm, jaccard, langid, registry, shard, shared, suffixes, toxic


def crc(doc_id):
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode())


def run(spark, tables, prefix, kind="full"):
    name = next(n for n in registry.QUERIES if n.startswith(prefix))
    return [r.asDict() for r in registry.QUERIES[name](spark, tables[kind]).collect()]


@pytest.mark.parametrize("name", [*registry.QUERIES])
def test_empty_tables(spark, tables, name):
    rows = registry.QUERIES[name](spark, tables["empty"]).collect()
    assert len(rows) == (1 if name.startswith("op1_") else 0)


def test_pipeline_of_nothing(spark, tables):
    assert corpus_pipeline.run(spark, tables["empty"]).count() == 0


def test_language_id(spark, tables):
    got = run(spark, tables, "op2_")
    assert len(got) == len(tables["docs"])
    truth = {d: (t, lang) for d, t, lang, *_ in tables["docs"]}
    for r in got:
        text, lang = truth[r["doc_id"]]
        assert r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", text or ""))
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]][1] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]][1] for r in held]) > 0.95


def test_language_id_against_brute_force(spark, tables):
    got = {}
    for r in run(spark, tables, "op2_"):
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    learn = [(t, x) for d, t, x, *_ in tables["docs"] if crc(d) % 4 != 2 and t is not None and x is not None]
    some = [(d, t) for d, t, *_ in tables["docs"] if d is None or d >= 300 or d % 9 == 0]
    for (d, _), (lang, score) in zip(some, langid.brute_force(learn, [t for _, t in some]), strict=True):
        assert any(x == lang and abs(y - score) < 1e-3 for x, y in got[d]), (d, lang, score, got[d])


def test_unseen_words_fall_back_to_ngrams(spark, tables):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    model = langid.learn(docs.select("doc_id", "text", "lang"), ~shared.in_remainder("doc_id", 4, 2))
    q = spark.createDataFrame([(1, "keitenkeiten schaftungen"), (2, "ménageménage toujoursoù"), (3, "Zwischenöfter"), (4, "ß")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(q, model).collect()}
    assert got[1] == "de" and got[2] == "fr" and got[3] == "de" and got[4] in ("de", "en", "fr")


def test_pipeline_keeps_documents_of_unsure_language(spark, tmp_path):
    """A word that four languages share leaves each with a quarter of the posterior: a language is named, and the document stays."""
    rows = [(10 * i + k, f"shared {x}word shared", x) for i in range(12) for k, x in enumerate(("de", "en", "es", "fr"))]
    docs = spark.createDataFrame([*rows, (900, "shared", "en"), (901, "123", "en")], "doc_id long, text string, lang string")
    model = langid.learn(docs, ~shared.in_remainder("doc_id", 4, 2))
    r = langid.predict(docs.where("doc_id = 900"), model).first()
    assert r.lang_pred != "und" and r.score < 0.5
    kept = {r.doc_id for r in langid.keep_identified(spark, docs, str(tmp_path)).collect()}
    assert 900 in kept and 901 not in kept


def test_jaccard_join(spark, tables):
    got = run(spark, tables, "op4_")
    assert len(got) == len(tables["docs"])
    distinct = {d: t for d, t, *_ in tables["docs"] if d is not None}
    want = {d: (c, n, g) for d, c, n, g in jaccard.brute_force(list(distinct.items()))}
    times = Counter(d for d, *_ in tables["docs"])
    for r in got:
        if r["doc_id"] is None:
            continue
        c, n, g = want[r["doc_id"]]
        assert (r["class_id"], r["group_id"]) == (c, g), r
        if times[r["doc_id"]] == 1 and r["doc_id"] != 301:
            assert r["n_links"] == n
    assert want[300][2] == 107 and next(r for r in got if r["doc_id"] == 301)["n_links"] == 3  # copies count


def test_many_near_copies_in_tiles(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 120, 2):
            w[k] = f"v{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(d, n, g) for d, _, n, g in jaccard.brute_force(rows)]
    for tile in (16, 1024):
        got = sorted((r.doc_id, r.n_links, r.group_id) for r in jaccard.similar(df, tile=tile).collect())
        assert got == want


def test_documents_that_polynomials_cannot_tell_apart_are_no_copies(spark):
    """Thue-Morse sequences of words, and of letters in one word, collide under every polynomial modulo a power of two."""
    tm = lambda n, a, b, sep: sep.join(b if i.bit_count() & 1 else a for i in range(n))
    rows = [(1, tm(1024, "a", "b", " ")), (2, tm(1024, "b", "a", " ")), (3, tm(1024, "a", "b", "")), (4, tm(1024, "b", "a", ""))]
    got = {r.doc_id: (r.class_id, r.n_links, r.group_id) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (c, n, g) for d, c, n, g in jaccard.brute_force(rows)} and {c for c, _, _ in got.values()} == {1, 2, 3, 4}


def test_span_hashes():
    rng = np.random.default_rng(6)
    raw = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3000, 3000)
    ends = starts + rng.choice([0, 1, 5, 7, 8, 9, 16, 17, 40, 255, 256, 257, 700], 3000)
    h = shared.span_hash(raw, starts, ends)
    by = {}
    for a, b, x in zip(starts, ends, h.tolist(), strict=True):
        assert by.setdefault(raw[a:b].tobytes(), x) == x
    assert len(set(by.values())) == len(by)
    same = shared.same_spans(raw, starts[:-1], (ends - starts)[:-1], np.concatenate([raw, np.zeros(1000, np.uint8)]), starts[1:])
    assert same.tolist() == [raw[a:b].tobytes() == raw[c : c + b - a].tobytes() for a, b, c in zip(starts[:-1], ends[:-1], starts[1:], strict=True)]


def test_least_matches_is_the_posterior():
    least = jaccard.least_matches(0.8, 1e-3)
    x = np.linspace(0, 1, 200_001)
    for n, m in least.items():
        for k in (m - 1, m):
            if k >= 0:
                d = x**k * (1 - x) ** (n - k)
                assert (d[x >= 0.8].sum() / d.sum() >= 1e-3) == (k >= m)


def test_hmm(spark, tables):
    got = run(spark, tables, "op6_")
    assert len(got) == len(tables["docs"])
    toks = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [None]
    count = Counter()
    for d, t, *_ in tables["docs"]:
        if crc(d) % 7 != 2:
            count.update(toks(t))
    total, v = sum(count.values()), len(count)
    by = {}
    for d, t, *_ in tables["docs"]:
        by.setdefault(d, []).append((len(toks(t)), sum(count[w] > 0 for w in toks(t)), sum(math.log10((count[w] + 1) / (total + v + 1)) for w in toks(t))))
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"]) % 7 == 2) and r["train_tokens"] == total
        assert any(r["n_tokens"] == n and r["n_known"] == k and abs(r["base_score"] - b) < 1e-6 * max(1, abs(b)) for n, k, b in by[r["doc_id"]])
        assert math.isfinite(r["score"]) and r["score"] < 0


def _brute_scores(model, counts, rows):
    """Each text's log10 probability, token by token in logs, from the model and a dictionary of counts."""
    out = []
    add = lambda x: max(x) + math.log(sum(math.exp(v - max(x)) for v in x)) if max(x) > -math.inf else -math.inf
    k = len(model.hashes)
    for text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h, cls, _ = hmm.tokens(raw, np.array([0, len(raw)]))
        state, rare = None, 0.0
        for x, sym in zip(h.tolist(), model.symbols(h, cls).tolist(), strict=True):
            if sym >= k:
                rare += math.log10(counts.get(x, 0) + 1) - model.share[sym - k]
            emit = [math.log(v) for v in model.emit[sym]]
            prior = [math.log(v) for v in model.start] if state is None else [add([state[i] + math.log(model.move[i, j]) for i in range(len(emit))]) for j in range(len(emit))]
            state = [p + e for p, e in zip(prior, emit, strict=True)]
        out.append(add(state) / math.log(10) + rare)
    return out


def test_hmm_scores_are_the_forward_sums(spark, tables):
    """The query's own scores, and those of a model with few symbols, against a plain recursion; held out they beat the base."""
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet").select("doc_id", "text")
    held = shared.in_remainder("doc_id", 7, 2)
    texts = docs.where(~held).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = hmm.token_counts(texts)
    by_hash = {r.h & (2**64 - 1): r.c for r in counts.collect()}
    some = [(d, t) for d, t, *_ in tables["docs"] if d is not None and d < 308 and len(t or "") < 20_000]
    for most, got in ((65_536, run(spark, tables, "op6_")), (40, [r.asDict() for r in hmm.hmm_scores(docs, held, most=40).collect()])):
        model = hmm.train(texts, counts, most=most)
        have = {}
        for r in got:
            have.setdefault(r["doc_id"], []).append(r["score"])
        for (d, _), want in zip(some[::7], _brute_scores(model, by_hash, [t for _, t in some[::7]]), strict=True):
            assert any(abs(x - want) < 1e-4 * max(1, abs(want)) for x in have[d]), (d, want, have[d])
        out = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_forward_sums_all_paths():
    rng = np.random.default_rng(1)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    move, start, emit = norm(rng.random((3, 3))), norm(rng.random(3)), norm(rng.random((3, 4))).T
    m = hmm.Model(start, start, move, emit, np.zeros(0, np.uint64), np.zeros(0), np.zeros(1))
    seqs = [[0, 1, 2, 3], [3], [1, 1]]
    got = hmm.forward(m, np.array(sum(seqs, []), np.int32), np.cumsum([0, *map(len, seqs)]))

    def brute(seq, s, t=0):
        p = emit[seq[t], s]
        return p * (1 if t + 1 == len(seq) else sum(move[s, n] * brute(seq, n, t + 1) for n in range(3)))

    assert np.allclose(got, [math.log(sum(start[s] * brute(q, s) for s in range(3))) for q in seqs])
    # a step of Baum-Welch never lowers the likelihood
    m.back = np.full(4, 1e-9)
    sym, first = rng.integers(0, 4, 400).astype(np.int32), np.arange(0, 401, 20)
    last = -np.inf
    for _ in range(6):
        e, mv, st = hmm.expected(m, sym, first, np.ones(20, bool))
        assert np.isclose(e.sum(), 400) and np.isclose(mv.sum(), 380)
        now = hmm.forward(m, sym, first).sum()
        assert now >= last - 1e-6
        last = now
        emit = e + 1e-12
        m = hmm.Model(norm(st[0] + 1e-12), norm(st[0] + 1e-12), norm(mv + 1e-12), emit / emit.sum(axis=0), m.hashes, m.counts, m.share, back=m.back)


def test_states_are_learned_from_all_texts(spark):
    """A start from a twentieth of the texts ends where a start from all of them ends: at a round over all texts that gains next to nothing."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(800):
        topic = rng.integers(0, 3)
        words = []
        for _ in range(100):
            topic = topic if rng.random() < 0.95 else rng.integers(0, 3)
            words.append(f"w{topic}x{int(3000 * rng.random() ** 2)}")
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = hmm.token_counts(df).cache()

    def mean(**kw):
        model = hmm.train(df, counts, states=3, most=10_000, **kw)
        r = hmm.score_texts(df.withColumn("held_out", F.lit(False)), model, counts).agg(F.sum("score"), F.sum("n_tokens")).first()
        return r[0] / r[1]

    assert abs(mean(sample_tokens=4000) - mean(sample_tokens=10**9)) < 0.01


def test_toxicity(spark, tables):
    got = run(spark, tables, "op7_")
    assert len(got) == len(tables["docs"])
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 12 == 5) for r in held]) > 0.95


def test_toxicity_against_brute_force(spark, tables):
    """Every text's score from the model's words, patterns and weights by plain loops; hard texts beside each other."""
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{tables['full']}/labels.parquet").select("doc_id", "toxic")
    held = shared.in_remainder("doc_id", 5, 0)
    model = toxic.train(docs, labels, ~held)
    got = {}
    for r in run(spark, tables, "op7_"):
        got.setdefault(r["doc_id"], []).append(r["score"])
    for d, t, *_ in tables["docs"]:
        want = toxic.brute_force(model, t)
        assert any(abs(x - want) < 1e-6 for x in got[d]), (d, want, got[d])
    hard = ["YOU IDIOT!! YOU SCUM!! " * 3, "!", "!you moron", "", "a a a a a b", "IDIOT you", "idiot one two three you", "scum!", "!!", None, "ÄÖÜ idiots moronic losers scummy"]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string").coalesce(1).withColumn("held_out", F.lit(False))
    for r in toxic.score(df, model).collect():
        assert abs(r.score - toxic.brute_force(model, hard[r.doc_id])) < 1e-6, hard[r.doc_id]


def _repeated(texts, width=200):
    """Removed bytes, spans and digests by a dictionary of windows, fast enough for long texts."""
    seen, out = Counter(), []
    for t in texts:
        seen.update(hash(t[s : s + width]) for s in range(len(t) - width + 1))
    for t in texts:
        edge = np.zeros(len(t) + 1, int)
        for s in range(len(t) - width + 1):
            if seen[hash(t[s : s + width])] > 1:
                edge[s] += 1
                edge[s + width] -= 1
        c = np.cumsum(edge)[:-1] > 0
        out.append((int(c.sum()), int((np.diff(c.astype(int), prepend=0) == 1).sum()), np.frombuffer(t, np.uint8)[~c].tobytes()))
    return out


def test_suffix_dedup(spark, tables):
    got = run(spark, tables, "op8_")
    texts = [(t or "").encode() for _, t, *_ in tables["docs"]]
    short = [t if len(t) < 20_000 else b"" for t in texts]
    assert _repeated(short) == suffixes.brute_force(short)
    want = Counter((d, len(t), removed, spans, hashlib.sha256(left).hexdigest()) for (d, *_), t, (removed, spans, left) in zip(tables["docs"], texts, _repeated(texts), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    x = next(r for r in got if r["doc_id"] == 307)  # one long run: every window repeats within the text
    assert x["n_removed"] == 300_000 and x["n_spans"] == 1


def test_suffix_dedup_is_the_runs_and_their_merge(spark, monkeypatch):
    """Copies that never meet in one run: with the merge's output emptied nothing is removed."""
    rng = np.random.default_rng(7)
    line = bytes(rng.integers(97, 123, 900)).decode()
    rows = [(i, bytes(rng.integers(97, 123, 300 + i)).decode() + line) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    take = lambda: {r.doc_id: r._w_n_removed for r in suffixes.remove_repeats(df, held=1, keep_text=False).collect()}
    assert take() == {i: w[0] for i, w in enumerate(suffixes.brute_force([t.encode() for _, t in rows]))} and take()[0] >= 900
    monkeypatch.setattr(suffixes, "_merged", lambda width: lambda batches: (b.slice(0, 0).select([]) for b in batches if False))
    assert set(take().values()) == {0}


def test_anchors_do_not_depend_on_blocks():
    rng = np.random.default_rng(11)
    raw, offsets = rng.integers(97, 99, 5000).astype(np.uint8), np.array([0, 700, 700, 850, 1200, 5000])
    whole = suffixes.anchors(raw, offsets)
    for block in (150, 333, 1000):
        part = suffixes.anchors(raw, offsets, block=block)
        assert all((whole[c] == part[c]).all() for c in whole)


def test_united_spans():
    rng = np.random.default_rng(12)
    rid, start = rng.integers(0, 5, 300), rng.integers(0, 900, 300)
    end = start + rng.integers(1, 12, 300)
    want = {r: set() for r in range(5)}
    for r, s, e in zip(rid, start, end, strict=True):
        want[r] |= set(range(s, e))
    got = {r: set() for r in range(5)}
    rows = list(zip(*(x.tolist() for x in suffixes.united(rid, start, end)), strict=True))
    for r, s, e in rows:
        assert not got[r] & set(range(s, e))
        got[r] |= set(range(s, e))
    assert got == want and all(a[0] != b[0] or a[2] < b[1] for a, b in zip(rows, rows[1:], strict=False))


def test_suffix_dedup_of_hot_contexts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    line = bytes(rng.integers(97, 123, 260)).decode()
    rows = [(i, bytes(rng.integers(97, 123, 80)).decode() + line[: 180 + i] + bytes(rng.integers(97, 123, 60)).decode() + "é") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: (*w[:2], hashlib.sha256(w[2]).hexdigest()) for (i, _), w in zip(rows, suffixes.brute_force([t.encode() for _, t in rows]), strict=True)}
    deal, levels = suffixes._dealt, []
    monkeypatch.setattr(suffixes, "_dealt", lambda width, k, level, n: levels.append(level) or deal(width, k, level, n))
    for hot in (5, 40, 100_000):
        got = {r.doc_id: (r._w_n_removed, r._w_n_spans, r._w_kept_sha256) for r in suffixes.remove_repeats(df, hot=hot, per_bucket=7, keep_text=False).collect()}
        assert got == want
    assert {1, 2} <= set(levels)  # both finer levels were needed


def test_loser_tree_merge():
    rng = np.random.default_rng(2)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.integers(0, 3, rng.integers(1, 12))) for _ in range(rng.integers(0, 40))) for _ in range(k)]
        coded = []
        for r in runs:
            shares, rests = suffixes.front_code(r)
            coded.append(suffixes.decoded(shares, np.array([len(s) for s in r]), rests))
        out = list(suffixes.merge(coded))
        assert [s for _, s, _ in out] == sorted(sum(runs, []))
        for (_, a, _), (_, b, h) in zip(out, out[1:], strict=False):
            assert h == suffixes.common(a, b, 0)


def _windows_found(texts, items, size=10):
    """By a dictionary of windows: (words, words hit, item ids) of each text."""
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    pats = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            pats.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for n in {len(p) for p in pats}:
            for k in range(len(w) - n + 1):
                found = pats.get(tuple(w[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_decontamination(spark, tables):
    got = run(spark, tables, "op9_")
    items = [("null" if i is None else i, t) for i, t in tables["bench"]]
    short = {k: t for k, (_, t, *_) in enumerate(tables["docs"]) if len(t or "") < 5_000}
    one_each = dict(enumerate(t for _, t in items))
    assert {k: x for k, x in zip(short, _windows_found(short.values(), one_each.items()), strict=True)} == decontaminate.brute_force(short, one_each)
    want = _windows_found([t for _, t, *_ in tables["docs"]], items)
    expect = Counter((d, n, hit, len(ids), decontaminate.digest(ids), hit > 0) for (d, *_), (n, hit, ids) in zip(tables["docs"], want, strict=True))
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == expect
    assert any("null" in ids for _, _, ids in want)


def test_decontamination_in_blocks(spark, tables):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{tables['full']}/benchmark.parquet")
    one, many = (Counter(map(str, decontaminate.find_benchmark(docs, bench, block_bytes=b).drop("text").collect())) for b in (1 << 20, 60))
    assert one == many
    plan = decontaminate.find_benchmark(docs, bench, block_bytes=60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and len(decontaminate.pattern_blocks(bench, 10, 60)) > decontaminate.HELD


def test_embeddings(spark, tables):
    got = run(spark, tables, "op10_")
    assert len(got) == len(tables["emb"])
    bad = {2002, 2003, 2004, 2005, 2006, 2007}
    rows = [(i, np.array(v, float)) for i, v, _ in tables["emb"] if i not in bad]
    for i, v in rows:
        n = sum(len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95 for _, w in rows) - 1
        assert any(r["vec_id"] == i and r["n_links"] == n for r in got), (i, n)
    by = {r["vec_id"]: r for r in got}
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in bad)
    assert by[2001]["component_id"] == 5 and by[1010]["component_id"] == 3 and not by[1010]["kept"]


def test_embedding_subshards_and_recall(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centers[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 1.0)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = np.array([np.array(v, np.float32) for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.95).sum() - len(x)
    found = sum(r.n_links for r in graph.near_duplicates(df, members=300, limit=150).collect())
    assert 0.9 * true <= found <= true
    # few centroids at first: every shard is too large and gets its own
    refined, seen = graph._refined, []
    monkeypatch.setattr(graph, "_refined", lambda *a: seen.append(refined(*a)) or seen[-1])
    found = sum(r.n_links for r in graph.near_duplicates(df, members=60, limit=150, most=3).collect())
    assert 0.9 * true <= found <= true
    shards = [s for r in seen[0].collect() for s in r.shards]
    assert len(set(shards)) > 3 and any(s % graph.FINE for s in shards)


def test_a_dense_group_larger_than_a_shard_loses_no_link(spark):
    """400 near copies among 800 vectors, in shards of at most 60: every pair of them is found."""
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(size=(1, 24)) + rng.normal(size=(400, 24)) * 0.02, rng.normal(size=(400, 24))])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in graph.near_duplicates(df, members=40, limit=60, most=5).collect()}
    assert all(got[i] == 399 for i in range(400))


def test_audit_is_not_outvoted_and_always_runs(spark, monkeypatch):
    """One group of 200 whose links are all found, 100 pairs whose links are all missed: most drawn vectors with links lack half or all."""
    rng = np.random.default_rng(2)
    heads = rng.normal(size=(101, 32))
    x = np.concatenate([heads[:1] + rng.normal(size=(200, 32)) * 0.01, np.repeat(heads[1:], 2, axis=0) + rng.normal(size=(200, 32)) * 0.01])
    classes = spark.createDataFrame([(i, 1, 32, [float(a) for a in v]) for i, v in enumerate(x)], "node long, size long, dim int, emb array<float>")
    links = spark.createDataFrame([(i, 0, 199) for i in range(200)], "node long, other long, add long")
    assert 0.4 < graph.audit(classes, links, 0.95, queries=400) < 0.6
    # none of the few drawn at first has links: more are drawn
    alone = spark.createDataFrame([(i, 1, 32, [float(a) for a in rng.normal(size=32)]) for i in range(400, 3000)], classes.schema)
    assert graph.audit(classes.where("node >= 200").unionAll(alone), links.where("node < 0"), 0.95, queries=4) < 0.1
    monkeypatch.setattr(graph, "audit", lambda *a, **kw: 0.0)
    with pytest.raises(RuntimeError, match="overlap 8"):
        graph.near_duplicates(classes.select(F.col("node").alias("vec_id"), F.col("emb").alias("embedding")), most_overlap=8)


def test_sharding(spark, tables):
    got = run(spark, tables, "op5_")
    assert len(got) == len(tables["docs"])
    sizes = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in tables["docs"])
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sizes
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) and r["law"] == "key" for r in got)
    same = {}
    assert all(same.setdefault(r["doc_id"], r["shard"]) == r["shard"] for r in got)


def test_slots_follow_doc_id_over_many_buckets(spark):
    docs = spark.createDataFrame([(int(i), f"text {i}") for i in np.random.default_rng(4).permutation(3000)] + [(None, "a"), (7, "a")], "doc_id long, text string")
    got = shard.shard_documents(docs, 3, rows_per_bucket=100).collect()
    for s in range(3):
        rows = sorted((r for r in got if r.shard == s), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
        assert [r.slot for r in rows] == list(range(len(rows)))


def _moves(spark, one, two, n=20_000):
    df = shard.place(spark.range(n), F.col("id"), {"a": one, "b": two})
    return {(r.a, r.b): r["count"] for r in df.groupBy("a", "b").count().collect()}


def test_shares_follow_weights(spark):
    tree = [shard.Leaf(x.shard, x.region, x.rack, 1.0 + x.shard % 3) for x in shard.topology(8)]
    per = Counter()
    for (a, _), n in _moves(spark, tree, tree, 30_000).items():
        per[a] += n
    whole = sum(x.weight for x in tree)
    assert all(abs(per[x.shard] / 30_000 - x.weight / whole) < 0.015 for x in tree)


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    tree = shard.topology(8)
    assert all(a == b or b == 8 for a, b in _moves(spark, tree, shard.grown(tree)))
    more = [shard.Leaf(x.shard, x.region, x.rack, 2.0) if x.shard == 3 else x for x in tree]
    moves = {k: n for k, n in _moves(spark, tree, more).items() if k[0] != k[1]}
    assert all(b in range(4) for _, b in moves)  # into the region that grew, and from anywhere
    assert {a for a, _ in moves} > {4, 5, 6, 7} and not any(a in (0, 1) and b in (0, 1) for a, b in moves)
    less = [shard.Leaf(x.shard, x.region, x.rack, 0.0) if x.shard == 3 else x for x in tree]
    moves = {k: n for k, n in _moves(spark, tree, less).items() if k[0] != k[1]}
    assert all(a in range(4) for a, _ in moves) and all(b != 3 for _, b in moves)


def test_the_tree_is_no_flat_draw(spark):
    """The least draw among the leaves would differ: inner nodes draw for themselves."""
    import hashlib as h

    def flat(key):
        u = lambda x: (int(h.md5(f"{key}:{x.region}/{x.rack}/{x.shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return min(shard.topology(8), key=lambda x: -math.log(u(x))).shard

    got = {r.id: r.a for r in shard.place(spark.range(500), F.col("id"), {"a": shard.topology(8)}).collect()}
    assert sum(got[k] != flat(k) for k in got) > 100


def test_ranks_without_gaps(spark):
    df = spark.range(1000).selectExpr("id", "IF(id < 700, 0, id % 3) AS k")
    for per in (10, 100_000):
        got = shared.gapless_rank(df, ["k"], ["id"], "rank", rows_per_bucket=per).collect()
        by = {}
        for r in got:
            by.setdefault(r.k, []).append(r["rank"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 1000


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [tuple(map(int, e)) for e in rng.integers(2000, 2300, (200, 2))]
    got = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}
    # hubs by a map instead of a shuffle
    pairs = spark.createDataFrame(edges, "a long, b long").where("a <> b").selectExpr("a AS u", "b AS v")
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    one, two = (sorted(map(tuple, shared.join_least(pairs, low, c).select("u", "v", "m").collect())) for c in (20, 100_000))
    assert one == two and "1000" in shared.join_least(pairs, low, 20)._jdf.queryExecution().optimizedPlan().toString()


def test_pipeline_stages(spark, tables):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    cols = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name, "in"] = [r.asDict() for r in docs.collect()]
        docs = shared.cut(stage(spark, docs, tables["full"]))
        seen[name, "out"] = [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert docs.columns == cols, name
    rows = lambda part: sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in part)

    part, left = seen["language ID", "in"], seen["language ID", "out"]
    gone = {r["doc_id"] for r in part} - {r["doc_id"] for r in left}
    assert gone == {302, 303, 304, 305} and rows(left) == rows([r for r in part if re.search(r"[^\W\d_]", r["text"] or "")])

    part, left = seen["n-gram Jaccard join", "in"], seen["n-gram Jaccard join", "out"]
    some = {r["doc_id"]: r["text"] for r in part if r["doc_id"] is not None}
    heads = {g for _, _, _, g in jaccard.brute_force(list(some.items()))}
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted(heads) and {3} <= heads and not {300, 301} & heads

    part, left = seen["suffix-array dedup", "in"], {r["doc_id"]: r for r in seen["suffix-array dedup", "out"]}
    want = suffixes.brute_force([r["text"].encode() for r in part])
    for r, (removed, _, kept) in zip(part, want, strict=True):
        text = kept.decode("utf-8", "ignore")
        if removed and not text.strip():
            assert r["doc_id"] not in left
        else:
            assert left[r["doc_id"]]["text"] == text and (not removed or left[r["doc_id"]]["n_chars"] == len(text))
    assert sum(removed > 0 for removed, _, _ in want) >= 3

    part, left = seen["benchmark decontamination", "in"], seen["benchmark decontamination", "out"]
    hits = decontaminate.brute_force({k: r["text"] for k, r in enumerate(part)}, dict(enumerate(t for _, t in tables["bench"])))
    assert rows(left) == rows([r for k, r in enumerate(part) if not hits[k][1]]) and len(left) < len(part)

    pieces = seen["packing", "out"]
    per = Counter()
    for r in pieces:
        per[r["doc_id"]] += len(r["ids"])
        assert len(r["ids"]) == r["length"] <= 2048
    assert set(per) == {r["doc_id"] for r in left} and all(r["doc_tokens"] == per[r["doc_id"]] for r in pieces)
