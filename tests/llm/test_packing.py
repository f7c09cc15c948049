import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftline.llm import pack


def test_best_fill_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 40, 6)}
        room = int(rng.integers(1, 120))
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        want = max(s for s in sums if s <= room)
        got = pack.best_fill(counts, room)
        assert sum(k * n for k, n in got.items()) == want
        assert all(n <= counts[k] for k, n in got.items())


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(2)
    counts = {int(k): int(v) for k, v in enumerate(rng.integers(0, 50, 300), 1)}
    used = {}
    for times, fill in pack.plan(counts, 300):
        assert times >= 1 and sum(k * n for k, n in fill.items()) <= 300
        for k, n in fill.items():
            used[k] = used.get(k, 0) + n * times
    assert used == {k: v for k, v in counts.items() if v}


@pytest.fixture(scope="module")
def packed(spark):
    texts = [(1, "Hello world, don't stop"), (2, None), (3, ""), (4, "word " * 5000), (4, "word " * 5000), (5, "x" * 3000), (None, "á b  ́c <|endoftext|> İ"), *((100 + i, f"a b {i} " * (i % 50)) for i in range(300))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return texts, pack.pack_documents(df, with_ids=True).toPandas()


def test_ids_are_the_tokenizers(packed):
    texts, got = packed
    tok = Tokenizer.from_file(pack.tokenizer_file())
    want = {}
    for d, t in texts:
        want[d] = tok.encode(t or "", add_special_tokens=False).ids + [1]
    for d, rows in got.groupby("doc_id", dropna=False):
        d = None if d != d else int(d)
        rows = rows.sort_values("start")
        assert (rows.doc_tokens == len(want[d])).all()
        for r in rows.itertuples():
            assert list(r.ids) == want[d][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert got.length.sum() == sum(len(want[d]) for d, _ in texts)


def test_windows_are_gapless(packed):
    _, got = packed
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert list(rows.offset) == [0, *np.cumsum(rows.length)[:-1]]
        assert rows.length.sum() <= pack.WINDOW
    assert got.sequence_id.nunique() <= got.length.sum() / pack.WINDOW * 1.02 + 1


def test_empty_table(spark):
    assert pack.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


def test_words_that_polynomials_cannot_tell_apart_keep_their_ids():
    """Thue-Morse words collide under every polynomial modulo a power of two."""
    path = pack.tokenizer_file()
    words = [_thue_morse(1024), _thue_morse(1024, "b", "a"), _thue_morse(2048), _thue_morse(2048, "b", "a")]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    got, _ = pack.WordTokenizer(path).encode(raw, np.array([0, len(raw)]))
    assert got.tolist() == Tokenizer.from_file(path).encode(" ".join(words), add_special_tokens=False).ids


def test_words_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    from weftline.llm import shared

    monkeypatch.setattr(shared, "span_hash", lambda raw, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    path = pack.tokenizer_file()
    text = "these words share a hash, all three of them; longer words, too, like unbelievable and incomprehensible ones"
    raw = np.frombuffer(text.encode(), np.uint8)
    tok = pack.WordTokenizer(path)
    for _ in range(2):
        assert tok.encode(raw, np.array([0, len(raw)]))[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
