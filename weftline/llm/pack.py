"""Packing token sequences by minimum bin slack.

Each document is tokenised whole, cut at the window's length, and its pieces are packed so that windows fill up. The plan needs only how
many pieces have each length, a table of at most `window` rows, whatever the input: the longest piece left opens a window, a
bounded-knapsack subset-sum over a bitset of reachable fills finds the multiset of remaining lengths that fills the rest closest to
the brim, backtracking gives its counts, and the pattern is repeated as often as the counts allow, so that every step uses up a length. Pieces find
their window by their rank among the pieces of their length; ranks are made bucket by bucket, so a hot length is no one task's.

Nulls and empty texts are one end token. Repeated rows are packed each for itself. An empty table gives an empty result.
Extra columns are dropped. Ids are those of the tokenizer file on the whole text: the tokenizer drops white space and never joins
across it, so words between white space are tokenised once and remembered by each worker. A remembered word is found by a hash and then
compared byte by byte; words that share a hash with another are tokenised apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WINDOW = 2048
END = 1


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- tokens

#: ASCII white space, where the tokenizer always ends a word and drops the white space itself.
_IN_WORD = ~np.isin(np.arange(256), [32, 9, 10, 13])
_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_MARK = np.array([32 < i < 127 and not chr(i).isalnum() and i != 39 for i in range(256)])  # ASCII punctuation but the apostrophe


def _words(raw: np.ndarray, offsets: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that the tokenizer takes one by one: it also always parts letters from the ASCII punctuation next to them.

    A span ends between an ASCII or Latin-1 letter and a mark, or a mark and an ASCII letter. Apostrophes start contractions, and a mark before
    other characters may combine with them: there nothing is cut. whole: cut at white space alone.
    """
    starts, ends, rows = shared.word_spans(raw, offsets, _IN_WORD)
    if whole or len(raw) < 2:
        return starts, ends, rows
    letter, mark = _LETTER[raw], _MARK[raw]
    ended = letter.copy()
    ended[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    cut = np.zeros(len(raw), bool)
    cut[1:] = (mark[1:] & ended[:-1]) | (letter[1:] & mark[:-1])
    cut[offsets[offsets < len(raw)]] = False
    at = np.flatnonzero(cut)
    starts = np.sort(np.concatenate([starts, at]))
    return starts, np.sort(np.concatenate([ends, at])), np.searchsorted(starts, offsets)


class WordTokenizer:
    """Ids of whole texts, with a bounded memory of words between white space: their 64-bit hashes, bytes and ids. A hash finds a word, its bytes decide."""

    def __init__(self, path: str, remember: int = 800_000) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.remember = remember
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # whether an id ends a word
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.old, self.new = none, none  # sorted hashes and the words' numbers: many, and the latest
        self.count = self.used = 0
        self.bounds, self.flat = np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        self.spelt, self.text = np.zeros(1 << 16, np.int64), np.zeros(1 << 20, np.uint8)  # the words' bytes, and where each one's end

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int32)
        for hashes, numbers in (self.old, self.new):
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
                hit = hashes[at] == keys
                out[hit] = numbers[at[hit]]
        return out

    def _merge(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hashes, numbers = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(hashes, kind="stable")  # two sorted runs
        return hashes[order], numbers[order]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after another, and where each word's end."""
        if all(w.isalpha() for w in words):  # as one text, in which each is one word, unless its lower case has marks
            flat = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[flat]) + 1
            if len(ends) == len(words):
                return flat, ends
        got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((x for ids in got for x in ids), np.uint32), np.cumsum([len(x) for x in got])

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Keys are sorted."""
        number = np.empty(len(keys), np.int32)
        texts = [w.decode("utf-8", "replace") for w in words]
        for alpha in (True, False):
            at = [i for i, w in enumerate(texts) if w.isalpha() is alpha]
            for k in range(0, len(at), 20_000):
                part = at[k : k + 20_000]
                flat, ends = self._ids([texts[i] for i in part])
                spelt = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
                first = int(self.spelt[self.count])
                self.flat = _roomy(self.flat, self.used + len(flat))
                self.bounds = _roomy(self.bounds, self.count + len(part) + 1)
                self.spelt = _roomy(self.spelt, self.count + len(part) + 1)
                self.text = _roomy(self.text, first + len(spelt) + 8)
                self.flat[self.used : self.used + len(flat)] = flat
                self.bounds[self.count + 1 : self.count + len(part) + 1] = self.used + ends
                self.text[first : first + len(spelt)] = spelt
                self.spelt[self.count + 1 : self.count + len(part) + 1] = first + np.cumsum([len(words[i]) for i in part])
                number[part] = np.arange(self.count, self.count + len(part))
                self.used += len(flat)
                self.count += len(part)
        self.new = self._merge(self.new, (keys, number))
        if len(self.new[0]) > 1 << 16:
            self.old, self.new = self._merge(self.old, self.new), (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after another, and each row's first. A text's ids are its words' ids one after another."""
        whole = raw.tobytes()
        starts, ends, rows = _words(raw, offsets, any(x.encode() in whole for x in self.special))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        size = ends - starts
        uniq, first, back = np.unique(shared.span_hash(raw, starts, ends), return_index=True, return_inverse=True)
        if self.count + len(uniq) > self.remember or self.spelt[self.count] > 64 << 20:
            self.forget()
        number = self._find(uniq)
        new = np.flatnonzero(number < 0)
        if len(new):
            at = first[new]
            self._learn(uniq[new], [whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            number[new] = self._find(uniq[new])
        slot = number[back]
        spelt = self.spelt[slot]
        fits = self.spelt[slot + 1] - spelt == size
        fits[fits] = shared.same_spans(raw, starts[fits], size[fits], self.text, spelt[fits])
        begin = self.bounds[slot].astype(np.int64)
        count = self.bounds[slot + 1] - begin
        flat = self.flat
        odd = np.flatnonzero(~fits)
        if len(odd):  # another word has their hash
            ids = [self.tok.encode(whole[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
            count[odd] = [len(x) for x in ids]
            begin[odd] = self.used + np.cumsum(count[odd]) - count[odd]
            flat = np.concatenate([flat[: self.used], np.array([x for i in ids for x in i], np.uint32)])
        end = np.cumsum(count)
        take = np.repeat(begin - (end - count), count) + np.arange(int(end[-1]))
        return flat[take], np.concatenate([[0], end])[rows]


def _roomy(x: np.ndarray, size: int) -> np.ndarray:
    """x, or a longer copy that has room for `size`."""
    return x if len(x) >= size else np.concatenate([x, np.zeros(max(len(x), size - len(x)), x.dtype)])


def _tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, kept from task to task."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    if path not in shared.kept():
        shared.kept()[path] = WordTokenizer(path)
    return shared.kept()[path]


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _pieces(path: str, window: int, end: int, with_ids: bool):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        narrow = _width(len(tok.ends))
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, raw, at in shared.slices(batch.column("text")):
                flat, first = tok.encode(raw, at)
                rows, start, length, crc, total, kept = [], [], [], [], [], []
                for r in range(hi - lo):
                    x = np.append(flat[first[r] : first[r + 1]], np.uint32(end)).astype("<u4")
                    for s in range(0, len(x), window):
                        piece = x[s : s + window]
                        rows.append(lo + r)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(x))
                        if with_ids:
                            kept.append(piece.astype(narrow).tobytes())
                cols = [ids.take(pa.array(rows, pa.int64())), *(pa.array(v, pa.int64()) for v in (start, length, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array(kept, pa.binary()))
                    names.append("packed_ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return step


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, packed_ids]): every document's tokens and the end token, cut at the window.

    packed_ids holds the ids in two bytes each, or four for a larger vocabulary; `pack` gives them as an array.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", packed_ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, window, end, with_ids), schema)


# ---------------------------------------------------------------- plan


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within the counts, whose sum is closest to room from below; longer lengths first among equals.

    Bit s of `reach` tells whether sum s can be made. A length with count c is taken in runs of 1, 2, 4.. and the rest; the bitset before each
    run is kept, and walking back from the best sum tells which runs are in it.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, run = min(counts[size], room // size), 1
        while left:
            n = min(run, left)
            new = (reach | (reach << (size * n))) & mask
            if new != reach:
                steps.append((size, n, reach))
                reach = new
            left -= n
            run *= 2
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, {}
    for size, n, before in reversed(steps):
        if not (before >> at) & 1:  # the sum needs this run
            at -= size * n
            out[size] = out.get(size, 0) + n
    return out


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(times, lengths of one window): minimum bin slack over the counts of piece lengths."""
    left = {k: v for k, v in counts.items() if v}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        fill = best_fill(left, window - seed)
        left[seed] += 1
        fill[seed] = fill.get(seed, 0) + 1
        times = min(left[k] // n for k, n in fill.items())
        for k, n in fill.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, fill))
    return out


def _seats(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length and pattern: the rank of the first piece that sits there, pieces a window, the first window, the offset in it."""
    used: dict[int, int] = {}
    rows, window = [], 0
    for times, fill in patterns:
        offset = 0
        for size in sorted(fill, reverse=True):
            rows.append((size, used.get(size, 0), fill[size], window, offset))
            used[size] = used.get(size, 0) + fill[size] * times
            offset += size * fill[size]
        window += times
    rows.sort()
    return dict(zip(("length", "rank", "each", "window", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def _seat(seats: dict[str, np.ndarray]):
    # one sorted key for (length, rank): ranks stay far below 2**48
    key = seats["length"] * (1 << 48) + seats["rank"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("_rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            n = rank - seats["rank"][i]
            each = seats["each"][i]
            names = [c for c in b.schema.names if c not in ("_rank", "packed_ids")]
            cols = [b.column(c) for c in names]
            if "packed_ids" in b.schema.names:
                raw, _ = shared.utf8(b.column("packed_ids"))
                ids = np.frombuffer(raw.tobytes(), f"<u{len(raw) // max(1, int(length.sum()))}" if len(raw) else "<u2")
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            cols += [pa.array(seats["window"][i] + n // each), pa.array(seats["offset"][i] + n % each * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    return step


def pack(cut_pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces with their sequence_id and offset. The plan's table has a row for each length in each pattern: by `window` alone bounded."""
    rows = shared.cut(cut_pieces, "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    seats = _seats(plan(counts, window))
    # a length's buckets by its own count; fewer pieces each where they carry their ids
    each = 2_000 if "packed_ids" in rows.columns else 50_000
    buckets = F.element_at(F.array(*(F.lit(max(1, -(-counts.get(i, 0) // each))) for i in range(1, window + 1))), F.col("length").cast("int"))
    ranked = shared.gapless_rank(rows, ["length"], ["doc_id", "start", "ids_crc32"], "_rank", buckets=buckets)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "packed_ids")
    fields += ", ids array<int>" * ("packed_ids" in rows.columns)
    return ranked.mapInArrow(_seat(seats), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, path or tokenizer_file(), window, end, with_ids), window)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces with their ids."""
    return pack_documents(docs, with_ids=True)
