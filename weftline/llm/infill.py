"""Fill-in-middle transformation over succinct rank/select bitvectors.

A batch's texts stand one after another as UTF-8 bytes. One packed bitvector marks each token's last byte, another each code point's first byte; a directory
holds the popcounts of all bits before each block of 512. A text's number of tokens is the rank of its end less that of its begin. Cutting after k tokens is a
select: the directory is searched for the block, the block's words are summed up, and the word's bits tell the byte. Both cuts of all texts
of a batch are selected together; the pieces' code points are ranks on the other vector. One narrow stage, no shuffle.

Tokens are `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`: a token ends where a word ends, and where a text ends with spaces.

A null text is empty: n 0, form plain. A null id counts as the text "null". Rows with equal ids or texts are transformed one by one; an empty table gives an empty
result; extra columns do no harm. A text that contains a mark stays plain, so output and form give the exact text back (`restored`).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = re.compile(rb"<[PSM]>")
BLOCK = 8  # words of 64 bits


class RankSelect:
    """A packed bitvector with a directory of the popcounts before each block."""

    def __init__(self, bits: np.ndarray) -> None:
        self.size = len(bits)
        words = -(-self.size // 64)
        packed = np.zeros((words // BLOCK + 1) * BLOCK * 8, np.uint8)
        little = np.packbits(bits, bitorder="little")
        packed[: len(little)] = little
        self.words = packed.view("<u8")
        self.directory = np.zeros(len(self.words) // BLOCK + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words).reshape(-1, BLOCK).sum(1), out=self.directory[1:])

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        within = np.arange(BLOCK)[None, :] < (word % BLOCK)[:, None]
        blocks = self.words.reshape(-1, BLOCK)[word // BLOCK]
        tail = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.directory[word // BLOCK] + (np.bitwise_count(blocks) * within).sum(1, dtype=np.int64) + np.bitwise_count(tail)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one with each rank, from 0; every k must be below the total."""
        if not len(k):
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.directory, k, "right") - 1
        rest = k - self.directory[block]
        upto = np.cumsum(np.bitwise_count(self.words.reshape(-1, BLOCK)[block]), axis=1, dtype=np.int64)
        word = (upto <= rest[:, None]).sum(1)
        before = np.where(word > 0, np.take_along_axis(upto, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        at = block * BLOCK + word
        ones = np.unpackbits(self.words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return at * 64 + (np.cumsum(ones, axis=1) <= (rest - before)[:, None]).sum(1)


def token_ends(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bit for each byte: the last of a token."""
    dark = shared.IS_DARK[raw]
    ends = dark.copy()
    ends[:-1] &= ~dark[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = True
    return ends


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the sha256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from its output and form alone. No piece holds a mark, and none can arise where pieces meet."""
    between = lambda left, right: F.split_part(F.split_part(output, F.lit(left), F.lit(2)), F.lit(right), F.lit(1))
    last = F.split_part(output, F.lit("<M>"), F.lit(2))
    psm = F.concat(between("<P>", "<S>"), last, between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), last, between("<S>", "<P>"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


_OUT = "_f_n long, _f_form string, _f_prefix_chars long, _f_middle_chars long, _f_output string"


def _transform(seed: int, fim_percent: int, spm_percent: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, hi, raw, offsets in shared.slices(batch.column("text")):
                tokens, chars = RankSelect(token_ends(raw, offsets)), RankSelect((raw & 0xC0) != 0x80)
                before = tokens.rank(offsets)
                n = np.diff(before)
                h = np.array([draws(seed, i) for i in ids[lo:hi]], np.int64).reshape(-1, 4)
                one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
                # the byte after the last of so many tokens; none of them: the text's begin
                cut = []
                for k in (np.minimum(one, two), np.maximum(one, two)):
                    at = offsets[:-1].copy()
                    some = k > 0
                    at[some] = tokens.select(before[:-1][some] + k[some] - 1) + 1
                    cut.append(at)
                points = [chars.rank(x) for x in (offsets[:-1], *cut)]
                forms, outputs = [], []
                for r in range(hi - lo):
                    own = raw[offsets[r] : offsets[r + 1]].tobytes()
                    if not own or h[r, 2] % 100 >= fim_percent or MARK.search(own):
                        forms.append("plain")
                        outputs.append(own)
                        continue
                    a, b = int(cut[0][r] - offsets[r]), int(cut[1][r] - offsets[r])
                    prefix, middle, suffix = PREFIX + own[:a], MIDDLE + own[a:b], SUFFIX + own[b:]
                    forms.append("spm" if h[r, 3] % 100 < spm_percent else "psm")
                    outputs.append(suffix + prefix + middle if forms[-1] == "spm" else prefix + suffix + middle)
                plain = np.array([f == "plain" for f in forms], bool)
                part = batch.slice(lo, hi - lo)
                cols = [pa.array(n), pa.array(forms, pa.string()), pa.array(points[1] - points[0], mask=plain), pa.array(points[2] - points[1], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *(c.split()[0] for c in _OUT.split(", "))])

    return step


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) with _f_n (tokens), _f_form, _f_prefix_chars, _f_middle_chars and _f_output, the transformed text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_transform(seed, fim_percent, spm_percent), f"{fields}, {_OUT}")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    output, form = F.col("_f_output"), F.col("_f_form")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select("doc_id", *(F.col(f"_f_{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")), sha(output).alias("output_sha256"), sha(restored(output, form)).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(cast(doc_id AS VARCHAR), 'null')) AS s FROM documents),
k AS (SELECT *, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  cast('0x' || substr(s, 1, 8) AS BIGINT) AS h1, cast('0x' || substr(s, 9, 8) AS BIGINT) AS h2, cast('0x' || substr(s, 17, 8) AS BIGINT) AS h3, cast('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 :], '') AS s2 FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s2 || '<M>' || m ELSE '<S>' || s2 || '<P>' || p || '<M>' || m END AS out FROM p),
r AS (SELECT *, CASE form WHEN 'plain' THEN out WHEN 'psm' THEN substr(split_part(out, '<S>', 1), 4) || split_part(out, '<M>', 2) || split_part(split_part(out, '<S>', 2), '<M>', 1)
  ELSE split_part(split_part(out, '<P>', 2), '<M>', 1) || split_part(out, '<M>', 2) || substr(split_part(out, '<P>', 1), 4) END AS back FROM o)
SELECT doc_id, cast(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(out) AS output_sha256, sha256(back) AS restored_sha256 FROM r
"""


def brute_force(doc_id: int | None, text: str | None, seed: int = 42) -> tuple:
    """The same by a regular expression and slices of its matches, for tests: n, form, prefix_chars, middle_chars, output."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digits = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
