"""A judge's rows in batches under a token budget (LB-23).

Rows are dealt to tasks by ranges of their length, so a batch pads little. A task takes its rows as they get longer and fills each batch up to the budget: its number of rows times its
longest row. Where the judge runs out of memory the task halves its budget and tries the rows again; a row that does not even fit alone raises. Each row is judged
once and keeps all its columns, so whatever order it had can be restored from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Judge(Protocol):
    """Lengths of prompts in tokens, and for each prompt the probabilities of its first so many letters. Raises MemoryError for batches that are too large."""

    def lengths(self, prompts: list[str]) -> list[int]: ...

    def probabilities(self, prompts: list[str], letters: list[int]) -> list[list[float]]: ...


class OverlapJudge:
    """A deterministic stand-in without weights: shared words of a prompt's page and each lettered option. `room` is how many padded tokens it has memory for."""

    def __init__(self, room: int = 1 << 62) -> None:
        self.room = room

    def lengths(self, prompts):
        return [len(p.split()) for p in prompts]

    def probabilities(self, prompts, letters):
        if len(prompts) * max(self.lengths(prompts)) > self.room:
            raise MemoryError("out of memory")
        out = []
        for p, k in zip(prompts, letters, strict=True):
            page, _, options = p.partition("\n\n")
            words = set(page.lower().split())
            lines = [x[3:] for x in options.split("\n") if x[1:3] == ". "][:k]
            x = np.array([len(words & set(o.lower().split())) * 0.5 for o in lines])
            e = np.exp(x - x.max(initial=0.0))
            out.append((e / e.sum()).tolist() if k else [])
        return out


def batches(lengths: list[int], budget: int, start: int = 0) -> int:
    """The end of the batch that begins at `start`: rows in ascending length, as many as keep rows times longest within the budget, one at least."""
    end = start + 1
    while end < len(lengths) and (end + 1 - start) * lengths[end] <= budget:
        end += 1
    return end


def _with_lengths(judge: Judge):
    def step(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            tokens = judge.lengths(["" if p is None else p for p in b.column("prompt").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.int64())], names=[*b.schema.names, "tokens"])

    return step


def _judged(judge: Judge, budget: int):
    def step(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = budget
        for b in found:
            prompts, letters, tokens = (b.column(c).to_pylist() for c in ("prompt", "letters", "tokens"))
            prompts = ["" if p is None else p for p in prompts]
            probs, sizes, at = [], [], 0
            while at < len(prompts):
                end = batches(tokens, room, at)
                try:
                    probs += judge.probabilities(prompts[at:end], letters[at:end])
                except MemoryError:
                    if end - at == 1:
                        raise
                    room = max(1, room // 2)
                    continue
                sizes += [(end - at, (end - at) * max(tokens[at:end]))] * (end - at)
                at = end
            cols = [pa.array(probs, pa.list_(pa.float64())), pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "probabilities", "batch_rows", "batch_tokens"])

    return step


def judged(items: DataFrame, judge: Judge, token_budget: int, tasks: int | None = None) -> DataFrame:
    """items(prompt, letters, ...) with tokens, probabilities of the letters, and the rows and padded tokens of the batch each was in.

    One shuffle, by ranges of length and a hash of the prompt, so that rows of one common length stay spread. A null prompt is an empty one.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    measured = items.mapInArrow(_with_lengths(judge), f"{fields}, tokens long")
    order = ["tokens", F.xxhash64("prompt")]
    dealt = measured.repartitionByRange(tasks, *order) if tasks else measured.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).mapInArrow(_judged(judge, token_budget), f"{fields}, tokens long, probabilities array<double>, batch_rows int, batch_tokens long")
