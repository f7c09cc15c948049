"""Arrow batches in small pieces.

Spark hands a task's rows to Python in batches of up to 10,000 rows or 64 MB. What Python makes of a row, its text as objects and all that a parser finds, takes many times the row's bytes;
so steps go through a batch by pieces, and what was made of one is gone before the next. A task's memory is then one batch and one piece, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

ROWS = 64


def pieces(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of so many rows, without copies."""
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            yield whole.slice(i, rows)


def added(keep: list[str], columns: dict[str, pa.DataType], made: Callable[[pa.RecordBatch], list[list]], rows: int = ROWS) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step for mapInArrow: the kept columns as they came, and those that `made` gives for a piece."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, rows):
            new = [pa.array(x, kind) for x, kind in zip(made(b), columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], names=[*keep, *columns])

    return step


def weighed(rows: Iterable[tuple[tuple, int]], schema: pa.Schema, most_rows: int = 1000, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows that come with their bytes as batches under both limits; a larger row is a batch of its own."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    held, size = [], 0
    for row, n in rows:
        if held and (len(held) == most_rows or size + n > most_bytes):
            yield batch()
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield batch()
