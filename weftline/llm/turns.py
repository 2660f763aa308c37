"""Turns of conversations in one total order, dealt out so that one conversation can be many tasks.

Rows are range-partitioned by conversation and turn, so that a conversation with a third of all rows is spread over as many
partitions as its rows fill; ``seq`` numbers them and names the partition (chunk) that a row was in. What needs a whole
conversation is computed chunk by chunk and put together from a few numbers for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of seq that number the rows of a chunk.
ROW_BITS = 33


def in_order(rows: DataFrame, *columns: str, parts: int | None = None) -> DataFrame:
    """``rows`` sorted by ``columns`` (nulls first) over all partitions, with seq, which grows in that order.

    Rows that are equal in all of ``columns`` have no order among them.
    """
    order = [F.col(c).asc_nulls_first() for c in columns]
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())


def chunk() -> Column:
    return F.shiftright("seq", ROW_BITS)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    return chain.from_iterable(b.to_pylist() for b in batches)


def runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """(key, rows) of sorted rows; rows are streamed, nothing is held."""
    return groupby(rows_of(batches), key=lambda r: tuple(r[k] for k in keys))


def to_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def peek(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Schema | None, Iterator[pa.RecordBatch]]:
    """The schema of the first batch, if there is one, and all batches."""
    first = next(batches, None)
    return (None, iter(())) if first is None else (first.schema, chain([first], batches))
