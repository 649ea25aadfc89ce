"""Ordered folds over groups of rows, in Arrow batches: a group costs its rows, not a data frame of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that is handed back.
ROWS = 4096


def fold_groups(rows: DataFrame, keys: list[str], order: list[str], one: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """What ``one`` makes of each group's rows, which it gets as tuples in order; a null key is a key.

    Rows are dealt by key and sorted, and a task holds one group at a time.
    """
    n, wanted = len(keys), to_arrow_schema(StructType.fromDDL(schema))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:n] != held[0][:n]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in groups(batches):
            out += one(group)
            if len(out) >= ROWS:
                yield made(out)
                out = []
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), wanted, strict=True)], schema=wanted)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
