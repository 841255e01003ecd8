"""Ordered folds: state machines over the rows of a key, in order, where later rows depend on what was decided for earlier ones.

Rows are dealt by key and sorted inside partitions, which Spark spills; the fold then sees one row at
a time and holds the state of one key only, however long the key's history is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class State(Protocol):
    """What a fold keeps for one key."""

    def push(self, row: tuple) -> Iterable[tuple]: ...

    def flush(self) -> Iterable[tuple]: ...


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in have:
        env["PYTHONPATH"] = ":".join([root, *have])


def arrow_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of tuples."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def ordered_fold(df: DataFrame, key: str, order: list[str], columns: list[str], make: Callable[[object], State], schema: str) -> DataFrame:
    """Fold each key's rows in order. make(key) gives a key's fresh state; push and flush give result rows."""
    ensure_importable(df.sparkSession)
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, first = None, None, True
        for batch in batches:
            out: list[tuple] = []
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or k != current:
                    if state is not None:
                        out += state.flush()
                    state, current, first = make(k), k, False
                out += state.push(tuple(row))
            if out:
                yield arrow_rows(out, arrow)
        if state is not None and (rest := list(state.flush())):
            yield arrow_rows(rest, arrow)

    dealt = df.repartition(key).sortWithinPartitions(key, *order)
    return dealt.select(key, *columns).mapInArrow(run, struct)
