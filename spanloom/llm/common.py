"""Plumbing shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.plans.fold import ensure_importable
from spanloom.plans.shared import cut  # noqa: F401  (the operators take it from here)

#: Rows that a text kernel holds as Python objects at once.
ROWS_AT_ONCE = 128

#: One word of the query contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def extend_rows(df: DataFrame, column: str, init: Callable[[], Callable[[list], list]], name: str, kind: str) -> DataFrame:
    """df with a column computed by a Python kernel from one other; that one alone leaves the JVM, and the result alone comes back.

    init() is called once per task and returns a function from a list of values to a list of results.
    """
    ensure_importable(df.sparkSession)
    arrow = to_arrow_schema(T._parse_datatype_string(f"x {kind}")).field(0).type

    @F.arrow_udf(kind)
    def extend(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kernel = init()
        for batch in batches:
            made = [x for k in range(0, len(batch), ROWS_AT_ONCE) for x in kernel(batch.slice(k, ROWS_AT_ONCE).to_pylist())]
            yield pa.array(made, type=arrow)

    # So marked, a filter on the result isn't pushed below it, which would run the kernel twice.
    return df.withColumn(name, extend.asNondeterministic()(F.col(f"`{column}`")))


def map_rows(df: DataFrame, columns: list[str | Column], init: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Run a Python kernel over Arrow batches.

    init() is called once per task and returns a function that takes one list per column and
    gives result rows as tuples. Only the named columns leave the JVM.
    """
    ensure_importable(df.sparkSession)
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    n_out = len(arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = init()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = list(kernel(*(c.to_pylist() for c in part.columns)))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[i], type=arrow.field(i).type) for i in range(n_out)], schema=arrow)

    picked = [F.col(f"`{c}`") if isinstance(c, str) else c for c in columns]
    return df.select(*picked).mapInArrow(run, struct)


def held_out(doc_id: Column) -> Column:
    """The fold rule of the query contracts: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
