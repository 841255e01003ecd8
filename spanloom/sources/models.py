"""A caller's model as a table function over chunks: several rows for a chunk, and failures as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.sources.tables import run_model


def model_rows(chunks: DataFrame, keys: list[str], call: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """keys, the columns of schema, and error of everything that a model gives for the chunks.

    call gets chunks as one Arrow batch and gives one of keys and results, any number of rows for a
    chunk. Where it raises, or gives other columns, the batch's chunks are tried one by one, and one
    that fails alone is a row of its keys with the error and no results; so a chunk that can't be
    recognised costs no other one, and no task. Null chunks are the model's to judge.
    """
    results = T._parse_datatype_string(schema)
    out = T.StructType([*(chunks.schema[k] for k in keys), *results, T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(out)

    def given(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = call(batch)
        columns = [made.column(f.name).cast(f.type) for f in list(arrow)[:-1]]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(made.num_rows, pa.string())], schema=arrow)

    def failed(row: pa.RecordBatch, error: Exception) -> pa.RecordBatch:
        known = [row.column(f.name).cast(f.type) if f.name in keys else pa.nulls(1, f.type) for f in list(arrow)[:-1]]
        return pa.RecordBatch.from_arrays([*known, pa.array([f"{type(error).__name__}: {error}"])], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                yield given(batch)
            except Exception:  # whose fault it is shows one by one
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    try:
                        yield given(row)
                    except Exception as error:  # a row of its own
                        yield failed(row, error)

    return run_model(chunks, run, out)
