"""What the vector searches share: rows that count, equal vectors searched once, and lists per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import cut


def finite(v: Column) -> Column:
    """Whether a vector is there, without a component that is null or not finite."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    """Vectors of one length as rows."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(whole), -1 if len(whole.flatten()) else 0)


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch's rows by the length of their vectors."""
    lengths = pc.list_value_length(batch.column(column))
    for d in pc.unique(lengths).to_pylist():
        yield d, batch.filter(pc.equal(lengths, d))


def first_of_equals(rows: DataFrame, keep: int) -> DataFrame:
    """Of the rows of each vector the `keep` of smallest vec_id, numbered by nth: no other can be among anyone's `keep` best.

    Spark limits each task's rows of a vector before it deals them, so a very common vector is no burden.
    """
    alike = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    return cut(rows.withColumn("nth", alike).where(F.col("nth") <= keep))


def distinct_queries(rows: DataFrame, firsts: DataFrame, is_query: Column) -> DataFrame:
    """vec_id, same and vector of every row that asks; rows of equal vectors share the number `same`, which no other vector has."""
    representative = firsts.where("nth = 1").select("vector", F.monotonically_increasing_id().alias("same"))
    return cut(rows.where(is_query).select("vec_id", "vector").join(representative, "vector").select("vec_id", "same", "vector"))


def ranked(asked: DataFrame, near: DataFrame, neighbours: int) -> DataFrame:
    """query_id, rank, vec_id and score of each asking row, without the row itself.

    near: same, found_id, score and equal (whether the found vector equals the query's), with the
    neighbours + 1 best of each query at least.
    """
    keep = neighbours + 1
    best = Window.partitionBy("same").orderBy(F.desc("score"), "found_id")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)
    listed = F.array_sort(F.collect_list(F.struct("place", F.col("found_id").alias("vec_id"), "score", "equal")))
    # Kept apart from the join, so that Spark may split the side of a vector that very many rows ask for.
    lists = cut(near.groupBy("same").agg(listed.alias("found")))
    others = F.filter("found", lambda x: ~(x["equal"] & (x["vec_id"] == F.col("query_id"))))
    met = asked.select(F.col("vec_id").alias("query_id"), "same").join(lists, "same")
    each = met.select("query_id", F.posexplode(F.slice(others, 1, neighbours)).alias("pos", "x"))
    return each.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
