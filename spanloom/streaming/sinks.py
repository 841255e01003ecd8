"""One stream written to several tables, each batch once however often it is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

#: The column that tells a table's batches apart.
BATCH = "batch_id"


def batch_writer(tables: dict[str, Column], path: str) -> Callable[[DataFrame, int], None]:
    """A function that writes a batch's rows to every table whose condition holds for them.

    A batch has a folder of its own in each table, named by its number and written anew as a whole. A
    batch that is run again after a failure, in the middle of the tables too, so leaves each as if it
    had been run once. A row may be in several tables or in none; a null condition doesn't hold.
    """

    def write(rows: DataFrame, batch: int) -> None:
        held = rows.persist()
        try:
            for name, condition in tables.items():
                held.where(condition).write.mode("overwrite").parquet(f"{path}/{name}/{BATCH}={batch}")
        finally:
            held.unpersist()

    return write


def fan_out(rows: DataFrame, tables: dict[str, Column], path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start a query that deals the rows of a stream to tables below `path`, exactly once."""
    return rows.writeStream.foreachBatch(batch_writer(tables, path)).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One of the tables, with the batch of each row."""
    return spark.read.schema(f"{schema}, {BATCH} bigint").parquet(f"{path}/{name}").withColumn("table", F.lit(name))
