"""Answers of models joined to the chunks they name, both as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer_stream(chunks: DataFrame, answers: DataFrame, phase: str, delay: str = "10 minutes") -> DataFrame:
    """answers with status: accepted, or unknown_chunk where no such chunk was in the phase within `delay` before or after.

    chunks: stream_id, chunk_id, phase and at (a timestamp), one row for each phase that a chunk enters.
    answers: stream_id, chunk_id, at and more. Both sides wait in the state store for as long as `delay`
    lets them meet; an accepted answer is given at once, an unknown one when the watermark has passed.
    So a row far ahead in time on both sides ends the wait. Answers without a stream, chunk or time are
    unknown_chunk at once.
    """
    known = chunks.where(F.col("phase") == phase).select(F.col("stream_id").alias("_stream"), F.col("chunk_id").alias("_chunk"), F.col("at").alias("_at")).withWatermark("_at", delay)
    whole = F.col("stream_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("at").isNotNull()
    wait = F.expr(f"INTERVAL {delay}")
    same = (F.col("stream_id") == F.col("_stream")) & (F.col("chunk_id") == F.col("_chunk")) & (F.col("_at") >= F.col("at") - wait) & (F.col("_at") <= F.col("at") + wait)
    met = answers.where(whole).withWatermark("at", delay).join(known, same, "left")
    judged = met.select(*answers.columns, F.when(F.col("_at").isNotNull(), "accepted").otherwise("unknown_chunk").alias("status"))
    return judged.unionByName(answers.where(~whole).withColumn("status", F.lit("unknown_chunk")))
