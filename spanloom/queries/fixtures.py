"""Streams, clips and attempts derived from the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.plans.shared import spread

#: Chunk limit of 24 hours and silence limit of six, in samples.
LIMIT, GAP = 24 * 3600 * 16_000, 6 * 3600 * 16_000
FRAME = 3600 * 16_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a small file over all cores, as what is done to each text is long."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def spans(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """A span per event: its user is the stream, its time the start, its value the length; more columns of the event if asked for."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    start = F.call_function("div", micros * 16, F.lit(1000).cast("bigint"))
    length = F.round(F.col("value") * 100).cast("bigint") * (16_000 * 6)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.row_number().over(order).cast("bigint").alias("seq"), start.alias("start_sample"), (start + length).alias("end_sample"), *more)


SPANS_SQL = """spans AS (
  SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
    (date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) * 16) // 1000 AS start_sample,
    (date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) * 16) // 1000 + CAST(round(value * 100) AS BIGINT) * 96000 AS end_sample
  FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip per embedding label, a frame per vector, its components as logits."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("clip_id"), (F.row_number().over(order) - 1).alias("frame"), F.col("embedding").alias("logits"))


FRAMES_SQL = """frames AS (
  SELECT CAST(label AS BIGINT) AS clip_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding AS logits FROM embeddings)"""

#: Tokens of every clip: letters, two separators (4), a wildcard and a repeated letter.
TOKENS = [5, 9, 14, 4, 21, -1, 30, 30, 4, 8, 17]
WORD_IDX = [0, 0, 0, None, 1, 1, 1, 1, None, 2, 2]
BLANK = 0


def clip_tokens(frames: DataFrame) -> DataFrame:
    ids, words = F.array(*(F.lit(t) for t in TOKENS)), F.array(*(F.lit(w).cast("int") for w in WORD_IDX))
    return frames.select("clip_id").distinct().withColumns({"token_ids": ids, "word_idx": words})


#: Log-probabilities as the engine makes them: shifted, in double, then single precision.
LOG_PROBS_SQL = f"""{FRAMES_SQL}, tops AS (
  SELECT clip_id, frame, list_transform(logits, lambda x: CAST(x AS DOUBLE)) AS x, CAST(list_max(logits) AS DOUBLE) AS top FROM frames
), sums AS (
  SELECT clip_id, frame, x, top, ln(list_sum(list_transform(x, lambda v: exp(v - top)))) AS rest FROM tops
), lps AS (
  SELECT clip_id, frame, list_transform(x, lambda v: CAST((v - top) - rest AS FLOAT)) AS lp FROM sums)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per order: the customer modulo 97 is the stream, and the priority stands for the language (none for 5-LOW)."""
    order = Window.partitionBy("stream_id").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("stream_id", F.col("o_custkey") % 97)
    return rows.select("stream_id", (F.row_number().over(order) - 1).cast("bigint").alias("chunk_id"), F.when(F.col("o_orderpriority") != "5-LOW", F.substring("o_orderpriority", 1, 1)).alias("language"), "o_orderstatus", "o_orderkey")


CHUNKS_SQL = """chunks AS (
  SELECT o_custkey % 97 AS stream_id, row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderkey) - 1 AS chunk_id,
    CASE WHEN o_orderpriority <> '5-LOW' THEN substr(o_orderpriority, 1, 1) END AS language, o_orderstatus, o_orderkey FROM orders)"""
