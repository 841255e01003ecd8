"""Sources and sinks: packets, spans, results and emissions as tables or streams, model calls over Arrow, and debug dumps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators import ctc
from spanloom.plans.fold import ensure_importable

PACKETS = "stream_id bigint, seq bigint, pts bigint, tb_num int, tb_den int, samples array<float>"
SPANS = "stream_id bigint, seq bigint, start_sample bigint, end_sample bigint"
RESULTS = "stream_id bigint, chunk_id bigint, attempt int, text string, language string, avg_logprob float, no_speech_prob float, compression_ratio float, segments int"
FRAMES = "clip_id bigint, frame int, lp array<float>"


def read(spark: SparkSession, path: str, schema: str, streaming: bool = False, files_per_trigger: int = 1_000) -> DataFrame:
    """A Parquet table of one of the schemas above; as a stream, a bounded number of files per trigger."""
    if streaming:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return spark.read.schema(schema).parquet(path)


def run_model(chunks: DataFrame, call: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """A caller's model over Arrow batches of chunks, such as a recogniser or an acoustic encoder. Filter chunks before: nothing is pushed through a model."""
    ensure_importable(chunks.sparkSession)
    return chunks.mapInArrow(call, schema)


def write_events(events: DataFrame, path: str) -> None:
    """Transcripts and errors, by kind."""
    events.write.mode("append").partitionBy("kind").parquet(path)


def dump(frames: DataFrame, path: str, enabled: bool = False) -> bool:
    """Debug dump of emissions or trellis cells as Parquet; only where asked for."""
    if enabled:
        frames.write.mode("overwrite").parquet(path)
    return enabled


def dump_alignment(frames: DataFrame, tokens: DataFrame, path: str, blank: int = 0, enabled: bool = False) -> bool:
    """Debug dump of an alignment as three tables: the emissions, the trellis, and what describes each clip; only where asked for."""
    if enabled:
        sizes = frames.groupBy("clip_id").agg(F.count("*").alias("frames"), F.max(F.size("lp")).alias("vocab"))
        about = tokens.select("clip_id", "token_ids").join(sizes, "clip_id", "left").withColumn("blank", F.lit(blank))
        for name, rows in {"emissions": frames.select("clip_id", "frame", "lp"), "trellis": ctc.trellis_rows(frames, tokens, blank), "clips": about}.items():
            dump(rows, f"{path}/{name}", True)
    return enabled
