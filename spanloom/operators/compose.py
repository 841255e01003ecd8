"""From aligned words in frames to timed words in samples, without those that silence contradicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.clock import max_silent_frames
from spanloom.operators.intervals import frame_runs


def compose_words(words: DataFrame, clips: DataFrame, frames: DataFrame, surfaces: DataFrame, coverage: float = 0.5, hop: int = 320) -> DataFrame:
    """clip_id, word_index, text, start_sample, end_sample, score and drop_reason (null: kept) of every aligned word.

    words: clip_id, word_index, start_frame, end_frame, score. clips: clip_id, frames, spf,
    first_sample, real_samples, chunk_end. frames: clip_id, frame, is_speech. surfaces: clip_id,
    word_index, text. The first rule that a word breaks is its reason.
    """
    met = words.join(clips, "clip_id").join(surfaces, ["clip_id", "word_index"], "left")
    spread = met.where((F.col("end_frame") > F.col("start_frame")) & (F.col("end_frame") <= F.col("frames")))
    spread = spread.select("clip_id", "word_index", "start_frame", F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("frame"))
    runs = frame_runs(spread.join(frames.select("clip_id", "frame", "is_speech"), ["clip_id", "frame"]), ["clip_id", "word_index", "start_frame"])
    return _judged(met.join(runs, ["clip_id", "word_index", "start_frame"], "left"), coverage, hop)


def compose_by_runs(words: DataFrame, clips: DataFrame, runs: DataFrame, surfaces: DataFrame, coverage: float = 0.5, hop: int = 320) -> DataFrame:
    """As compose_words, from runs of speech as intervals.speech_runs gives them, so no word becomes a row a frame.

    Half of a word's frames at least must be speech: under that, silence between the samples of frames
    shorter than a sample could matter, which runs don't tell.
    """
    if coverage < 0.5:
        raise ValueError("coverage must be 0.5 at least")
    met = words.join(clips.join(runs, "clip_id", "left"), "clip_id").join(surfaces, ["clip_id", "word_index"], "left")
    begin, stop = F.col("start_frame").cast("bigint"), F.col("end_frame").cast("bigint")
    edge = lambda f: F.round(f * F.col("spf")).cast("bigint")
    inside = lambda held, a, b, lo, hi: F.filter(F.transform(F.coalesce(held, F.array()), lambda x: F.struct(F.greatest(x[a], lo).alias("a"), F.least(x[b], hi).alias("b"))), lambda x: x["a"] < x["b"])
    total = lambda parts: F.aggregate(parts, F.lit(0).cast("bigint"), lambda t, x: t + x["b"] - x["a"])
    met = met.withColumn("_runs", inside(F.col("runs"), "begin", "stop", begin, stop))
    met = met.withColumn("_spans", F.when(F.col("spf") < 1, inside(F.col("spans"), "start", "end", edge(begin), edge(stop))))
    gaps = F.transform("_runs", lambda r, i: r["a"] - F.coalesce(F.get("_runs", i - 1)["b"], begin))
    silent = F.greatest(F.array_max(F.concat(gaps, F.array(F.lit(0).cast("bigint")))), stop - F.coalesce(F.try_element_at("_runs", F.lit(-1))["b"], begin))
    rows = met.withColumns({"speech_frames": total(F.coalesce("_spans", "_runs")), "longest_silence": silent})
    return _judged(rows.withColumn("coverage", (F.col("speech_frames") / F.when(stop > begin, stop - begin)).cast("float")), coverage, hop)


def _judged(rows: DataFrame, coverage: float, hop: int) -> DataFrame:
    """Words in samples, each with the first rule that it breaks."""
    limit = max_silent_frames(hop=hop)
    at = lambda f: F.col("first_sample") + F.round(F.col(f) * F.col("spf")).cast("bigint")
    start, end = at("start_frame"), at("end_frame")
    clamped = F.least(end, F.col("first_sample") + F.col("real_samples"))
    reason = (
        F.when(F.col("text").isNull(), "unknown_word")
        .when(F.col("end_frame") <= F.col("start_frame"), "empty_span")
        .when((F.col("start_frame") < 0) | (F.col("end_frame") > F.col("frames")), "outside_mask")
        .when(F.col("speech_frames") == 0, "no_speech")
        .when(F.col("coverage") < F.lit(coverage).cast("float"), "low_coverage")
        .when(F.col("longest_silence") > limit, "long_silence")
        .when((start >= F.col("chunk_end")) | (end <= start), "overshoot")
        .when(clamped <= start, "clamped_empty")
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan("score"), 0.0).otherwise(F.col("score")))).cast("float")
    return rows.select("clip_id", "word_index", "text", start.alias("start_sample"), clamped.alias("end_sample"), score.alias("score"), reason.alias("drop_reason"))


def ordered_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a chunk by time, stably: adds position, by start, end and the order in which runs gave them."""
    order = Window.partitionBy(*keys).orderBy("start_pts", "end_pts", "emitted")
    return words.withColumn("position", F.row_number().over(order) - 1)


def events(transcripts: DataFrame, errors: DataFrame) -> DataFrame:
    """Transcripts and errors of streams as one table with a kind."""
    return transcripts.withColumn("kind", F.lit("transcript")).unionByName(errors.withColumn("kind", F.lit("error")), allowMissingColumns=True)
