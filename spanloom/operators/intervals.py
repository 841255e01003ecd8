"""Interval algebra over (key, start, end) rows: union, clipping, overlap with frames, runs and coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.clock import div
from spanloom.functions.numeric import let, moments


def union_intervals(spans: DataFrame, key: str = "clip_id") -> DataFrame:
    """Sorted, disjoint spans of each key: empty ones go, overlapping and touching ones merge."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.where(F.col("end") > F.col("start")).withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def clip_to_slices(spans: DataFrame, width: int) -> DataFrame:
    """Spans cut at multiples of width and counted from the slice's start: adds slice.

    Which slices a span meets is arithmetic, so no join is needed.
    """
    first, last = div(F.col("start"), F.lit(width)), div(F.col("end") - 1, F.lit(width))
    hit = spans.where(F.col("end") > F.col("start")).withColumn("slice", F.explode(F.sequence(first, last)))
    lo, hi = F.col("slice") * width, (F.col("slice") + 1) * width
    return hit.withColumn("start", F.greatest("start", lo) - lo).withColumn("end", F.least("end", hi) - lo)


def clip_array(spans: Column, lo: Column, hi: Column) -> Column:
    """An array of (start, end) structs cut to [lo, hi) and counted from lo."""
    cut = F.transform(spans, lambda s: F.struct((F.greatest(s["start"], lo) - lo).alias("start"), (F.least(s["end"], hi) - lo).alias("end")))
    return F.filter(cut, lambda s: s["end"] > s["start"])


def union_array(spans: Column) -> Column:
    """An array of (start, end) structs as sorted, disjoint ones."""
    kept = F.array_sort(F.filter(spans, lambda s: s["end"] > s["start"]))

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(kept, F.slice(kept, 1, 0), merge)


def speech_threshold(real_width: Column, spf: Column) -> Column:
    """Overlap from which a frame counts as speech: half its real width or half a nominal frame, whichever is less, at least 1."""
    half = lambda x: F.greatest(F.lit(1).cast("bigint"), div(x, F.lit(2).cast("bigint")) + x % 2)
    nominal = half(F.floor(spf).cast("bigint"))
    return F.when(real_width > 0, F.least(half(real_width), nominal)).otherwise(nominal)


def speech_frames(clips: DataFrame, spans: DataFrame) -> DataFrame:
    """clip_id, frame, overlap and is_speech of every frame.

    clips: clip_id, frames, spf (samples of a frame) and real_samples. spans: clip_id, start and end,
    disjoint. The frames that a span touches are arithmetic in its bounds, so the overlap is an
    explode and a sum. A clip whose spf isn't positive and finite has no speech.
    """
    edge = lambda f: F.round(f * F.col("spf")).cast("bigint")
    sound = clips.where((F.col("spf") > 0) & (F.col("spf") < float("inf")))
    met = spans.join(sound, "clip_id").withColumn("end", F.least("end", "real_samples")).where(F.col("end") > F.col("start"))
    first = F.floor(F.col("start") / F.col("spf")).cast("bigint")
    last = F.least(F.ceil(F.col("end") / F.col("spf")).cast("bigint"), F.col("frames")) - 1
    touched = met.where(first <= last).withColumn("frame", F.explode(F.sequence(first, last)))
    part = F.least("end", edge(F.col("frame") + 1)) - F.greatest("start", edge(F.col("frame")))
    overlap = touched.groupBy("clip_id", "frame").agg(F.sum(F.greatest(F.lit(0).cast("bigint"), part)).alias("overlap"))
    every = clips.where(F.col("frames") > 0).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("frames") - 1)))
    width = F.least(edge(F.col("frame") + 1), F.col("real_samples")) - F.least(edge(F.col("frame")), F.col("real_samples"))
    found = every.join(overlap, ["clip_id", "frame"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("bigint")))
    sane = (F.col("spf") > 0) & (F.col("spf") < float("inf"))
    speech = sane & (F.col("overlap") > 0) & (F.col("overlap") >= speech_threshold(width, F.col("spf")))
    return found.select("clip_id", "frame", "overlap", F.coalesce(speech, F.lit(False)).alias("is_speech"))


def speech_runs(clips: DataFrame, spans: DataFrame) -> DataFrame:
    """clip_id, runs (begin, stop: frames) and spans (start, end: samples), as sorted arrays, of every clip with speech.

    clips and spans as for speech_frames. The same frames are speech, but rows are as many as spans, not
    frames: a span's inner frames lie in it whole, so only the two at its ends are judged. Where a frame is
    shorter than a sample, a run also holds the frames without a sample between those with one.
    """
    sound = clips.where((F.col("spf") > 0) & (F.col("spf") < float("inf"))).select("clip_id", "frames", "spf", "real_samples")
    met = spans.select("clip_id", "start", "end").join(sound, "clip_id").withColumn("end", F.least("end", "real_samples")).where(F.col("end") > F.col("start"))
    edge = lambda f: F.round(f * F.col("spf")).cast("bigint")

    def frame_of(sample: Column) -> Column:
        near = F.ceil((sample + F.lit(0.5)) / F.col("spf")).cast("bigint") - 2
        return F.when(edge(near + 1) > sample, near).when(edge(near + 2) > sample, near + 1).otherwise(near + 2)

    met = met.withColumns({"_first": frame_of(F.col("start")), "_last": frame_of(F.col("end") - 1)})
    short = F.col("spf") < 1
    run = lambda a, b: [F.col("clip_id"), a.alias("start"), F.least(b, F.col("frames")).alias("end")]
    inner = met.select(*run(F.when(short, F.col("_first")).otherwise(F.col("_first") + 1), F.when(short, F.col("_last") + 1).otherwise(F.col("_last"))))
    ends = met.where(~short).withColumn("frame", F.explode(F.array_distinct(F.array("_first", "_last")))).where("frame < frames")
    part = F.least("end", edge(F.col("frame") + 1)) - F.greatest("start", edge(F.col("frame")))
    width = F.least(edge(F.col("frame") + 1), F.col("real_samples")) - F.least(edge(F.col("frame")), F.col("real_samples"))
    judged = ends.groupBy("clip_id", "frame", "frames", "spf", "real_samples").agg(F.sum(part).alias("overlap")).where(F.col("overlap") >= speech_threshold(width, F.col("spf")))
    found = union_intervals(inner.unionByName(judged.select(*run(F.col("frame"), F.col("frame") + 1))))
    runs = found.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").alias("begin"), F.col("end").alias("stop")))).alias("runs"))
    return runs.join(met.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), "clip_id")


def frame_runs(frames: DataFrame, group: list[str]) -> DataFrame:
    """speech_frames, total_frames, coverage (float) and longest_silence of each group's frames, in order of frame."""
    order = Window.partitionBy(*group).orderBy("frame")
    changed = F.when(F.col("is_speech") == F.lag("is_speech").over(order), 0).otherwise(1)
    runs = frames.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = runs.groupBy(*group, "_run").agg(F.count("*").alias("n"), F.bool_and("is_speech").alias("speech"))
    return lengths.groupBy(*group).agg(
        F.sum(F.when(F.col("speech"), F.col("n")).otherwise(0)).alias("speech_frames"),
        F.sum("n").alias("total_frames"),
        (F.sum(F.when(F.col("speech"), F.col("n")).otherwise(0)) / F.sum("n")).cast("float").alias("coverage"),
        F.max(F.when(~F.col("speech"), F.col("n")).otherwise(0)).alias("longest_silence"),
    )


def mask_samples(samples: Column, spans: Column) -> Column:
    """Samples with silence, all outside the spans, set to zero."""
    return voiced(samples, spans, lambda part: part)


def voiced(samples: Column, spans: Column, of_part: Callable[[Column], Column]) -> Column:
    """of_part of the samples inside each span, zeros between: the spans' samples are sliced out once, however many spans there are."""
    n = F.size(samples)
    zeros = lambda k: F.array_repeat(F.lit(0.0).cast("float"), k.cast("int"))

    def of_spans(held: Column) -> Column:
        before = lambda i: F.coalesce(F.get(held, i - 1)["end"], F.lit(0))
        parts = F.transform(held, lambda p, i: F.concat(zeros(p["start"] - before(i)), of_part(F.slice(samples, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")))))
        return F.concat(F.flatten(parts), zeros(n - F.coalesce(F.try_element_at(held, F.lit(-1))["end"], F.lit(0))))

    return let(union_array(clip_array(spans, F.lit(0), n)), of_spans)


def standardize_masked(samples: Column, spans: Column, epsilon: float = 1e-7) -> Column:
    """Samples with zero mean and unit variance by those inside the spans alone; the others become zero."""
    held = union_array(clip_array(spans, F.lit(0), F.size(samples)))
    inside = F.flatten(F.transform(held, lambda p: F.slice(samples, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))))
    scaled = lambda m: voiced(samples, spans, lambda part: F.transform(part, lambda x: ((x.cast("double") - m["mean"]) / F.sqrt(m["var"] + epsilon)).cast("float")))
    return let(let(inside, moments), scaled)


def pad_samples(samples: Column, least: int = 400) -> Column:
    """Samples with zeros after them up to the encoder's least input."""
    return F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(least) - F.size(samples))))
