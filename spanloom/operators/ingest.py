"""Appending audio packets to a stream's buffer: contiguity, gap filling, capacity, restart and trimming, as one ordered fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.config import Options
from spanloom.functions.clock import div
from spanloom.plans.fold import ordered_fold

#: Samples of a bucket in which packets and chunks meet: ten seconds.
BUCKET = 160_000

PACKETS = "stream_id bigint, seq bigint, epoch int, status string, first_sample bigint, gap bigint, n_samples bigint, total_samples bigint, live_samples bigint"


def ticks_to_samples(ticks: int, num: int, den: int) -> int:
    """Ticks of a timebase as samples, toward zero."""
    n = abs(ticks) * num * 16_000 // den
    return n if ticks >= 0 else -n


def samples_to_ticks(samples: int, num: int, den: int) -> int:
    """Samples as ticks of a timebase, toward zero."""
    return samples * den // (16_000 * num)


class Buffer:
    """What is known of one stream's buffered audio."""

    def __init__(self, stream: int, cap: int, tolerance: int) -> None:
        self.stream, self.cap, self.tolerance = stream, cap, tolerance
        self.anchor: int | None = None
        self.timebase: tuple[int, int] | None = None
        self.total = self.live = self.trimmed = self.epoch = 0
        self.ended = False

    def _append(self, pts: int, timebase: tuple[int, int], n: int, queued: int) -> tuple[str, int]:
        if self.ended:
            return "after_eof", 0
        if timebase[0] <= 0 or timebase[1] <= 0:
            return "invalid_timebase", 0
        if self.timebase not in (None, timebase):
            return "inconsistent_timebase", 0
        gap = 0
        if self.anchor is not None:
            delta = pts - (self.anchor + samples_to_ticks(self.total, *timebase))
            if delta < 0:
                return "pts_regression", 0
            gap = ticks_to_samples(delta, *timebase)
            if gap > self.tolerance:
                return "gap_exceeds_tolerance", gap
        if self.live + gap + n + queued > self.cap:
            return "backpressure", gap
        if n == 0:
            return "accepted", 0
        if self.anchor is None:
            self.anchor, self.timebase = pts, timebase
        self.total += gap + n
        self.live += gap + n
        return "accepted", gap

    def push(self, row: tuple) -> list[tuple]:
        seq, kind, pts, num, den, n, queued = row
        first = self.total
        needed = {"packet": (pts, num, den, n), "trim": (n,), "restart": (), "eof": ()}.get(kind)
        if needed is None or None in needed:
            return [(self.stream, seq, self.epoch, "unknown_kind" if needed is None else "missing_value", None, 0, 0, self.total, self.live)]
        if kind == "restart":
            if self.timebase is not None and (num, den) != self.timebase:
                return [(self.stream, seq, self.epoch, "inconsistent_timebase", None, 0, 0, self.total, self.live)]
            self.anchor, self.total, self.live, self.trimmed, self.epoch, self.ended = None, 0, 0, 0, self.epoch + 1, False
            return [(self.stream, seq, self.epoch, "accepted", None, 0, 0, 0, 0)]
        if kind == "eof":
            self.ended = True
            return [(self.stream, seq, self.epoch, "accepted", None, 0, 0, self.total, self.live)]
        if kind == "trim":
            gone = max(0, min(n, self.total) - self.trimmed)
            self.trimmed, self.live = self.trimmed + gone, self.live - gone
            return [(self.stream, seq, self.epoch, "accepted", None, 0, 0, self.total, self.live)]
        status, gap = self._append(pts, (num, den), n, queued or 0)
        good = status == "accepted" and n > 0
        return [(self.stream, seq, self.epoch, status, first + gap if good else None, gap, n if good else 0, self.total, self.live)]

    def flush(self) -> list[tuple]:
        return []


COLUMNS = ["seq", "kind", "pts", "tb_num", "tb_den", "n_samples", "queued"]


def inputs(packets: DataFrame) -> DataFrame:
    """Packets with the optional columns filled in."""
    add = {"kind": F.lit("packet"), "queued": F.lit(0).cast("bigint")}
    return packets.withColumns({k: v for k, v in add.items() if k not in packets.columns})


def append_packets(packets: DataFrame, options: Options | None = None) -> DataFrame:
    """Outcome of every packet in order: status, where its samples begin, the gap filled before them, and the buffer after it.

    packets: stream_id, seq, pts, tb_num, tb_den, n_samples, and optionally queued (samples waiting
    elsewhere) and kind: packet (default), trim (up to sample n_samples), eof or restart. A packet
    that isn't accepted changes nothing, which holds for rows of no known kind or without a value that
    their kind needs as well. Samples themselves stay in their own table; this is the
    index over them.
    """
    options = options or Options()
    return ordered_fold(inputs(packets), "stream_id", ["seq"], COLUMNS, lambda k: Buffer(k, options.cap_samples, options.gap_tolerance), PACKETS)


def chunk_audio(samples: Column, start: Column, end: Column, dropped: Column) -> Column:
    """A chunk's samples from a buffer whose first `dropped` samples are trimmed."""
    return F.slice(samples, (start - dropped + 1).cast("int"), (end - start).cast("int"))


def chunk_samples(packets: DataFrame, chunks: DataFrame, keys: list[str], low_water: DataFrame | None = None, bucket: int = BUCKET) -> DataFrame:
    """keys, chunk_id, status and samples of every chunk: the packets' samples in order, zeros where none came.

    packets: keys, first_sample and samples, as append_packets places them (they never overlap; those
    without samples or place don't count). chunks: keys, chunk_id, start_sample and end_sample.
    low_water: keys and low_water, up to where samples are trimmed. A chunk is bad_bounds without a
    positive length, trimmed if it begins below low water, ahead_of_audio if it ends beyond what has
    come, and has no samples then.

    Packets and chunks meet by buckets of time, each pair in the one bucket in which its overlap
    begins, so no chunk meets the whole of its stream. Only a chunk's own samples come together in a
    row: as many as the cut's limit allows.
    """
    first, end = F.col("first_sample"), F.col("first_sample") + F.size("samples")
    held = packets.where(F.col("first_sample").isNotNull() & (F.size("samples") > 0)).select(*keys, "first_sample", "samples")
    known = chunks.select(*keys, "chunk_id", "start_sample", "end_sample").join(held.groupBy(*keys).agg(F.max(end).alias("_total")), keys, "left")
    water = F.lit(0).cast("bigint")
    if low_water is not None:
        known, water = known.join(low_water.groupBy(*keys).agg(F.max("low_water").alias("_water")), keys, "left"), F.coalesce("_water", F.lit(0))
    sound = F.coalesce((F.col("start_sample") >= 0) & (F.col("end_sample") > F.col("start_sample")), F.lit(False))
    status = F.when(~sound, "bad_bounds").when(F.col("start_sample") < water, "trimmed").when(F.col("end_sample") > F.coalesce("_total", F.lit(0)), "ahead_of_audio").otherwise("ok")
    judged = known.withColumn("status", status).select(*keys, "chunk_id", "start_sample", "end_sample", "status")
    buckets = lambda a, b: F.explode(F.sequence(div(a, F.lit(bucket)), div(b - 1, F.lit(bucket))))
    left = judged.where("status = 'ok'").withColumn("_bucket", buckets(F.col("start_sample"), F.col("end_sample")))
    lo, hi = F.greatest(first, "start_sample"), F.least(end, F.col("end_sample"))
    met = left.join(held.withColumn("_bucket", buckets(first, end)), [*keys, "_bucket"]).where((hi > lo) & (div(lo, F.lit(bucket)) == F.col("_bucket")))
    piece = F.struct(lo.alias("at"), F.slice("samples", (lo - first + 1).cast("int"), (hi - lo).cast("int")).alias("samples"))
    pieces = met.groupBy(*keys, "chunk_id").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))
    stop = lambda x: x["at"] + F.size(x["samples"])
    filled = F.transform("_pieces", lambda x, i: F.concat(zeros(x["at"] - F.when(i == 0, F.col("start_sample")).otherwise(stop(F.get("_pieces", i - 1)))), x["samples"]))
    whole = F.concat(F.flatten(filled), zeros(F.col("end_sample") - stop(F.element_at("_pieces", -1))))
    silent = F.coalesce(whole, zeros(F.col("end_sample") - F.col("start_sample")))
    found = judged.join(pieces, [*keys, "chunk_id"], "left")
    return found.select(*keys, "chunk_id", "status", F.when(F.col("status") == "ok", silent).alias("samples"))


def buffered(state: DataFrame) -> DataFrame:
    """Per stream: live samples, chunks in flight, and whether it is idle. state: stream_id, live_samples, in_flight, queued."""
    return state.groupBy("stream_id").agg(
        F.sum("live_samples").alias("buffered_samples"), F.sum("in_flight").alias("in_flight"), (F.sum(F.col("in_flight") + F.col("queued")) == 0).alias("is_idle")
    )
