"""Cutting voice-activity spans into bounded chunks: sessions with a size limit, an optional gap limit and a split of oversize spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.clock import div
from spanloom.plans.fold import ordered_fold

SUBS = "array<struct<start:bigint,end:bigint,kind:string,vad_seq:int,part:int,total_parts:int>>"
CHUNKS = f"stream_id bigint, chunk_id bigint, start_sample bigint, end_sample bigint, override_at_start string, subs {SUBS}"
OUTCOMES = "stream_id bigint, seq bigint, status string, watermark bigint"


@dataclass
class Cutter:
    """The open chunk of one stream."""

    limit: int
    gap: int | None = None
    start: int | None = None
    end: int = 0
    subs: list[tuple] = field(default_factory=list)
    override_at_start: str | None = None
    next_seq: int = 0

    def _take(self) -> tuple:
        done = (self.start, self.end, self.override_at_start, self.subs)
        self.start, self.subs, self.override_at_start = None, [], None
        return done

    def split(self, start: int, end: int) -> list[tuple]:
        """A span as sub-spans: one, or equal integer parts if it is longer than the limit."""
        seq, self.next_seq = self.next_seq, self.next_seq + 1
        length = end - start
        if length <= self.limit:
            return [(start, end, "vad", seq, None, None)]
        n = -(-length // self.limit)
        edges = [start + i * length // n for i in range(n)] + [end]
        return [(a, b, "hard_split", seq, i, n) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]

    def push(self, start: int, end: int, override: str | None = None) -> Iterator[tuple]:
        """Add a span; gives the chunks that it closes."""
        for sub in self.split(start, end):
            opened, grown = self.start is not None, self.start is not None and self.end > self.start
            if opened and grown and ((self.gap is not None and sub[0] - self.end > self.gap) or sub[1] - self.start > self.limit):
                yield self._take()
            if self.start is None:
                self.start, self.end, self.override_at_start = sub[0], sub[0], override
            self.end = sub[1]
            self.subs.append(sub)

    def would_flush_at(self, start: int) -> bool:
        """Whether a span from `start` on would first close the open chunk for its gap."""
        return self.gap is not None and self.start is not None and self.end > self.start and start - self.end > self.gap

    def flush(self) -> Iterator[tuple]:
        if self.start is not None:
            yield self._take()


@dataclass
class Acceptance:
    """Which spans a stream accepts: ordered, ahead of nothing, and not after its end. Rejections change nothing."""

    watermark: int = 0
    high_water: int | None = None
    ended: bool = False

    def judge(self, kind: str | None, start: int | None, end: int | None) -> str:
        """Status of an input row, with the watermark moved if it is accepted. Rows of no known kind, or without the bounds that their kind needs, change nothing."""
        if self.ended:
            return "accepted" if kind == "eof" else "after_eof"
        if kind == "eof":
            self.ended = True
            return "accepted"
        if kind not in ("vad", "no_speech"):
            return "unknown_kind"
        if end is None or (kind == "vad" and start is None):
            return "missing_bounds"
        if kind == "no_speech":
            if end < self.watermark:
                return "vad_regression"
            if self.high_water is not None and end > self.high_water:
                return "vad_ahead_of_audio"
            self.watermark = end
            return "accepted"
        if end <= start:
            return "invalid_span"
        if self.high_water is not None and end > self.high_water:
            return "vad_ahead_of_audio"
        if start < self.watermark:
            return "vad_regression"
        self.watermark = end
        return "accepted"


class _CutState:
    def __init__(self, stream: int, limit: int, gap: int | None) -> None:
        self.stream, self.limit, self.gap = stream, limit, gap
        self.rules, self.cutter, self.next_id = Acceptance(), Cutter(limit, gap), 0

    def _numbered(self, chunks: Iterator[tuple]) -> list[tuple]:
        out = []
        for start, end, override, subs in chunks:
            out.append((self.stream, self.next_id, start, end, override, subs))
            self.next_id += 1
        return out

    def push(self, row: tuple) -> list[tuple]:
        kind, start, end, override, high_water = row
        if high_water is not None:
            self.rules.high_water = high_water
        if kind == "restart":
            done = self._numbered(self.cutter.flush())
            self.rules, self.cutter = Acceptance(), Cutter(self.limit, self.gap)
            return done
        if self.rules.judge(kind, start, end) != "accepted":
            return []
        if kind == "eof" or (kind == "no_speech" and self.cutter.would_flush_at(end)):
            return self._numbered(self.cutter.flush())
        return self._numbered(self.cutter.push(start, end, override)) if kind == "vad" else []

    def flush(self) -> list[tuple]:
        return self._numbered(self.cutter.flush())


class _OutcomeState:
    def __init__(self, stream: int) -> None:
        self.stream, self.rules = stream, Acceptance()

    def push(self, row: tuple) -> list[tuple]:
        seq, kind, start, end, high_water = row
        if high_water is not None:
            self.rules.high_water = high_water
        if kind == "restart":
            self.rules = Acceptance()
            return [(self.stream, seq, "accepted", 0)]
        return [(self.stream, seq, self.rules.judge(kind, start, end), self.rules.watermark)]

    def flush(self) -> list[tuple]:
        return []


def inputs(spans: DataFrame) -> DataFrame:
    """Input rows of a stream with the optional columns filled in.

    stream_id, seq, start_sample and end_sample are needed. kind is vad (default), no_speech (its
    end is how far there is no speech), eof or restart; override is the parameter set that a chunk
    opened by the row gets; high_water is how far audio has come.
    """
    have = set(spans.columns)
    add = {"kind": F.lit("vad"), "override": F.lit(None).cast("string"), "high_water": F.lit(None).cast("bigint")}
    return spans.withColumns({k: v for k, v in add.items() if k not in have})


def cut(spans: DataFrame, limit: int, gap: int | None = None) -> DataFrame:
    """Chunks of each stream, in the order of seq; ids are gap-free from 0. Rows that acceptance rejects are left out."""
    if limit < 1:
        raise ValueError("a chunk holds at least one sample")
    return ordered_fold(inputs(spans), "stream_id", ["seq"], ["kind", "start_sample", "end_sample", "override", "high_water"], lambda k: _CutState(k, limit, gap), CHUNKS)


def outcomes(spans: DataFrame) -> DataFrame:
    """Status of every input row, and the watermark after it."""
    return ordered_fold(inputs(spans), "stream_id", ["seq"], ["seq", "kind", "start_sample", "end_sample", "high_water"], _OutcomeState, OUTCOMES)


def hard_split(spans: DataFrame, limit: int) -> DataFrame:
    """Every span longer than the limit as equal integer parts, others as one: adds part, total_parts, part_start and part_end."""
    length = F.col("end_sample") - F.col("start_sample")
    n = F.greatest(F.lit(1), div(length + F.lit(limit - 1), F.lit(limit)))
    parts = spans.withColumn("total_parts", n.cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("total_parts") - 1)))
    edge = lambda i: F.col("start_sample") + div(i * length, F.col("total_parts").cast("bigint"))
    last = F.col("part") == F.col("total_parts") - 1
    return parts.withColumn("part_start", edge(F.col("part"))).withColumn("part_end", F.when(last, F.col("end_sample")).otherwise(edge(F.col("part") + 1)))


def precheck_packets(spans: DataFrame, packet: Column) -> DataFrame:
    """Whether all spans of a packet can be accepted together: valid, in order after the packet's watermark, and within its audio.

    spans: stream_id, packet_id, watermark and high_water (before and after the packet), start_sample, end_sample.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("stream_id", packet).orderBy("start_seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.col("watermark"), F.coalesce(F.max("end_sample").over(w), F.col("watermark")))
    good = (F.col("end_sample") > F.col("start_sample")) & (F.col("start_sample") >= before) & (F.col("end_sample") <= F.col("high_water"))
    return spans.withColumn("_good", good).groupBy("stream_id", packet).agg(F.bool_and("_good").alias("accepted"), F.count("*").alias("n_spans"))
