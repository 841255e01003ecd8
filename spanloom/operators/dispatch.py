"""What happens to cut chunks: retries, the language lock, admission, and ordered emission."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.plans.fold import ordered_fold


@dataclass(frozen=True)
class Ladder:
    """Temperatures to try and the gates that an attempt must pass."""

    initial: float = 0.0
    step: float = 0.2
    attempts: int = 6
    log_prob: float = -1.0
    compression: float = 2.4
    no_speech: float = 0.6

    def temperatures(self) -> list[float]:
        """The temperatures that stay within [0, 1], added up in single precision."""
        out, t = [], np.float32(self.initial)
        for _ in range(self.attempts):
            if not 0 <= t <= 1:
                break
            out.append(float(t))
            t = np.float32(t + np.float32(self.step))
        return out


def attempt_verdict(ladder: Ladder, segments: Column, log_prob: Column, no_speech: Column, compression: Column) -> Column:
    """accept, accept_empty or null (try the next temperature)."""
    silent = (no_speech > ladder.no_speech) & (log_prob < ladder.log_prob)
    return F.when(segments == 0, "accept_empty").when(silent, "accept_empty").when((log_prob >= ladder.log_prob) & (compression <= ladder.compression), "accept")


def first_accepted(attempts: DataFrame, ladder: Ladder, keys: list[str]) -> DataFrame:
    """For each chunk the first attempt that is accepted, or a failure row.

    attempts: keys, attempt (from 0), segments, avg_logprob, no_speech_prob, compression_ratio,
    text, language. Attempts beyond the ladder don't count.
    """
    within = attempts.where(F.col("attempt") < len(ladder.temperatures()))
    verdict = attempt_verdict(ladder, F.col("segments"), F.col("avg_logprob"), F.col("no_speech_prob"), F.col("compression_ratio"))
    judged = within.withColumn("verdict", verdict)
    row = F.struct("attempt", "verdict", "text", "language")
    best = judged.groupBy(*keys).agg(F.min(F.when(F.col("verdict").isNotNull(), row)).alias("best"))
    text = F.when(F.col("best.verdict") == "accept", F.col("best.text")).otherwise("")
    temperature = F.element_at(F.array(*(F.lit(t) for t in ladder.temperatures())), F.col("best.attempt").cast("int") + 1)
    return best.select(
        *keys,
        F.when(F.col("best").isNull(), "all_temperatures_exhausted").otherwise(F.col("best.verdict")).alias("status"),
        F.col("best.attempt").alias("attempt"),
        F.when(F.col("best").isNotNull(), temperature).alias("temperature"),
        F.when(F.col("best").isNotNull(), text).alias("text"),
    )


def language_lock(resolved: DataFrame, n: int) -> DataFrame:
    """stream_id, language, observed: the mode of each stream's first n observations, ties to the earliest; null until there are n.

    resolved: stream_id, chunk_id (gap-free from 0 within what is resolved) and language, null if a
    chunk's text was empty or failed. Only the contiguous prefix of resolved chunks counts.
    """
    order = Window.partitionBy("stream_id").orderBy("chunk_id")
    prefix = resolved.withColumn("_nth", F.row_number().over(order) - 1).where(F.col("_nth") == F.col("chunk_id"))
    seen = prefix.where(F.col("language").isNotNull()).withColumn("_obs", F.row_number().over(order)).where(F.col("_obs") <= n)
    counted = seen.groupBy("stream_id", "language").agg(F.count("*").alias("c"), F.min("_obs").alias("first"))
    lock = counted.groupBy("stream_id").agg(F.max_by("language", F.struct(F.col("c"), -F.col("first"))).alias("mode"), F.sum("c").alias("observed"))
    return lock.select("stream_id", F.when(F.col("observed") == n, F.col("mode")).alias("language"), "observed")


def in_order(resolved: DataFrame) -> DataFrame:
    """The rows of each stream that can be emitted: the contiguous prefix of chunk ids, with the place of each in its stream."""
    order = Window.partitionBy("stream_id").orderBy("chunk_id")
    return resolved.withColumn("emit_index", F.row_number().over(order) - 1).where(F.col("emit_index") == F.col("chunk_id"))


def answer_chunks(chunks: DataFrame, answers: DataFrame, phase: str) -> DataFrame:
    """Answers joined to the chunks they name: status accepted, or unknown_chunk for a chunk that isn't there or is in another phase."""
    known = chunks.select("stream_id", "chunk_id", F.col("phase").alias("_phase"))
    met = answers.join(known, ["stream_id", "chunk_id"], "left")
    return met.withColumn("status", F.when(F.col("_phase") == phase, "accepted").otherwise("unknown_chunk")).drop("_phase")


class Admission:
    """Which chunks may start, given a limit in flight and the observation window before the lock."""

    def __init__(self, stream: int, in_flight: int, n: int) -> None:
        self.stream, self.most, self.n = stream, in_flight, n
        self.queue: list[int] = []
        self.started: dict[int, bool] = {}
        self.results: dict[int, str | None] = {}
        self.cursor = self.observed = self.next_id = 0
        self.counts: dict[str, list[int]] = {}
        self.language: str | None = None

    def _promote(self, at: int) -> list[tuple]:
        out = []
        while self.queue and len(self.started) < self.most and (self.language is not None or self.queue[0] < self.cursor + (self.n - self.observed)):
            k = self.queue.pop(0)
            self.started[k] = True
            out.append((self.stream, at, "start", k, self.language))
        return out

    def push(self, row: tuple) -> list[tuple]:
        seq, kind, chunk, language = row
        if kind == "cut":
            self.queue.append(self.next_id)
            self.next_id += 1
            return self._promote(seq)
        if self.started.pop(chunk, None) is None:
            return [(self.stream, seq, "unknown_chunk", chunk, None)]
        if self.language is None:
            self.results[chunk] = language
            while self.language is None and self.cursor in self.results:
                found = self.results.pop(self.cursor)
                self.cursor += 1
                if found is not None:
                    count = self.counts.setdefault(found, [0, -self.observed])
                    count[0] += 1
                    self.observed += 1
                    if self.observed == self.n:
                        self.language = max(self.counts, key=lambda x: self.counts[x])
        return [(self.stream, seq, "resolved", chunk, language), *self._promote(seq)]

    def flush(self) -> list[tuple]:
        return []


ADMISSIONS = "stream_id bigint, seq bigint, action string, chunk_id bigint, language string"
ADMISSION_COLUMNS = ["seq", "kind", "chunk_id", "language"]


def check_admission(max_in_flight: int, observations: int) -> None:
    """ValueError for limits out of range."""
    if not 1 <= max_in_flight <= 4096 or observations < 1:
        raise ValueError("in-flight limit must be 1 to 4096 and observations at least 1")


def admit(events: DataFrame, max_in_flight: int = 6, observations: int = 1) -> DataFrame:
    """Starts and resolutions in order, from rows of kind cut or result (with chunk_id, and language or null): stream_id, seq, action, chunk_id, language hint."""
    check_admission(max_in_flight, observations)
    return ordered_fold(events, "stream_id", ["seq"], ADMISSION_COLUMNS, lambda k: Admission(k, max_in_flight, observations), ADMISSIONS)
