"""What a recogniser answers: segment statistics, the compression gate, parameters and their overrides."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from spanloom.plans.fold import ensure_importable

MIN_FLOAT = float(np.finfo(np.float32).min)
COMPRESSION_LEAST = 32


def segment_statistics(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """avg_logprob: the mean over segments of the mean over their tokens, the least float without any.

    tokens: keys, segment, logprob. It is a mean of means, not one over all tokens.
    """
    per = tokens.groupBy(*keys, "segment").agg(F.avg("logprob").alias("m"))
    return per.groupBy(*keys).agg(F.coalesce(F.avg("m"), F.lit(MIN_FLOAT)).alias("avg_logprob"), F.count("*").alias("segments"))


def no_speech(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Mean no-speech probability of the segments, 0 without any."""
    return segments.groupBy(*keys).agg(F.coalesce(F.avg("no_speech_prob"), F.lit(0.0)).alias("no_speech_prob"))


def joined_text(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The segments' texts in order, put together and trimmed."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: F.coalesce(s["text"], F.lit("")))
    return segments.groupBy(*keys).agg(F.trim(F.array_join(parts, "")).alias("text"))


def compression_ratio(rows: DataFrame, text: str = "text", name: str = "compression_ratio") -> DataFrame:
    """rows with the text's bytes over its deflated bytes; 0 below 32 bytes. Spark has no such function, so it runs over Arrow batches."""
    ensure_importable(rows.sparkSession)

    @pandas_udf("float")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch]
            yield pd.Series([0.0 if len(b) < COMPRESSION_LEAST else len(b) / len(zlib.compress(b, 6)) for b in raw], dtype="float32")

    return rows.withColumn(name, ratio(F.col(text)))


@dataclass(frozen=True)
class Params:
    """Decoding parameters; validated when a plan is built."""

    language: str | None = None
    prompt: str | None = None
    threads: int = 4
    best_of: int = 5
    beam_size: int = 5
    patience: float = -1.0
    temperature: float = 0.0
    temperature_step: float = 0.2
    max_attempts: int = 6
    log_prob_threshold: float = -1.0
    compression_threshold: float = 2.4
    no_speech_threshold: float = 0.6

    def validate(self) -> Params:
        """Itself, or ValueError for the first parameter out of range."""
        checks = {
            "language": self.language is None or (self.language.isascii() and self.language.isalpha() and 1 <= len(self.language) <= 8),
            "prompt": self.prompt is None or "\0" not in self.prompt,
            "threads": self.threads >= 1,
            "best_of": self.best_of >= 1,
            "beam_size": self.beam_size >= 1,
            "patience": self.patience == -1.0 or (math.isfinite(self.patience) and self.patience > 0),
            "temperature": 0 <= self.temperature <= 1,
            "temperature_step": math.isfinite(self.temperature_step) and 0 <= self.temperature_step <= 1,
            "max_attempts": self.max_attempts >= 1,
            "thresholds": all(map(math.isfinite, (self.log_prob_threshold, self.compression_threshold, self.no_speech_threshold))),
        }
        for name, good in checks.items():
            if not good:
                raise ValueError(f"invalid {name}")
        return self


#: In an override: clear the parameter, where leaving it out keeps it.
CLEAR = object()


def apply_override(base: Params, **changes: object) -> Params:
    """base with some parameters set or cleared."""
    return replace(base, **{k: None if v is CLEAR else v for k, v in changes.items()}).validate()


def effective(default: Column, locked: Column, override: Column, override_set: Column) -> Column:
    """A parameter by precedence: the chunk's override if it is set, null included, then the locked value, then the default."""
    return F.when(override_set, override).otherwise(F.coalesce(locked, default))
