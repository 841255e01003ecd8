"""Errors as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How each error reads, with the error's fields in braces.
FORMATS = {
    "pts_regression": "PTS regression on {kind}: advance = {advance}",
    "vad_regression": "PTS regression on {kind}: advance = {advance}",
    "gap_exceeds_tolerance": "forward gap {gap_samples} samples exceeds tolerance {tolerance_samples}",
    "backpressure": "sample buffer at capacity ({buffered}/{cap})",
    "output_timebase_unset": "handle_vad_segment called before any handle_samples",
    "vad_ahead_of_audio": "VAD segment end {vad_end} is past buffered samples {buffered}",
    "inconsistent_timebase": "inconsistent output timebase: expected {expected}, got {got}",
    "invalid_timebase": "timebase numerator must be non-zero (got {numerator})",
    "unknown_chunk": "unknown or already-resolved chunk_id {chunk_id}",
    "after_eof": "operation rejected after handle_eof",
    "all_temperatures_exhausted": "ASR all temperatures failed: {message}",
    "unsupported_language": "ASR unsupported language: {message}",
    "backend": "ASR backend error: {message}",
    "model_inference": "alignment model inference failed: language={language} message={message}",
    "tokenization": "alignment tokenization failed: language={language} message={message}",
    "normalization": "alignment normalization failed: language={language} message={message}",
    "no_alignment_path": "no alignment path: language={language} message={message}",
    "empty_text": "empty text after normalisation: language={language} message={message}",
    "semantic_oov": "alignment semantic-OOV: language={language} message={message}",
    "aborted": "alignment aborted before completing: language={language} message={message}",
    "language_unsupported": "no aligner registered for language {language}",
    "worker_hang": "{kind} worker hung; elapsed {elapsed}",
}


def message(code: Column, fields: dict[str, Column]) -> Column:
    """The text of an error from its code and fields; a code of no format reads as itself, a missing field as ?."""
    out = code
    for name, pattern in FORMATS.items():
        parts, rest = [], pattern
        while "{" in rest:
            before, _, rest = rest.partition("{")
            field, _, rest = rest.partition("}")
            parts += [F.lit(before), F.coalesce(fields[field].cast("string"), F.lit("?")) if field in fields else F.lit("?")]
        out = F.when(code == name, F.concat(*parts, F.lit(rest))).otherwise(out)
    return out
