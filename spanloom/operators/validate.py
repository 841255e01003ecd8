"""Guards before the expensive steps, as status columns: the first check that fails names the error."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ctc import MAX_CELLS, MAX_FRAMES, MAX_NODES, WILDCARD


def frame_budget(frames: Column) -> Column:
    return F.when(frames > MAX_FRAMES, "frame_budget").otherwise("ok")


def cell_budget(frames: Column, tokens: Column) -> Column:
    """no_alignment_path beyond the budgets of cells and of beam nodes, or where there are fewer frames than tokens."""
    cells = frames.cast("decimal(20,0)") * tokens
    return F.when(frames < tokens, "no_alignment_path").when(cells > MAX_CELLS, "no_alignment_path").when(frames.cast("decimal(20,0)") * 4 > MAX_NODES, "no_alignment_path").otherwise("ok")


def output_dims(vocab: Column, frames: Column, cells: Column) -> Column:
    """Whether an encoder's output has the shape that it says: ok, empty (no frame and no cell, recoverable) or bad_shape."""
    return (
        F.when((vocab <= 0) | (frames < 0), "bad_shape").when((frames == 0) & (cells == 0), "empty").when(frames.cast("decimal(20,0)") * vocab == cells, "ok").otherwise("bad_shape")
    )


def stride(frames: Column, n_samples: Column, hop: int = 320) -> Column:
    """bad_stride if the frames' extent is over two hops away from the samples."""
    extent = F.coalesce(F.try_multiply(frames.cast("bigint"), F.lit(hop).cast("bigint")), F.lit((1 << 63) - 1))
    return F.when(F.abs(F.coalesce(F.try_subtract(extent, n_samples.cast("bigint")), F.lit((1 << 63) - 1))) <= 2 * hop, "ok").otherwise("bad_stride")


def vocab_dim(vocab: Column, tokenizer_size: Column) -> Column:
    return F.when(vocab == tokenizer_size, "ok").otherwise("vocab_mismatch")


def token_range(token_ids: Column, vocab: Column, blank: int) -> Column:
    """token_out_of_range for a blank outside the vocabulary, an id beyond it, or a negative one that isn't the wildcard."""
    bad = F.exists(token_ids, lambda t: (t >= vocab) | (t < WILDCARD))
    return F.when((F.lit(blank) < 0) | (F.lit(blank) >= vocab) | bad, "token_out_of_range").otherwise("ok")


def decision_shape(n_decisions: Column, n_runs: Column) -> Column:
    """Decisions come for no run, for the whole chunk, or for every run."""
    return F.when(n_decisions.isin(0, 1) | (n_decisions == n_runs), "ok").otherwise("decision_shape")


def decision_language(decided: Column, language: Column) -> Column:
    return F.when(decided == language, "ok").otherwise("decision_language")


def decisions(chunks: DataFrame, found: DataFrame, decided: DataFrame) -> DataFrame:
    """chunk_id and status of every chunk: decision_shape, decision_language or ok, for the decisions that came for it.

    chunks: chunk_id, language. found: chunk_id, run (from 0), language. decided: chunk_id, run,
    language, one row per decision; in a chunk without runs, run 0 stands for the whole chunk, whose
    language it must carry. A decision for a run must carry that run's language. Lists without a
    decision are rows with a null language and count for the shape alone.
    """
    sizes = found.groupBy("chunk_id").agg(F.count("*").alias("n_runs"))
    expected = decided.join(found.select("chunk_id", "run", F.col("language").alias("of_run")), ["chunk_id", "run"], "left").join(chunks.select("chunk_id", F.col("language").alias("of_chunk")), "chunk_id")
    expected = expected.join(sizes, "chunk_id", "left").withColumn("expected", F.when(F.col("n_runs").isNull(), F.col("of_chunk")).otherwise(F.col("of_run")))
    wrong = F.col("language").isNotNull() & F.col("expected").isNotNull() & (F.col("language") != F.col("expected"))
    judged = expected.groupBy("chunk_id").agg((F.max("run") + 1).alias("n_lists"), F.bool_or(wrong).alias("wrong"))
    met = chunks.select("chunk_id").join(sizes, "chunk_id", "left").join(judged, "chunk_id", "left")
    shape = decision_shape(F.coalesce("n_lists", F.lit(0)), F.coalesce("n_runs", F.lit(0)))
    # One list stands for a whole chunk only where there are no runs.
    shape = F.when((F.col("n_lists") == 1) & (F.col("n_runs") > 1), "decision_shape").otherwise(shape)
    return met.select("chunk_id", F.when(shape != "ok", shape).when(F.coalesce("wrong", F.lit(False)), "decision_language").otherwise("ok").alias("status"))


def would_accept(live: Column, queued: Column, incoming: Column, cap: Column) -> Column:
    """Whether a buffer has room; an overflow is no."""
    return F.coalesce(F.try_add(F.try_add(live, queued), incoming) <= cap, F.lit(False))


def recoverable(error: Column) -> Column:
    """Errors after which a chunk keeps its text and has no words."""
    return error.isin("no_alignment_path", "empty_text", "semantic_oov")


def coerce_coverage(value: float) -> float:
    """A coverage threshold: 0.5 for NaN, else held in [0, 1]."""
    return 0.5 if math.isnan(value) else min(1.0, max(0.0, value))


def strict_coverage(value: float) -> float:
    """A coverage threshold, or ValueError."""
    if math.isnan(value) or not 0 <= value <= 1:
        raise ValueError("coverage must be within [0, 1]")
    return value
