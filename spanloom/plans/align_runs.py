"""Alignment of a chunk run by run: slices, aligners, words in the run's own language, and what a failure costs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators import compose, ctc, intervals, registry, runs, tokens, validate
from spanloom.plans import lifecycle
from spanloom.plans.shared import cut

#: Runs of a chunk; a clip's id is its chunk's, shifted, with the run's number.
RUN_BITS = 12


@dataclass(frozen=True)
class Aligned:
    """words: chunk_id, run, language, word_index, text, start_sample, end_sample, score and position; chunks: chunk_id, status and what is counted."""

    words: DataFrame
    chunks: DataFrame


def clip_id(chunk: Column, run: Column) -> Column:
    return F.shiftleft(chunk.cast("bigint"), RUN_BITS) + run


def _decide(prepared: DataFrame, found: DataFrame, vocab: list[tuple[str, int]] | DataFrame, decided: DataFrame) -> DataFrame:
    """prepared with the statuses that the decisions give, and tokens only where all is well."""
    keys = ["chunk_id", "run"]
    spoken = prepared.where((F.col("looked_up") == "ok") & F.col("status").isin("ok", "semantic_oov"))
    events = tokens.oov_events(spoken, F.col("words"), tokens.RowAlphabet(F.col("characters"), F.col("character_ids")) if isinstance(vocab, DataFrame) else lifecycle.alphabet_of(vocab), keys)
    languages = found.groupBy("chunk_id").agg(F.min("language").alias("language"))
    of_chunk = validate.decisions(languages, found, decided).select("chunk_id", F.col("status").alias("_chunk"))
    applied = tokens.apply_decisions(prepared, events, decided.select(*keys, "event", "kind", "ch", "char_index", "word_index", "decision"), keys)
    met = applied.join(of_chunk, "chunk_id", "left")
    whole = F.col("_chunk").isNotNull() & (F.col("_chunk") != "ok")
    return met.withColumn("status", F.when(whole, F.col("_chunk")).otherwise(F.col("status"))).withColumn("is_trivial", (F.col("status") != "ok") | (F.size("token_ids") == 0)).drop("_chunk")


def _shared(ready: DataFrame, frames: DataFrame, of_emission: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames by the least clip_id of each emission and its tokens, and path_id, that clip's id, of every clip; a clip without an emission has its own."""
    key = ["emission_id", "token_ids", "word_idx", "_blank", "_size"]
    own = lambda name: F.coalesce(F.col(name).cast("int") if name in ready.columns else F.lit(None).cast("int"), F.lit(-1))
    asked = ready.select("clip_id", "token_ids", "word_idx", own("blank_id").alias("_blank"), own("vocab_size").alias("_size")).join(of_emission.select("clip_id", "emission_id"), "clip_id", "left")
    asked = cut(asked)
    first = cut(asked.where(F.col("emission_id").isNotNull()).groupBy(*key).agg(F.min("clip_id").alias("path_id")))
    of_path = cut(asked.join(first, key, "left").select("clip_id", F.coalesce("path_id", "clip_id").alias("path_id")))
    return first.select(F.col("path_id").alias("clip_id"), "emission_id").join(frames, "emission_id").select("clip_id", "frame", "lp"), of_path


def align_runs(
    chunks: DataFrame,
    found: DataFrame,
    aligners: DataFrame,
    speech: DataFrame,
    vocab: list[tuple[str, int]] | DataFrame,
    encode: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]],
    miss: str = "skip_chunk",
    policy: tokens.Policy = "default",
    blank: int = 0,
    coverage: float = 0.5,
    least_samples: int = 400,
    normalizers: dict[str, Callable[[Column], Column]] | None = None,
    decided: DataFrame | None = None,
) -> Aligned:
    """Timed words of every chunk's runs, in order of time, and each chunk's outcome.

    chunks: chunk_id, first_sample, n_samples. found: chunk_id, run, language, text, t0_ms, t1_ms,
    bounds_source, as runs.bound gives them. aligners: as registry.register gives them. speech:
    chunk_id, start, end, in samples of the chunk. encode: the caller's model, from slices (clip_id,
    chunk_id, run, aligner_id, lo, hi, n_samples) to frames (clip_id, frame, lp); it is called once.
    Where slices have the model's frames in common, it may give frames (emission_id, frame, lp) and
    clip_id with emission_id: each path is then found once for all slices of one emission and tokens,
    and nothing is as large as slices times frames.
    vocab: one for all aligners, or each one's own, as vocabularies.of_aligners gives them; then a
    clip's frames must be as wide as its aligner's vocabulary. decided: the caller's decisions
    (chunk_id, run, language, event, kind, ch, char_index, word_index, decision) in place of a policy;
    validate.decisions judges their shape and language for the whole chunk, tokens.decided_status each
    run's. A chunk without any has no events, or fails.

    A run is sliced out of its chunk's audio, meets the aligner of its language or the one for any,
    and is aligned by itself. Without an aligner it is left out (miss: skip_chunk) or fails its chunk
    (error). A recoverable failure leaves out the run; any other fails the chunk, which has no words
    then, and what is counted stops at that run. Chunks without runs are ok and have no words; runs
    of chunks that aren't there, or beyond 4,095 in a chunk, are left out. A null text is empty_text.
    """
    cell = runs.slice_bounds(F.col("t0_ms"), F.col("t1_ms"), F.col("bounds_source"), F.col("n_samples"))
    sliced = found.where((F.col("run") >= 0) & (F.col("run") < 1 << RUN_BITS)).join(chunks.select("chunk_id", "first_sample", "n_samples"), "chunk_id").withColumn("_s", cell)
    sliced = sliced.select("chunk_id", "run", clip_id(F.col("chunk_id"), F.col("run")).alias("clip_id"), "language", F.coalesce("text", F.lit("")).alias("text"), "bounds_source", F.col("_s.lo").alias("lo"), F.col("_s.hi").alias("hi"), "first_sample")
    met = registry.lookup(sliced, aligners, miss)
    sized = met.withColumns({"real_samples": F.col("hi") - F.col("lo"), "n_samples": F.greatest(F.col("hi") - F.col("lo"), F.lit(least_samples)), "first_sample": F.col("first_sample") + F.col("lo")})
    known = sized.withColumnRenamed("status", "looked_up")
    if isinstance(vocab, DataFrame):
        known = known.join(vocab, "aligner_id", "left")
    prepared = lifecycle.prepare(known, None if isinstance(vocab, DataFrame) else vocab, policy if decided is None else "wildcard_all", normalizers)
    if decided is not None:
        prepared = _decide(cut(prepared), found, vocab, decided)
    prepared = cut(prepared.drop("characters", "character_ids"))
    ready = prepared.where((F.col("looked_up") == "ok") & ~F.col("is_trivial"))
    # The model's frames, and the paths, are kept: words, failures and frame counts all come from them.
    made = encode(ready.select("clip_id", "chunk_id", "run", "aligner_id", "lo", "hi", "n_samples"))
    made, of_path = _shared(ready, *made) if isinstance(made, tuple) else (made, None)
    frames = cut(made)
    own = ready if of_path is None else ready.join(of_path.where("clip_id = path_id").select("clip_id"), "clip_id")
    paths = cut(ctc.align(frames, own, blank))
    failed = paths.where("status <> 'ok'").select("clip_id", F.col("status").alias("_path"))
    if of_path is not None:
        failed = of_path.join(failed.withColumnRenamed("clip_id", "path_id"), "path_id").drop("path_id")
    status = F.when(F.col("looked_up") != "ok", F.col("looked_up")).when(F.col("status") != "ok", F.col("status")).when(F.col("is_trivial"), "empty_text").otherwise(F.coalesce("_path", F.lit("ok")))
    outcome = prepared.join(failed, "clip_id", "left").select("chunk_id", "run", "clip_id", "language", "bounds_source", status.alias("status"))
    # A skipped run is no failure, and neither is a recoverable one.
    outcome = outcome.withColumn("fatal", ~(F.col("status").isin("ok", "skipped") | validate.recoverable(F.col("status"))))
    first_fatal = F.min(F.when(F.col("fatal"), F.col("run"))).over(Window.partitionBy("chunk_id"))
    outcome = cut(outcome.withColumn("stop", first_fatal))
    seen = outcome.where(F.col("stop").isNull() | (F.col("run") <= F.col("stop")))
    left_out = (F.col("status") == "skipped") | validate.recoverable(F.col("status"))
    counted = runs.telemetry(seen.withColumn("aligned", ~left_out), ["chunk_id"])
    failure = outcome.where(F.col("run") == F.col("stop")).select("chunk_id", F.col("status").alias("failure"))
    counts = ["n_dtw", "n_segment", "n_wholeclip", "n_unaligned"]
    of_chunk = chunks.select("chunk_id").join(counted, "chunk_id", "left").join(failure, "chunk_id", "left")
    of_chunk = of_chunk.select("chunk_id", F.coalesce("failure", F.lit("ok")).alias("status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
    # Only what a run's slice holds of the chunk's speech counts for it, from the slice's start on.
    held = speech.join(ready.select("chunk_id", "clip_id", "lo", "hi"), "chunk_id").select("clip_id", (F.greatest("start", "lo") - F.col("lo")).alias("start"), (F.least("end", "hi") - F.col("lo")).alias("end"))
    good = outcome.where(F.col("stop").isNull() & (F.col("status") == "ok")).select("clip_id", "chunk_id", "run", F.col("language").alias("run_language"))
    words = lifecycle.timed(ready.drop("looked_up"), paths, frames, held.where("end > start"), coverage, of_path).where("drop_reason is null").join(good, "clip_id")
    emitted = F.struct("run", "start_sample", "word_index")
    rows = words.select("chunk_id", "run", F.col("run_language").alias("language"), "word_index", "text", "start_sample", "end_sample", "score", F.col("start_sample").alias("start_pts"), F.col("end_sample").alias("end_pts"), emitted.alias("emitted"))
    return Aligned(compose.ordered_words(rows, ["chunk_id"]).drop("start_pts", "end_pts", "emitted"), of_chunk)
