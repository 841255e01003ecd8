"""Whole plans: encoder-free alignment from text, emissions and speech spans to timed words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import language, text
from spanloom.functions.clock import samples_per_frame
from spanloom.operators import compose, ctc, intervals, tokens


def alphabet_of(vocab: list[tuple[str, int]]) -> tokens.Alphabet:
    """The characters of one vocabulary, without its word delimiter; small letters stand for capitals where it has no others."""
    ids = dict(vocab)
    return tokens.Alphabet.of([(t, i) for t, i in vocab if t != "|"], "A" in ids and "a" not in ids)


def prepare(clips: DataFrame, vocab: list[tuple[str, int]] | None, policy: tokens.Policy = "default", normalizers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """clips with kind, words, status, token_ids, word_idx and is_trivial. clips: clip_id, text, language, n_samples (padded), real_samples, first_sample.

    A clip without a word to speak is trivial: it needs no encoder and has no words. normalizers: the
    caller's own, by language, before the built-in ones; each gives a text's array of words. Without a vocab,
    clips bring their own along, as vocabularies.of_aligners gives it: one without a word delimiter is
    no_delimiter for languages that need one.
    """
    if vocab is None:
        alphabet, delimiter = tokens.RowAlphabet(F.col("characters"), F.col("character_ids")), F.col("delimiter_id")
    else:
        alphabet, delimiter = alphabet_of(vocab), dict(vocab).get("|")
    kind, words = language.normalizer_kind(F.col("language")), text.normalize(F.col("text"), F.col("kind"))
    for code, own in (normalizers or {}).items():
        kind = F.when(F.col("language") == code, F.concat(F.lit("own:"), F.lit(code))).otherwise(kind)
        words = F.when(F.col("language") == code, own(F.col("text"))).otherwise(words)
    rows = clips.withColumn("kind", kind).withColumn("words", words)
    spaced = tokens.tokenize(F.col("words"), alphabet, delimiter, policy)
    unspaced = tokens.tokenize(F.col("words"), alphabet, None, policy)
    rows = rows.withColumn("_t", F.when(language.uses_word_delimiter(F.col("language")), spaced).otherwise(unspaced))
    status = F.when(F.col("kind").isNull(), "no_normalizer").when(F.size("words") == 0, "empty_text")
    if vocab is None:
        status = status.when(F.col("characters").isNull(), "no_vocabulary").when(language.uses_word_delimiter(F.col("language")) & F.col("delimiter_id").isNull(), "no_delimiter")
    status = status.otherwise(F.col("_t.status"))
    return rows.withColumns({"status": status, "token_ids": F.col("_t.token_ids"), "word_idx": F.col("_t.word_idx")}).withColumn("is_trivial", (F.col("status") != "ok") | (F.size("token_ids") == 0)).drop("_t")


def finish(prepared: DataFrame, frames: DataFrame, spans: DataFrame, blank: int = 0, coverage: float = 0.5) -> DataFrame:
    """Timed words of every clip that isn't trivial, dropped ones with their reason.

    frames: clip_id, frame, lp. spans: clip_id, start, end of speech, in samples of the clip.
    """
    return timed(prepared, ctc.align(frames, prepared.where(~F.col("is_trivial")), blank), frames, spans, coverage)


def timed(prepared: DataFrame, paths: DataFrame, frames: DataFrame, spans: DataFrame, coverage: float = 0.5, of_path: DataFrame | None = None) -> DataFrame:
    """Timed words from the paths that were found; as finish.

    of_path: clip_id and path_id, where several clips have one path: the one of the clip whose id it is,
    which frames and paths hold alone. Segments and words are then found once for all of them.
    """
    ready = prepared.where(~F.col("is_trivial"))
    path = paths.where("status = 'ok'")
    segments = ctc.merge_repeats(path)
    indexed = segments.join(ready.select("clip_id", F.col("word_idx").alias("_w")), "clip_id").withColumn("word_index", F.get("_w", F.col("token_index"))).drop("_w")
    words = ctc.merge_words(indexed)
    count = frames.groupBy("clip_id").agg(F.count("*").alias("frames"))
    if of_path is not None:
        words, count = (of_path.join(x.withColumnRenamed("clip_id", "path_id"), "path_id").drop("path_id") for x in (words, count))
    clips = ready.join(count, "clip_id").select("clip_id", "frames", samples_per_frame(F.col("n_samples"), F.col("frames")).alias("spf"), "first_sample", "real_samples", (F.col("first_sample") + F.col("n_samples")).alias("chunk_end"))
    surfaces = ready.select("clip_id", F.posexplode("words").alias("word_index", "w")).select("clip_id", "word_index", F.col("w.surface").alias("text"))
    held = intervals.union_intervals(spans)
    if coverage < 0.5:
        return compose.compose_words(words, clips, intervals.speech_frames(clips, held), surfaces, coverage)
    return compose.compose_by_runs(words, clips, intervals.speech_runs(clips, held), surfaces, coverage)
