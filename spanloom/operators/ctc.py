"""Forced alignment of tokens to frames: trellis, two-wide beam, and the merges from path to words.

The dynamic programme over one clip runs in an Arrow group of its own, bounded by the cell budget
and vectorised over tokens, in single precision throughout; the merges are window expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.plans.fold import ensure_importable

WILDCARD = -1
MAX_FRAMES, MAX_CELLS, MAX_NODES = 2_000_000, 32_000_000, 2_000_000
BEAM_WIDTH = 2
PATHS = "clip_id bigint, status string, frame int, token_index int, score float"


def emissions_for(lp: np.ndarray, tokens: np.ndarray, blank: int) -> np.ndarray:
    """What each token emits in each frame; a wildcard emits the frame's best value outside the blank."""
    others = np.delete(lp, blank, axis=1)
    best = others.max(1) if others.shape[1] else np.full(len(lp), -np.inf, np.float32)
    out = lp[:, np.maximum(tokens, 0)]
    out[:, tokens == WILDCARD] = best[:, None]
    return out


def trellis(lp: np.ndarray, tokens: np.ndarray, blank: int = 0) -> np.ndarray:
    """Best scores, frames by tokens. The first token is never scored, and staying on it so long that the rest can't follow is barred by +inf."""
    frames, n = len(lp), len(tokens)
    emitted = emissions_for(lp, tokens, blank)
    scores = np.full((frames, n), -np.inf, dtype=np.float32)
    scores[0, 0] = 0
    scores[1:, 0] = np.add.accumulate(lp[1:, blank], dtype=np.float32)
    if n > 1:
        scores[max(0, frames - n + 1) :, 0] = np.inf
    for t in range(frames - 1):
        stay, change = scores[t, 1:] + lp[t, blank], scores[t, :-1] + emitted[t, 1:]
        scores[t + 1, 1:] = np.where(stay >= change, stay, change)
    return scores


def backtrack(scores: np.ndarray, lp: np.ndarray, tokens: np.ndarray, blank: int = 0, width: int = BEAM_WIDTH) -> list[tuple[int, int, float]] | None:
    """(frame, token index, probability) of the best path, or None. Beams are ranked by the cell they come from alone, stably."""
    frames, n = scores.shape
    if not np.isfinite(scores[-1, -1]):
        return None
    emitted = np.exp(emissions_for(lp, tokens, blank))
    silent = np.exp(lp[:, blank])
    # A node: token, frame, probability, and the node after it in time.
    nodes = [(n - 1, frames - 1, silent[-1], -1)]
    beams = [(n - 1, frames - 1, scores[-1, -1], 0)]
    while beams[0][0] > 0:
        reached = []
        for j, t, _, node in beams:
            if t <= 0:
                continue
            for to, probability in ((j, silent[t - 1]), (j - 1, emitted[t - 1, j])):
                if to >= 0 and np.isfinite(scores[t - 1, to]):
                    nodes.append((to, t - 1, probability, node))
                    reached.append((to, t - 1, scores[t - 1, to], len(nodes) - 1))
        if not reached or len(nodes) > MAX_NODES:
            return None
        beams = sorted(reached, key=lambda b: -b[2])[:width]
    path, at = [], beams[0][3]
    first = nodes[at]
    for t in range(first[1]):
        path.append((t, first[0], float(silent[t])))
    while at >= 0:
        j, t, probability, at = nodes[at]
        path.append((t, j, float(probability)))
    return path


def _own(tokens: DataFrame, name: str, otherwise: Column) -> Column:
    """A clip's own value of a column that the table may have."""
    return F.col(name) if name in tokens.columns else otherwise


def _judged(frames: DataFrame, tokens: DataFrame, blank: int) -> DataFrame:
    """clip_id, frame, lp and status of all frames of the clips that can be aligned, and of one frame, without lp, of each other clip.

    Sizes are counted where a clip's frames lie together and may spill, so no clip beyond the budgets
    is ever gathered in a row or in Python. No token comes first, then frames of unlike lengths
    (bad_shape), frames of another length than the clip's vocabulary (vocab_mismatch), ids outside the
    vocabulary, and too few frames or budgets exceeded.
    """
    clip = Window.partitionBy("clip_id")
    asked = tokens.select(F.col("clip_id").alias("_clip"), F.size("token_ids").alias("_n"), F.array_max("token_ids").alias("_top"), F.array_min("token_ids").alias("_low"), _own(tokens, "blank_id", F.lit(blank)).alias("_blank"), _own(tokens, "vocab_size", F.lit(None).cast("int")).alias("_size"))
    vocab = F.coalesce(F.size("lp"), F.lit(-1))
    sized = frames.select("clip_id", "frame", "lp").withColumns({"_frames": F.count("*").over(clip), "_vocab": F.max(vocab).over(clip), "_least": F.min(vocab).over(clip), "_nth": F.row_number().over(clip.orderBy("frame"))})
    frames_, n = F.col("_frames"), F.col("_n")
    outside = F.col("_blank").isNull() | (F.col("_blank") < 0) | (F.col("_blank") >= F.col("_vocab")) | (F.col("_top") >= F.col("_vocab")) | (F.col("_low") < WILDCARD)
    beyond = (frames_ < n) | (frames_ > MAX_FRAMES) | (frames_.cast("decimal(20,0)") * n > MAX_CELLS)
    status = F.when(n.isNull() | (n <= 0), "no_alignment_path").when(F.col("_least") != F.col("_vocab"), "bad_shape").when(F.col("_size") != F.col("_vocab"), "vocab_mismatch").when(outside, "token_out_of_range").when(beyond, "no_alignment_path").otherwise("ok")
    met = sized.join(asked, F.col("clip_id") == F.col("_clip"), "left").withColumn("status", status)
    return met.where("status = 'ok' or _nth = 1").select("clip_id", "frame", F.when(F.col("status") == "ok", F.col("lp")).alias("lp"), "status")


def align(frames: DataFrame, tokens: DataFrame, blank: int = 0) -> DataFrame:
    """The path of every clip, one row per frame; a clip that can't be aligned gives one row with its status.

    frames: clip_id, frame, lp array<float>. tokens: clip_id, token_ids array<int>, and, where clips
    have vocabularies of their own, blank_id and vocab_size.
    """
    ensure_importable(frames.sparkSession)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("frame")
        clip = (left.column("clip_id") if len(left) else right.column("of_clip"))[0].as_py()
        status, path = left.column("status")[0].as_py() if len(left) else "no_alignment_path", None
        if status == "ok":
            lp = left.column("lp").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(left), -1)
            ids, own = np.array(right.column("token_ids")[0].as_py(), dtype=np.int64), right.column("blank")[0].as_py()
            path = backtrack(trellis(lp, ids, own), lp, ids, own)
            status = "ok" if path else "no_alignment_path"
        out = [(clip, status, *p) for p in path or [(None, None, None)]]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float32()]
        return pa.table([pa.array([r[i] for r in out], type=k) for i, k in enumerate(kinds)], names=["clip_id", "status", "frame", "token_index", "score"])

    ids = tokens.select(F.col("clip_id").alias("of_clip"), "token_ids", _own(tokens, "blank_id", F.lit(blank)).alias("blank"))
    return _judged(frames, tokens, blank).groupBy("clip_id").cogroup(ids.groupBy("of_clip")).applyInArrow(run, PATHS)


def trellis_rows(frames: DataFrame, tokens: DataFrame, blank: int = 0) -> DataFrame:
    """clip_id, frame and cells (a score for each token) of every clip that can be aligned: what a debug dump holds."""
    ensure_importable(frames.sparkSession)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("frame")
        if not len(left) or left.column("status")[0].as_py() != "ok":
            return pa.table({"clip_id": pa.array([], pa.int64()), "frame": pa.array([], pa.int32()), "cells": pa.array([], pa.list_(pa.float32()))})
        lp = left.column("lp").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(left), -1)
        scores = trellis(lp, np.array(right.column("token_ids")[0].as_py(), dtype=np.int64), right.column("blank")[0].as_py())
        return pa.table({"clip_id": left.column("clip_id").cast(pa.int64()), "frame": pa.array(np.arange(len(scores), dtype=np.int32)), "cells": pa.array(list(scores), pa.list_(pa.float32()))})

    ids = tokens.select(F.col("clip_id").alias("of_clip"), "token_ids", _own(tokens, "blank_id", F.lit(blank)).alias("blank"))
    return _judged(frames, tokens, blank).groupBy("clip_id").cogroup(ids.groupBy("of_clip")).applyInArrow(run, "clip_id bigint, frame int, cells array<float>")


def end_scores(frames: DataFrame, tokens: DataFrame, blank: int = 0) -> DataFrame:
    """clip_id and end_score of the trellis' last cell, as one array fold in the JVM that carries a single row of cells; clips beyond the budgets are left out."""
    within = _judged(frames, tokens, blank).where("status = 'ok'")
    clips = within.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("frame", "lp"))).alias("f")).join(tokens, "clip_id")
    clips = clips.select("clip_id", "token_ids", F.transform("f", lambda x: x["lp"]).alias("lps"))
    n, total = F.size("token_ids"), F.size("lps")
    inf = lambda s: F.lit(float(s)).cast("float")

    def step(acc, t):
        lp = F.get("lps", t)
        wild = F.array_max(F.filter(lp, lambda x, i: i != blank))
        stay_by = F.get(lp, F.lit(blank))

        def cell(j):
            token = F.get("token_ids", j)
            change = F.get(acc, j - 1) + F.when(token == WILDCARD, wild).otherwise(F.get(lp, token))
            return F.greatest(F.get(acc, j) + stay_by, change)

        first = F.when((n > 1) & (t + 1 > total - n), inf("inf")).otherwise(F.get(acc, F.lit(0)) + F.get(F.get("lps", t + 1), F.lit(blank)))
        return F.concat(F.array(first), F.transform(F.sequence(F.lit(1), n - 1), cell))

    begin = F.concat(F.array(F.lit(0.0).cast("float")), F.array_repeat(inf("-inf"), n - 1))
    folded = F.aggregate(F.sequence(F.lit(0), total - 2), begin, step)
    sound = (n > 1) & (total >= n) & (total > 1)
    return clips.where(sound).select("clip_id", F.element_at(folded, -1).alias("end_score"))


def merge_repeats(path: DataFrame) -> DataFrame:
    """Runs of one token: clip_id, segment, token_index, start_frame, end_frame (exclusive) and the mean score."""
    order = Window.partitionBy("clip_id").orderBy("frame")
    changed = F.when(F.col("token_index") == F.lag("token_index").over(order), 0).otherwise(1)
    runs = path.withColumn("_changed", changed).withColumn("segment", F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("clip_id", "segment", "token_index").agg(F.min("frame").alias("start_frame"), (F.max("frame") + 1).alias("end_frame"), F.avg("score").cast("float").alias("score"))


def merge_words(segments: DataFrame) -> DataFrame:
    """Words from character segments: clip_id, word_index, start_frame, end_frame and the score weighted by length.

    segments: clip_id, segment (its order), word_index (null: a separator), start_frame, end_frame,
    score. A separator closes a word and belongs to none; another word index closes it too.
    """
    order = Window.partitionBy("clip_id").orderBy("segment")
    same = F.col("word_index") == F.lag("word_index").over(order)
    numbered = segments.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("word", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    length = F.col("end_frame") - F.col("start_frame")
    kept = numbered.where(F.col("word_index").isNotNull()).withColumn("_len", length)
    total = F.sum("_len")
    score = F.when(total == 0, 0.0).otherwise(F.sum(F.col("score").cast("double") * F.col("_len")) / total).cast("float")
    return kept.groupBy("clip_id", "word", "word_index").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), score.alias("score"))
