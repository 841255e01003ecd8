import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from spanloom.functions import numeric
from spanloom.operators import compose, ctc, intervals, validate
from spanloom.queries.runs import QUERIES


def test_first_column_leaves_out_frame_zero():
    lp = np.full((4, 3), -0.5, dtype=np.float32)
    scores = ctc.trellis(lp, np.array([1]), 0)
    assert scores[:, 0].tolist() == [0.0, -0.5, -1.0, -1.5]


def test_late_rows_of_the_first_column_are_barred():
    scores = ctc.trellis(np.full((6, 3), -1.0, dtype=np.float32), np.array([1, 2, 1]), 0)
    assert np.isinf(scores[4:, 0]).all() and np.isfinite(scores[:4, 0]).all()


def test_first_token_is_never_scored():
    lp = np.log(np.random.default_rng(0).dirichlet(np.ones(5), size=9)).astype(np.float32)
    a, b = (ctc.trellis(lp, np.array([first, 2, 3]), 0) for first in (1, 4))
    assert np.array_equal(a, b)


def test_small_lattice_gives_one_word(spark):
    data = np.full(12, -100.0, dtype=np.float32)
    data[[1, 3, 8, 9]] = -0.1
    frames = spark.createDataFrame([(1, t, data.reshape(4, 3)[t].tolist()) for t in range(4)], "clip_id bigint, frame int, lp array<float>")
    tokens = spark.createDataFrame([(1, [1, 2])], "clip_id bigint, token_ids array<int>")
    path = ctc.align(frames, tokens)
    words = ctc.merge_words(ctc.merge_repeats(path).withColumn("word_index", F.lit(0))).collect()
    assert [(w.word_index, w.start_frame, w.end_frame) for w in words] == [(0, 0, 4)]


def slow_trellis(lp, tokens, blank):
    f32 = np.float32
    frames, n = len(lp), len(tokens)
    tr = [[f32(-np.inf)] * n for _ in range(frames)]
    tr[0][0] = f32(0)
    for t in range(1, frames):
        tr[t][0] = tr[t - 1][0] + lp[t][blank]
    for t in range(max(0, frames - n + 1), frames):
        if n > 1:
            tr[t][0] = f32(np.inf)
    for t in range(frames - 1):
        for j in range(1, n):
            e = max(x for i, x in enumerate(lp[t]) if i != blank) if tokens[j] == -1 else lp[t][tokens[j]]
            tr[t + 1][j] = max(tr[t][j] + lp[t][blank], tr[t][j - 1] + e)
    return tr


@pytest.mark.parametrize("seed", range(5))
def test_trellis_and_path_against_plain_loops(spark, seed):
    rng = np.random.default_rng(seed)
    frames, n = int(rng.integers(8, 30)), int(rng.integers(2, 7))
    lp = np.log(rng.dirichlet(np.ones(8), size=frames)).astype(np.float32)
    tokens = rng.integers(1, 8, size=n)
    tokens[rng.integers(n)] = -1
    fast, slow = ctc.trellis(lp, tokens, 0), np.array(slow_trellis(lp, tokens.tolist(), 0))
    assert np.array_equal(fast, slow)
    path = ctc.backtrack(fast, lp, tokens, 0)
    assert [p[0] for p in path] == list(range(frames)) and path[-1][1] == n - 1 and path[0][1] == 0
    assert all(0 <= b[1] - a[1] <= 1 for a, b in zip(path, path[1:]))
    df = spark.createDataFrame([(1, t, lp[t].tolist()) for t in range(frames)], "clip_id bigint, frame int, lp array<float>")
    end = ctc.end_scores(df, spark.createDataFrame([(1, tokens.tolist())], "clip_id bigint, token_ids array<int>")).first().end_score
    assert end == pytest.approx(float(fast[-1, -1]), abs=1e-4)


def test_clips_that_cannot_be_aligned_say_why(spark):
    lp = [[-1.0, -1.0]] * 2
    frames = spark.createDataFrame([(c, t, lp[t]) for c in (1, 2, 4) for t in range(2)], "clip_id bigint, frame int, lp array<float>")
    tokens = spark.createDataFrame([(1, [1, 1, 1]), (2, [5]), (3, [1])], "clip_id bigint, token_ids array<int>")
    got = {r.clip_id: r.status for r in ctc.align(frames, tokens).collect()}
    assert got == {1: "no_alignment_path", 2: "token_out_of_range", 3: "no_alignment_path", 4: "no_alignment_path"}


def test_word_scores_are_weighted_by_length(spark):
    rows = [(1, 0, 0, 0, 1, 0.5), (1, 1, 0, 1, 4, 1.0), (1, 2, None, 4, 5, 0.1), (1, 3, 0, 5, 6, 0.2), (1, 4, 1, 6, 8, 0.3)]
    words = ctc.merge_words(spark.createDataFrame(rows, "clip_id bigint, segment int, word_index int, start_frame int, end_frame int, score double")).orderBy("start_frame").collect()
    assert [(w.word_index, w.start_frame, w.end_frame) for w in words] == [(0, 0, 4), (0, 5, 6), (1, 6, 8)]
    assert words[0].score == pytest.approx(0.875)


def test_log_softmax_survives_a_large_offset(spark):
    rows = spark.createDataFrame([([1000.0, 1001.0, 999.0],), ([float("nan"), 0.0, 0.0],), ([1.0, float("inf"), 0.0],)], "x array<float>")
    good, nan, inf = [r[0] for r in rows.select(numeric.log_softmax(F.col("x"))).collect()]
    assert sum(math.exp(v) for v in good) == pytest.approx(1) and nan is None and inf is None


def test_samples_are_masked_padded_and_standardised(spark):
    spans = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))
    row = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0],)], "x array<float>").select(intervals.mask_samples(F.col("x"), spans), F.size(intervals.pad_samples(F.col("x"))), numeric.standardize(F.col("x")), intervals.standardize_masked(F.col("x"), spans)).first()
    assert row[0] == [0.0, 2.0, 4.0, 0.0] and row[1] == 400
    assert np.mean(row[2]) == pytest.approx(0, abs=1e-6) and np.std(row[2]) == pytest.approx(1, abs=1e-4)
    assert row[3][0] == 0 and row[3][1] == pytest.approx(-1, abs=1e-4)


def test_interval_union_and_clip_in_arrays(spark):
    spans = [(5, 9), (1, 3), (3, 4), (7, 7), (8, 12)]
    df = spark.createDataFrame([(1, *s) for s in spans], "clip_id int, start bigint, end bigint")
    assert sorted((r.start, r.end) for r in intervals.union_intervals(df).collect()) == [(1, 4), (5, 12)]
    packed = df.agg(F.collect_list(F.struct("start", "end")).alias("s"))
    row = packed.select(intervals.union_array(F.col("s")).alias("u"), intervals.clip_array(intervals.union_array(F.col("s")), F.lit(3), F.lit(8)).alias("c")).first()
    assert [tuple(x) for x in row.u] == [(1, 4), (5, 12)] and [tuple(x) for x in row.c] == [(0, 1), (2, 5)]


def test_words_are_dropped_for_the_first_rule_they_break(spark):
    clips = spark.createDataFrame([(1, 20, 320.0, 0, 6_400, 6_400)], "clip_id bigint, frames bigint, spf double, first_sample bigint, real_samples bigint, chunk_end bigint")
    frames = spark.createDataFrame([(1, f, f < 10 or f == 18) for f in range(20)], "clip_id bigint, frame bigint, is_speech boolean")
    words = spark.createDataFrame([(1, 0, 0, 5, 0.5), (1, 1, 8, 16, float("nan")), (1, 2, 11, 14, 0.5), (1, 3, 4, 4, 0.5), (1, 4, 0, 3, 0.5), (1, 5, 19, 22, 0.5), (1, 6, 4, 15, 2.0)], "clip_id bigint, word_index int, start_frame bigint, end_frame bigint, score double")
    names = spark.createDataFrame([(1, i, f"w{i}") for i in (0, 1, 2, 3, 5, 6)], "clip_id bigint, word_index int, text string")
    got = {r.word_index: (r.drop_reason, round(r.score, 3), r.start_sample, r.end_sample) for r in compose.compose_words(words, clips, frames, names).collect()}
    assert got[0] == (None, 0.5, 0, 1_600) and got[1][:2] == ("low_coverage", 0.0) and got[2][0] == "no_speech"
    assert got[3][0] == "empty_span" and got[4][0] == "unknown_word" and got[5][0] == "outside_mask" and got[6][:2] == ("long_silence", 1.0)


def test_speech_needs_half_of_a_frame(spark):
    clips = spark.createDataFrame([(1, 4, 100.0, 400), (2, 4, float("inf"), 400)], "clip_id bigint, frames bigint, spf double, real_samples bigint")
    spans = spark.createDataFrame([(1, 50, 149), (1, 330, 1_000), (2, 0, 400)], "clip_id bigint, start bigint, end bigint")
    got = [(r.clip_id, r.frame, r.is_speech) for r in intervals.speech_frames(clips, spans).orderBy("clip_id", "frame").collect()]
    assert got == [(1, 0, True), (1, 1, False), (1, 2, False), (1, 3, True)] + [(2, f, False) for f in range(4)]


def test_coverage_parameters():
    assert validate.coerce_coverage(float("nan")) == 0.5 and validate.coerce_coverage(7) == 1.0 and validate.coerce_coverage(-1) == 0.0
    with pytest.raises(ValueError):
        validate.strict_coverage(1.5)


def test_runs_of_speech_judge_words_as_frames_do(spark):
    rng = np.random.default_rng(5)
    sizes = [(i, int(rng.integers(2, 90)), int(rng.integers(1, 400)) * (20 if i % 3 else 1)) for i in range(60)]
    clips = spark.createDataFrame([(i, n, s / (n - 1), 7 * i, s - i % 5, 7 * i + s) for i, n, s in sizes], "clip_id bigint, frames bigint, spf double, first_sample bigint, real_samples bigint, chunk_end bigint")
    spans = spark.createDataFrame([(i, int(a), int(a) + int(rng.integers(1, 1 + s // 2 + 1))) for i, _, s in sizes if i % 7 for a in rng.integers(0, s, 3)], "clip_id bigint, start bigint, end bigint")
    words = spark.createDataFrame([(i, k, int(a), int(a) + int(rng.integers(0, 30)), 0.5) for i, n, _ in sizes for k, a in enumerate(rng.integers(0, n, 8))], "clip_id bigint, word_index int, start_frame int, end_frame int, score double")
    names = words.select("clip_id", "word_index", F.lit("w").alias("text"))
    held = intervals.union_intervals(spans)
    want = compose.compose_words(words, clips, intervals.speech_frames(clips, held), names).collect()
    got = compose.compose_by_runs(words, clips, intervals.speech_runs(clips, held), names).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r.drop_reason for r in want}) > 4


def test_runs_of_one_emission_share_its_frames(spark, monkeypatch):
    """What is aligned grows with the emissions, not with runs times frames."""
    seen, align = [], ctc.align
    monkeypatch.setattr(ctc, "align", lambda frames, tokens, blank=0: (seen.append(frames.count()), align(frames, tokens, blank))[1])
    found = QUERIES["run_alignment_words"](spark, SMALL)
    n_frames = spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    assert seen[0] <= 4 * n_frames and found.count() > 10
