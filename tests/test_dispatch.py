import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from spanloom.config import Options
from spanloom.functions import clock
from spanloom.operators import asr, compose, dispatch, ingest, registry
from spanloom.plans import lifecycle
from spanloom.registry import QUERIES
from spanloom.sources import tables, vocabulary

RESOLVED = "stream_id bigint, chunk_id bigint, language string"


def lock(spark, languages, n):
    rows = [(1, i, x) for i, x in enumerate(languages)]
    return dispatch.language_lock(spark.createDataFrame(rows, RESOLVED), n).first()


def test_lock_is_the_mode_with_ties_to_the_earliest(spark):
    assert lock(spark, ["en", "fr", "fr"], 3).language == "fr"
    assert lock(spark, ["de", None, "en", "en", "de"], 4).language == "de"
    assert lock(spark, ["en", None], 2).language is None


def test_lock_sees_only_the_resolved_prefix(spark):
    rows = spark.createDataFrame([(1, 0, "en"), (1, 2, "fr"), (1, 3, "fr")], RESOLVED)
    assert dispatch.language_lock(rows, 1).first().language == "en"
    assert dispatch.in_order(rows).count() == 1


def test_admission_waits_for_observations(spark):
    rows = [(1, s, "cut", None, None) for s in range(4)] + [(1, 10, "result", 1, "fr"), (1, 11, "result", 0, "en"), (1, 12, "result", 7, "en")]
    df = spark.createDataFrame(rows, "stream_id bigint, seq bigint, kind string, chunk_id bigint, language string")
    got = [(r.seq, r.action, r.chunk_id, r.language) for r in dispatch.admit(df, 6, 2).collect()]
    assert got == [(0, "start", 0, None), (1, "start", 1, None), (10, "resolved", 1, "fr"), (11, "resolved", 0, "en"), (11, "start", 2, "en"), (11, "start", 3, "en"), (12, "unknown_chunk", 7, None)]
    with pytest.raises(ValueError):
        dispatch.admit(df, 0, 1)


def test_ladder(spark):
    rows = [
        (1, 0, 3, -2.0, 0.1, 1.0, "a", "en"), (1, 1, 3, -0.5, 0.1, 9.0, "b", "en"), (1, 2, 3, -0.5, 0.1, 1.0, "c", "en"),
        (2, 0, 0, -9.0, 0.0, 9.0, "x", "en"), (3, 0, 2, -1.5, 0.7, 1.0, "y", "en"), (4, 0, 2, -1.5, 0.1, 1.0, "z", "en"), (5, 6, 2, 0.0, 0.0, 0.0, "late", "en"),
    ]
    df = spark.createDataFrame(rows, "chunk_id int, attempt int, segments int, avg_logprob double, no_speech_prob double, compression_ratio double, text string, language string")
    got = {r.chunk_id: (r.status, r.attempt, r.text) for r in dispatch.first_accepted(df, dispatch.Ladder(), ["chunk_id"]).collect()}
    assert got == {1: ("accept", 2, "c"), 2: ("accept_empty", 0, ""), 3: ("accept_empty", 0, ""), 4: ("all_temperatures_exhausted", None, None)}
    assert len(dispatch.Ladder().temperatures()) == 6 and len(dispatch.Ladder(step=0.5).temperatures()) == 3


def test_compression_ratio(spark):
    rows = spark.createDataFrame([("yes " * 64,), ("thank you " * 4,), ("short",), (None,)], "text string")
    a, b, c, d = [r.compression_ratio for r in asr.compression_ratio(rows).collect()]
    assert a > 2.4 > b > 0 and c == 0 and d == 0


@pytest.mark.parametrize("bad", [{"threads": 0}, {"prompt": "a\0"}, {"patience": 0.0}, {"patience": float("inf")}, {"temperature": 2}, {"beam_size": 0}, {"language": "e1"}, {"no_speech_threshold": float("nan")}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        asr.Params(**bad).validate()


def test_overrides_set_and_clear():
    base = asr.Params(language="en", prompt="p")
    changed = asr.apply_override(base, prompt=asr.CLEAR, threads=8)
    assert (changed.language, changed.prompt, changed.threads) == ("en", None, 8)


def test_registry_misses_and_guards(spark):
    entries = "key string, aligner_id string, language string, seq int"
    known = registry.register(spark.createDataFrame([("en", "a", "en", 1), ("en", "b", "en", 2)], entries))
    chunks = spark.createDataFrame([(1, "en"), (2, "fr"), (3, None)], "chunk_id int, language string")
    assert {r.chunk_id: (r.aligner_id, r.status) for r in registry.lookup(chunks, known).collect()} == {1: ("b", "ok"), 2: (None, "skipped"), 3: (None, "skipped")}
    assert registry.lookup(chunks, known, "error").where("status = 'language_unsupported'").count() == 2
    with pytest.raises(ValueError):
        registry.register(spark.createDataFrame([("en", "a", "de", 1)], entries))
    with pytest.raises(ValueError):
        registry.lookup(chunks, known, "guess")


def test_packets(spark):
    rows = [(1, 1, 90, 0), (1, 2, 100, 48_000), (1, 3, 48_100, 16_000), (1, 4, 96_100 + 9_600, 16_000), (1, 5, 0, 5), (1, 6, 10**6, 5)]
    df = spark.createDataFrame([(s, q, p, 1, 48_000, n) for s, q, p, n in rows], "stream_id bigint, seq bigint, pts bigint, tb_num int, tb_den int, n_samples bigint")
    got = [(r.seq, r.status, r.first_sample, r.gap) for r in ingest.append_packets(df).orderBy("seq").collect()]
    assert got == [(1, "accepted", None, 0), (2, "accepted", 0, 0), (3, "pts_regression", None, 0), (4, "pts_regression", None, 0), (5, "pts_regression", None, 0), (6, "gap_exceeds_tolerance", None, 285_300)]
    small = ingest.append_packets(df, Options(cap_samples=20_000, gap_tolerance=100)).orderBy("seq").collect()
    assert small[1].status == "backpressure" and small[2].status == "accepted" and small[2].first_sample == 0


def test_restart_trim_and_timebases(spark):
    rows = [(1, 1, "packet", 0, 1, 16_000, 100), (1, 2, "packet", 100, 1, 48_000, 100), (1, 3, "trim", 0, 1, 16_000, 60), (1, 4, "restart", 0, 1, 16_000, 0), (1, 5, "packet", 9_999, 1, 16_000, 7), (1, 6, "packet", 0, 0, 1, 7), (1, 7, "eof", 0, 1, 16_000, 0), (1, 8, "packet", 10_006, 1, 16_000, 7)]
    df = spark.createDataFrame(rows, "stream_id bigint, seq bigint, kind string, pts bigint, tb_num int, tb_den int, n_samples bigint")
    got = [(r.status, r.epoch, r.live_samples) for r in ingest.append_packets(df).orderBy("seq").collect()]
    assert got == [("accepted", 0, 100), ("inconsistent_timebase", 0, 100), ("accepted", 0, 40), ("accepted", 1, 0), ("accepted", 1, 7), ("invalid_timebase", 1, 7), ("accepted", 1, 7), ("after_eof", 1, 7)]


def test_options_are_checked():
    for bad in ({"chunk_samples": 0}, {"chunk_samples": 601 * 16_000}, {"cap_samples": 57_600_001}, {"max_in_flight": 4_097}, {"lock_after": 0}, {"gap_tolerance": 10**9}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_clock(spark):
    row = spark.range(1).select(
        clock.sample_to_pts(F.lit(16_000), F.lit(7), F.lit(1), F.lit(48_000)), clock.sample_to_pts(F.lit(16_000), F.lit(0), F.lit(1001), F.lit(30_000)), clock.ms_to_samples(F.lit(1 << 62)),
        clock.saturating_range(F.lit(clock.MAX_LONG), F.lit(5), F.lit(clock.MAX_LONG), F.lit(1), F.lit(16_000)), clock.seconds_to_samples(F.lit(0.5 / 16_000)), clock.samples_per_frame(F.lit(640), F.lit(1)), clock.samples_per_frame(F.lit(640), F.lit(3)),
    ).first()
    assert row[0] == 48_007 and abs(row[1] - 29.97) <= 1 and row[2] == clock.MAX_LONG and tuple(row[3]) == (clock.MAX_LONG, clock.MAX_LONG) and row[4] == 1 and row[5] == 320 and row[6] == 320
    assert clock.max_silent_frames() == 4


def test_events_table_and_sinks(spark, tmp_path):
    good = spark.createDataFrame([(1, 0, "hi")], "stream_id int, chunk_id int, text string")
    bad = spark.createDataFrame([(1, 1, "boom")], "stream_id int, chunk_id int, code string")
    tables.write_events(compose.events(good, bad), str(tmp_path / "out"))
    assert {r.kind for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"transcript", "error"}
    assert not tables.dump(good, str(tmp_path / "no")) and tables.dump(good, str(tmp_path / "yes"), True)
    assert tables.read(spark, str(tmp_path / "yes"), "stream_id int, chunk_id int, text string").count() == 1


def test_text_and_frames_to_timed_words(spark):
    ids = dict(vocabulary.BUNDLED)
    body, frames = "hi bob", []
    emitted = [ids["H"], ids["I"], ids["|"], ids["B"], ids["O"], ids["B"]]
    for t in range(60):
        lp = [-8.0] * 32
        lp[emitted[t // 10] if t % 10 < 4 else 0] = -0.05
        frames.append((1, t, lp))
    clips = spark.createDataFrame([(1, body, "en", 19_200, 19_200, 1_000), (2, "?!", "en", 19_200, 19_200, 0), (3, "x", "ar", 10, 10, 0)], "clip_id bigint, text string, language string, n_samples bigint, real_samples bigint, first_sample bigint")
    prepared = lifecycle.prepare(clips, vocabulary.BUNDLED)
    assert {r.clip_id: (r.status, r.is_trivial) for r in prepared.collect()} == {1: ("ok", False), 2: ("empty_text", True), 3: ("no_normalizer", True)}
    words = lifecycle.finish(prepared, spark.createDataFrame(frames, "clip_id bigint, frame int, lp array<float>"), spark.createDataFrame([(1, 0, 19_200)], "clip_id bigint, start bigint, end bigint")).orderBy("word_index").collect()
    assert [(w.text, w.drop_reason) for w in words] == [("hi", None), ("bob", None)]
    assert 1_000 <= words[0].start_sample < words[0].end_sample <= words[1].start_sample < words[1].end_sample <= 20_200


def test_token_times_of_every_order(spark):
    lines = {}
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").collect():
        lines.setdefault(r.l_orderkey, []).append((r.l_linenumber, r.l_partkey, r.l_suppkey, r.l_quantity, r.l_extendedprice))
    want = {}
    for order, rows in lines.items():
        for run in range(3):
            start, end = run * 4, run * 4 + (4 if order % 2 == 0 else 5)
            inside = [part if part % 9 else None for i, (_, part, *_) in enumerate(sorted(rows)) if start <= 2 * i and 2 * i + 2 <= end]
            crossing = any(2 * i < end < 2 * i + 2 for i in range(len(rows)))
            timed = [t for t in inside if t is not None]
            want[order, run] = (min(timed, default=None), max(timed, default=None), bool(inside) and not crossing and len(timed) == len(inside))
    got = {(r.l_orderkey, r.run): (r.lo_dtw, r.hi_dtw, r.all_timed) for r in QUERIES["g8_token_times"](spark, SMALL).collect()}
    assert got == want
