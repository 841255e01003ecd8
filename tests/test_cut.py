import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import cut
from spanloom.operators.cut import Acceptance, Cutter


def bounds(chunks):
    return [c[:2] for c in chunks]


def test_oversize_span_splits_into_equal_parts():
    c = Cutter(10_000)
    made = list(c.push(0, 29_000))
    assert bounds(made) == [(0, 9_666), (9_666, 19_333)]
    assert bounds(c.flush()) == [(19_333, 29_000)]


def test_chunks_hold_their_inner_silence_and_close_at_the_limit():
    c = Cutter(10_000)
    assert list(c.push(0, 4_000)) == [] and list(c.push(6_000, 10_000)) == []
    assert bounds(c.push(10_000, 10_001)) == [(0, 10_000)]
    assert bounds(c.flush()) == [(10_000, 10_001)] and list(c.flush()) == []


def test_gap_limit_is_strict():
    c = Cutter(100_000, gap=500)
    list(c.push(0, 1_000))
    assert not c.would_flush_at(1_500) and c.would_flush_at(1_501)
    assert list(c.push(1_500, 1_600)) == []
    assert bounds(c.push(2_101, 2_200)) == [(0, 1_600)]


def test_override_is_the_one_at_the_chunks_start():
    c = Cutter(1_000)
    list(c.push(0, 600, "a"))
    first = list(c.push(600, 1_200, "b"))
    assert first[0][2] == "a" and list(c.flush())[0][2] == "b"


def test_rejections_leave_the_watermark():
    a = Acceptance(high_water=1_000)
    assert a.judge("vad", 0, 400) == "accepted"
    assert a.judge("vad", 399, 900) == "vad_regression" and a.watermark == 400
    assert a.judge("vad", 500, 1_001) == "vad_ahead_of_audio"
    assert a.judge("vad", 500, 500) == "invalid_span"
    assert a.judge("vad", 400, 500) == "accepted"
    assert a.judge("no_speech", 0, 450) == "vad_regression" and a.judge("no_speech", 0, 800) == "accepted"
    assert a.judge("eof", 0, 0) == "accepted" and a.judge("eof", 0, 0) == "accepted" and a.judge("vad", 900, 950) == "after_eof"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 3_000)), max_size=30), st.integers(1, 1_000), st.one_of(st.none(), st.integers(0, 300)))
def test_no_sample_is_lost_and_no_sub_is_too_long(steps, limit, gap):
    c, at, fed, made = Cutter(limit, gap), 0, [], []
    for pause, length in steps:
        fed.append((at + pause, at + pause + length))
        at += pause + length
        made += c.push(*fed[-1])
    made += c.flush()
    subs = [s for m in made for s in m[3]]
    assert sum(s[1] - s[0] for s in subs) == sum(e - s for s, e in fed)
    assert all(0 < s[1] - s[0] <= limit for s in subs) and all(m[1] - m[0] <= limit for m in made)
    assert all(a[1] <= b[0] for a, b in zip(made, made[1:]))


def test_fold_keeps_streams_apart_and_ids_gap_free(spark):
    rows = [(1, 1, 0, 32_000), (1, 2, 32_000, 64_000), (1, 3, 64_000, 96_000), (2, 1, 0, 10), (None, 1, 5, 9)]
    made = cut.cut(spark.createDataFrame(rows, "stream_id bigint, seq bigint, start_sample bigint, end_sample bigint"), 32_000).collect()
    assert sorted((r.stream_id or 0, r.chunk_id, r.start_sample, r.end_sample) for r in made) == [(0, 0, 5, 9), (1, 0, 0, 32_000), (1, 1, 32_000, 64_000), (1, 2, 64_000, 96_000), (2, 0, 0, 10)]


def test_markers_flush_and_restart(spark):
    rows = [(1, 1, 0, 100, "vad"), (1, 2, 0, 5_000, "no_speech"), (1, 3, 5_000, 5_100, "vad"), (1, 4, 0, 0, "restart"), (1, 5, 0, 50, "vad"), (1, 6, 0, 0, "eof"), (1, 7, 60, 70, "vad")]
    df = spark.createDataFrame(rows, "stream_id bigint, seq bigint, start_sample bigint, end_sample bigint, kind string")
    assert [(r.chunk_id, r.start_sample, r.end_sample) for r in cut.cut(df, 100_000, 1_000).orderBy("chunk_id").collect()] == [(0, 0, 100), (1, 5_000, 5_100), (2, 0, 50)]
    assert [r.status for r in cut.outcomes(df).orderBy("seq").collect()][-1] == "after_eof"


def test_empty_input_and_bad_limit(spark):
    none = spark.createDataFrame([], "stream_id bigint, seq bigint, start_sample bigint, end_sample bigint")
    assert cut.cut(none, 10).count() == 0
    with pytest.raises(ValueError):
        cut.cut(none, 0)


def test_packet_precheck_is_all_or_nothing(spark):
    rows = [(1, 1, 1, 0, 1_000, 0, 400), (1, 1, 2, 0, 1_000, 400, 900), (1, 2, 1, 900, 2_000, 950, 1_200), (1, 2, 2, 900, 2_000, 1_100, 1_300)]
    df = spark.createDataFrame(rows, "stream_id int, packet_id int, start_seq int, watermark int, high_water int, start_sample int, end_sample int")
    from pyspark.sql import functions as F

    assert {r.packet_id: r.accepted for r in cut.precheck_packets(df, F.col("packet_id")).collect()} == {1: True, 2: False}


def test_stream_gives_the_batch_result(spark, tmp_path):
    from spanloom.streaming.cutter import cut_stream

    schema = "stream_id bigint, seq bigint, start_sample bigint, end_sample bigint, kind string"
    rows = [(s, k, k * 700 + s, k * 700 + 300 + 40 * s, "vad") for s in range(3) for k in range(1, 12)] + [(s, 99, 0, 0, "eof") for s in range(3)]
    df = spark.createDataFrame(rows, schema)
    (tmp_path / "in").mkdir()
    for part in range(3):
        df.where(f"seq % 3 = {part} AND seq < 99 OR seq = 99 AND {part} = 2").where("true").coalesce(1)
    for low, high in ((0, 4), (4, 8), (8, 100)):
        df.where(f"seq >= {low} AND seq < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = sorted((r.stream_id, r.chunk_id, r.start_sample, r.end_sample, len(r.subs)) for r in cut.cut(df, 2_000, 600).collect())
    # Files come in the order in which they were written, one a trigger.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = cut_stream(stream, 2_000, 600).writeStream.format("memory").queryName("cut_chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted((r.stream_id, r.chunk_id, r.start_sample, r.end_sample, len(r.subs)) for r in spark.table("cut_chunks").collect())
    assert got == want
