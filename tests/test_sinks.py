"""Tables that a stream fans out to hold each batch once; streamed answers; runs and tokens of a long segment."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators import runs
from spanloom.streaming import sinks
from spanloom.streaming.answers import answer_stream

ROWS = "stream_id bigint, status string"
TABLES = {"good": "status = 'ok'", "bad": "status <> 'ok'", "all": "true"}


def contents(spark, path):
    return {name: sorted((r.batch_id, r.stream_id, r.status) for r in sinks.read_table(spark, path, name, ROWS).collect()) for name in TABLES}


def test_a_batch_that_runs_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path)
    write = sinks.batch_writer({k: F.expr(v) for k, v in TABLES.items()}, path)
    first, second = (spark.createDataFrame(rows, ROWS) for rows in ([(1, "ok"), (1, "ok"), (2, "late"), (3, None)], [(4, "late")]))
    write(first, 0)
    write(second, 1)
    once = contents(spark, path)
    assert once == {"good": [(0, 1, "ok")] * 2, "bad": [(0, 2, "late"), (1, 4, "late")], "all": sorted([(0, 1, "ok"), (0, 1, "ok"), (0, 2, "late"), (0, 3, None), (1, 4, "late")], key=lambda r: r[:2])}
    write(first, 0)
    assert contents(spark, path) == once


def test_a_batch_that_failed_between_tables_is_made_whole(spark, tmp_path):
    path, rows = str(tmp_path), spark.createDataFrame([(1, "ok"), (2, "late")], ROWS)
    broken = sinks.batch_writer({"good": F.expr(TABLES["good"]), "bad": F.expr("raise_error('lost')")}, path)
    with pytest.raises(Exception, match="lost"):
        broken(rows, 7)
    sinks.batch_writer({k: F.expr(v) for k, v in TABLES.items()}, path)(rows, 7)
    assert contents(spark, path) == {"good": [(7, 1, "ok")], "bad": [(7, 2, "late")], "all": [(7, 1, "ok"), (7, 2, "late")]}


def test_a_restarted_stream_goes_on_where_it_was(spark, tmp_path):
    for k, rows in enumerate(([(1, "ok")], [(2, "late")])):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sinks.fan_out(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in"), {n: F.expr(v) for n, v in TABLES.items()}, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        assert len(contents(spark, f"{tmp_path}/out")["all"]) == k + 1


def test_answers_by_time(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00"
    chunks = [(1, 0, "asr", at(1)), (1, 1, "ready", at(1)), (2, 0, "asr", at(2)), (-1, -1, "asr", "2024-02-01 00:00:00")]
    answers = [(1, 0, at(2)), (1, 1, at(2)), (2, 0, at(30)), (3, 3, at(2)), (None, 0, at(2)), (1, 0, None), (1, 0, at(3)), (-1, -1, "2024-02-01 00:00:00")]
    for name, rows, schema in (("chunks", chunks, "stream_id bigint, chunk_id bigint, phase string, at string"), ("answers", answers, "stream_id bigint, chunk_id bigint, at string")):
        spark.createDataFrame(rows, schema).withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    sides = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}").schema).parquet(f"{tmp_path}/{name}") for name in ("chunks", "answers")]
    met = answer_stream(*sides, "asr", "10 minutes")
    met.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = list((str(r.stream_id), r.chunk_id, None if r.at is None else r.at.minute, r.status) for r in spark.read.schema(met.schema).parquet(f"{tmp_path}/out").where("stream_id >= 0 OR stream_id IS NULL").collect())
    want = [("1", 0, None, "unknown_chunk"), ("1", 0, 2, "accepted"), ("1", 0, 3, "accepted"), ("1", 1, 2, "unknown_chunk"), ("2", 0, 30, "unknown_chunk"), ("3", 3, 2, "unknown_chunk"), ("None", 0, 2, "unknown_chunk")]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("cell", [3, 64, 10_000])
def test_runs_meet_tokens_as_plainly(spark, cell):
    rng = random.Random(cell)
    spans, toks = [], []
    for seg in range(6):
        for run in range(rng.randint(1, 6)):
            a = rng.randint(0, 60)
            spans.append((seg, run, a, a + rng.randint(0, 40), "text"))
        for _ in range(rng.randint(0, 25)):
            toks.append((seg, rng.randint(0, 90), rng.choice([0, 1, 4, 30]), rng.choice([None, rng.randint(0, 99), 5])))
    want = {}
    for seg, run, a, b, _ in spans:
        mine = [(o, o + n, t) for s, o, n, t in toks if s == seg and n > 0 and min(o + n, b) > max(o, a)]
        inside = [t for o, e, t in mine if o >= a and e <= b]
        times = [t for t in inside if t is not None]
        want[seg, run] = (min(times, default=None), max(times, default=None), bool(inside) and len(inside) == len(mine) == len(times))
    got = runs.run_times(spark.createDataFrame(spans, "seg bigint, run int, byte_start bigint, byte_end bigint, text string"), spark.createDataFrame(toks, "seg bigint, byte_offset bigint, byte_len bigint, t_dtw_cs bigint"), ["seg"], cell)
    assert {(r.seg, r.run): (r.lo_dtw, r.hi_dtw, r.all_timed) for r in got.collect()} == want


def test_a_long_segment_takes_linear_time(spark):
    words = spark.range(20_000)
    spans = words.where("id % 4 = 0").select(F.lit(1).alias("seg"), F.col("id").alias("run"), (F.col("id") * 6).alias("byte_start"), (F.col("id") * 6 + 24).alias("byte_end"))
    toks = words.select(F.lit(1).alias("seg"), (F.col("id") * 6).alias("byte_offset"), F.lit(6).cast("bigint").alias("byte_len"), F.col("id").alias("t_dtw_cs"))
    begin = time.monotonic()
    found = runs.run_times(spans, toks, ["seg"]).where("all_timed AND hi_dtw = lo_dtw + 3").count()
    assert found == 5_000 and time.monotonic() - begin < 30
