"""Ingestion, cutting and interval queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import clock
from spanloom.operators import cut, ingest, intervals
from spanloom.operators.cut import CHUNKS
from spanloom.operators.validate import would_accept
from spanloom.plans.shared import remove_folder, shared_folder
from spanloom.queries.fixtures import CHUNKS_SQL, FRAME, GAP, LIMIT, SPANS_SQL, chunks, spans, table
from spanloom.streaming import folds, sinks
from spanloom.streaming.answers import answer_stream
from spanloom.streaming.cutter import cut_stream


def w1_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cut.cut(spans(spark, sf_dir), LIMIT, GAP)
    split = F.size(F.filter("subs", lambda s: s["kind"] == "hard_split")).cast("bigint")
    return made.select("stream_id", "chunk_id", "start_sample", "end_sample", F.size("subs").cast("bigint").alias("n_subs"), split.alias("n_split"), F.get("subs", F.lit(0))["vad_seq"].cast("bigint").alias("first_seq"))


_ACCEPTED_SQL = f"""{SPANS_SQL}, judged AS (
  SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS watermark, 'start' AS status FROM spans
  UNION ALL
  SELECT s.stream_id, s.seq,
    CASE WHEN s.end_sample > s.start_sample AND s.start_sample >= j.watermark THEN s.end_sample ELSE j.watermark END,
    CASE WHEN s.end_sample <= s.start_sample THEN 'invalid_span' WHEN s.start_sample < j.watermark THEN 'vad_regression' ELSE 'accepted' END
  FROM judged j JOIN spans s ON s.stream_id = j.stream_id AND s.seq = j.seq + 1
)"""

W1_SQL = f"""WITH RECURSIVE {_ACCEPTED_SQL}, accepted AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.stream_id ORDER BY s.seq) - 1 AS vad_seq
  FROM spans s JOIN judged j ON s.stream_id = j.stream_id AND s.seq = j.seq WHERE j.status = 'accepted'
), counted AS (
  SELECT *, end_sample - start_sample AS len, CASE WHEN end_sample - start_sample > {LIMIT} THEN (end_sample - start_sample + {LIMIT - 1}) // {LIMIT} ELSE 1 END AS n FROM accepted
), parts AS (
  SELECT *, unnest(range(n)) AS i FROM counted
), subs AS (
  SELECT stream_id, vad_seq, n, start_sample + i * len // n AS s, CASE WHEN i = n - 1 THEN end_sample ELSE start_sample + (i + 1) * len // n END AS e,
    row_number() OVER (PARTITION BY stream_id ORDER BY vad_seq, i) AS k FROM parts
), fold AS (
  SELECT stream_id, k, s, e, vad_seq, n, s AS cs, e AS ce, CAST(0 AS BIGINT) AS chunk_id FROM subs WHERE k = 1
  UNION ALL
  SELECT u.stream_id, u.k, u.s, u.e, u.vad_seq, u.n,
    CASE WHEN f.ce > f.cs AND (u.s - f.ce > {GAP} OR u.e - f.cs > {LIMIT}) THEN u.s ELSE f.cs END, u.e,
    f.chunk_id + CASE WHEN f.ce > f.cs AND (u.s - f.ce > {GAP} OR u.e - f.cs > {LIMIT}) THEN 1 ELSE 0 END
  FROM fold f JOIN subs u ON u.stream_id = f.stream_id AND u.k = f.k + 1
)
SELECT stream_id, chunk_id, min(s) AS start_sample, max(e) AS end_sample, count(*) AS n_subs, count(*) FILTER (n > 1) AS n_split, min(vad_seq) AS first_seq
FROM fold GROUP BY stream_id, chunk_id"""


def r2_span_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut.outcomes(spans(spark, sf_dir))


R2_SQL = f"WITH RECURSIVE {_ACCEPTED_SQL} SELECT stream_id, seq, status, watermark FROM judged WHERE seq > 0"


def w8_hard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut.hard_split(spans(spark, sf_dir), LIMIT).select("stream_id", "seq", "part", "total_parts", "part_start", "part_end")


W8_SQL = f"""WITH {SPANS_SQL}, counted AS (
  SELECT *, end_sample - start_sample AS len, CASE WHEN end_sample - start_sample > {LIMIT} THEN (end_sample - start_sample + {LIMIT - 1}) // {LIMIT} ELSE 1 END AS n FROM spans
), parts AS (SELECT *, unnest(range(n)) AS i FROM counted)
SELECT stream_id, seq, i AS part, n AS total_parts, start_sample + i * len // n AS part_start,
  CASE WHEN i = n - 1 THEN end_sample ELSE start_sample + (i + 1) * len // n END AS part_end FROM parts"""


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of 48,000 to 48,004 ticks at 1/48000 that mostly follow each other, with gaps and steps back."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(order).cast("bigint"))
    shift = F.when(F.col("event_id") % 11 == 0, 9000).when(F.col("event_id") % 13 == 0, -900).when(F.col("event_id") % 7 == 0, 3000).otherwise(0)
    return rows.select(F.col("user_id").alias("stream_id"), "seq", (F.col("seq") * 48_000 + shift).alias("pts"), F.lit(1).alias("tb_num"), F.lit(48_000).alias("tb_den"), F.when(F.col("event_id") % 17 == 0, 0).otherwise(16_000).cast("bigint").alias("n_samples"))


def r1_append_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.append_packets(_packets(spark, sf_dir)).select("stream_id", "seq", "status", "gap", "n_samples", "total_samples")


R1_SQL = """WITH RECURSIVE packets AS (
  SELECT user_id AS stream_id, seq, seq * 48000 + CASE WHEN event_id % 11 = 0 THEN 9000 WHEN event_id % 13 = 0 THEN -900 WHEN event_id % 7 = 0 THEN 3000 ELSE 0 END AS pts,
    CASE WHEN event_id % 17 = 0 THEN 0 ELSE 16000 END AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
), fold AS (
  SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS anchor, CAST(0 AS BIGINT) AS total, 'start' AS status, CAST(0 AS BIGINT) AS gap, CAST(0 AS BIGINT) AS taken FROM packets
  UNION ALL
  SELECT stream_id, seq, CASE WHEN status = 'accepted' AND n > 0 THEN coalesce(anchor, pts) ELSE anchor END,
    CASE WHEN status = 'accepted' AND n > 0 THEN total + gap + n ELSE total END, status,
    CASE WHEN status = 'pts_regression' OR (status = 'accepted' AND n = 0) THEN 0 ELSE gap END, CASE WHEN status = 'accepted' THEN n ELSE 0 END
  FROM (
    SELECT *, CASE WHEN delta < 0 THEN 'pts_regression' WHEN gap > 3200 THEN 'gap_exceeds_tolerance' WHEN total + gap + n > 5796000 THEN 'backpressure' ELSE 'accepted' END AS status
    FROM (
      SELECT p.stream_id, p.seq, p.pts, p.n, f.anchor, f.total,
        CASE WHEN f.anchor IS NULL THEN 0 ELSE p.pts - (f.anchor + f.total * 3) END AS delta,
        CASE WHEN f.anchor IS NULL OR p.pts - (f.anchor + f.total * 3) < 0 THEN 0 ELSE (p.pts - (f.anchor + f.total * 3)) // 3 END AS gap
      FROM fold f JOIN packets p ON p.stream_id = f.stream_id AND p.seq = f.seq + 1)))
SELECT stream_id, seq, status, gap, taken AS n_samples, total AS total_samples FROM fold WHERE seq > 0"""


def p1_sample_to_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 7_919).alias("sample"))
    num = F.when(F.col("event_id") % 3 == 2, 1001).otherwise(1)
    den = F.element_at(F.array(F.lit(48_000), F.lit(1_000), F.lit(30_000)), (F.col("event_id") % 3 + 1).cast("int"))
    return rows.select("event_id", clock.sample_to_pts(F.col("sample"), F.lit(500), num, den).alias("pts"), clock.ms_to_samples(F.col("event_id")).alias("ms_samples"), clock.seconds_to_samples(F.col("event_id") / 7.0).alias("rounded_samples"))


P1_SQL = """SELECT event_id, 500 + (event_id * 7919 * CASE event_id % 3 WHEN 0 THEN 48000 WHEN 1 THEN 1000 ELSE 30000 END) // (16000 * CASE WHEN event_id % 3 = 2 THEN 1001 ELSE 1 END) AS pts,
  event_id * 16 AS ms_samples, CAST(floor(event_id / 7.0::DOUBLE * 16000 + 0.5) AS BIGINT) AS rounded_samples FROM events"""


def p5_would_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("live"), F.count("*").alias("queued"))
    top = F.lit(clock.MAX_LONG)
    return rows.select("l_orderkey", would_accept(F.col("live"), F.col("queued"), F.when(F.col("l_orderkey") % 5 == 0, top).otherwise(F.lit(50).cast("bigint")), F.lit(150)).alias("accepts"))


P5_SQL = """SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN false ELSE CAST(sum(l_quantity) AS BIGINT) + count(*) + 50 <= 150 END AS accepts FROM lineitem GROUP BY l_orderkey"""


def _clip_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select(F.col("stream_id").alias("clip_id"), F.col("start_sample").alias("start"), F.col("end_sample").alias("end"))


def o4_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_intervals(_clip_spans(spark, sf_dir))


_UNION_SQL = f"""{SPANS_SQL}, reach AS (
  SELECT stream_id AS clip_id, start_sample AS s, end_sample AS e, max(end_sample) OVER (PARTITION BY stream_id ORDER BY start_sample, end_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM spans WHERE end_sample > start_sample
), islands AS (
  SELECT clip_id, s, e, sum(CASE WHEN s <= r THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach
), merged AS (SELECT clip_id, min(s) AS start, max(e) AS "end" FROM islands GROUP BY clip_id, island)"""
O4_SQL = f"WITH {_UNION_SQL} SELECT * FROM merged"

SLICE = 7 * 24 * 3600 * 16_000


def j9_interval_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.clip_to_slices(intervals.union_intervals(_clip_spans(spark, sf_dir)), SLICE)


J9_SQL = f"""WITH {_UNION_SQL}, hit AS (SELECT *, unnest(range(start // {SLICE}, ("end" - 1) // {SLICE} + 1)) AS slice FROM merged)
SELECT clip_id, slice, greatest(start, slice * {SLICE}) - slice * {SLICE} AS start, least("end", (slice + 1) * {SLICE}) - slice * {SLICE} AS "end" FROM hit"""

#: Frames of a stream's month, its padded length, and the length of real audio.
_T, _N, _REAL = 721, 720 * FRAME + 333, 700 * FRAME


def _speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.union_intervals(_clip_spans(spark, sf_dir))
    clips = merged.select("clip_id").distinct().withColumns({"frames": F.lit(_T).cast("bigint"), "spf": clock.samples_per_frame(F.lit(_N), F.lit(_T)), "real_samples": F.lit(_REAL).cast("bigint")})
    return intervals.speech_frames(clips, merged)


def j7_speech_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speech(spark, sf_dir)


_SPF = f"({_N}::DOUBLE / {_T - 1})"
_SPEECH_SQL = f"""{_UNION_SQL}, held AS (
  SELECT clip_id, start AS s, least("end", {_REAL}) AS e FROM merged WHERE least("end", {_REAL}) > start
), touched AS (
  SELECT *, unnest(range(CAST(floor(s / {_SPF}) AS BIGINT), least(CAST(ceil(e / {_SPF}) AS BIGINT), {_T}))) AS frame FROM held
), summed AS (
  SELECT clip_id, frame, sum(greatest(0, least(e, CAST(round((frame + 1) * {_SPF}) AS BIGINT)) - greatest(s, CAST(round(frame * {_SPF}) AS BIGINT)))) AS overlap FROM touched GROUP BY clip_id, frame
), every AS (
  SELECT clip_id, unnest(range({_T})) AS frame FROM (SELECT DISTINCT clip_id FROM merged)
), widths AS (
  SELECT clip_id, frame, least(CAST(round((frame + 1) * {_SPF}) AS BIGINT), {_REAL}) - least(CAST(round(frame * {_SPF}) AS BIGINT), {_REAL}) AS w FROM every
), speech AS (
  SELECT w.clip_id, w.frame, CAST(coalesce(s.overlap, 0) AS BIGINT) AS overlap,
    coalesce(s.overlap, 0) > 0 AND coalesce(s.overlap, 0) >= CASE WHEN w.w > 0 THEN least(greatest(1, w.w // 2 + w.w % 2), greatest(1, CAST(floor({_SPF}) AS BIGINT) // 2 + CAST(floor({_SPF}) AS BIGINT) % 2))
      ELSE greatest(1, CAST(floor({_SPF}) AS BIGINT) // 2 + CAST(floor({_SPF}) AS BIGINT) % 2) END AS is_speech
  FROM widths w LEFT JOIN summed s ON w.clip_id = s.clip_id AND w.frame = s.frame)"""
J7_SQL = f"WITH {_SPEECH_SQL} SELECT * FROM speech"


def w5_frame_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and the longest silence of each day's frames."""
    frames = _speech(spark, sf_dir).withColumn("day", F.call_function("div", F.col("frame"), F.lit(24).cast("bigint")))
    return intervals.frame_runs(frames, ["clip_id", "day"]).withColumn("coverage", F.round(F.col("coverage").cast("double"), 6))


W5_SQL = f"""WITH {_SPEECH_SQL}, days AS (SELECT *, frame // 24 AS day FROM speech),
marked AS (SELECT *, CASE WHEN is_speech = lag(is_speech) OVER (PARTITION BY clip_id, day ORDER BY frame) THEN 0 ELSE 1 END AS c FROM days),
runs AS (SELECT *, sum(c) OVER (PARTITION BY clip_id, day ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM marked),
lengths AS (SELECT clip_id, day, run, count(*) AS n, bool_and(is_speech) AS speech FROM runs GROUP BY clip_id, day, run)
SELECT clip_id, day, CAST(sum(CASE WHEN speech THEN n ELSE 0 END) AS BIGINT) AS speech_frames, CAST(sum(n) AS BIGINT) AS total_frames,
  round(CAST(CAST(sum(CASE WHEN speech THEN n ELSE 0 END)::DOUBLE / sum(n) AS FLOAT) AS DOUBLE), 6) AS coverage, max(CASE WHEN speech THEN 0 ELSE n END) AS longest_silence
FROM lengths GROUP BY clip_id, day"""

def t3_stream_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut as a streaming query over the events' file, to its end: chunks that closed; each stream's last one is still open."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    start = F.call_function("div", micros * 16, F.lit(1000).cast("bigint"))
    end = start + F.round(F.col("value") * 100).cast("bigint") * (16_000 * 6)
    rows = source.select(F.col("user_id").alias("stream_id"), (micros * 1_000_000 + F.col("event_id")).alias("seq"), start.alias("start_sample"), end.alias("end_sample"))
    at = shared_folder(spark, "stream-cut")
    query = cut_stream(rows, LIMIT, GAP).writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(CHUNKS).parquet(f"{at}/out").select("stream_id", "chunk_id", "start_sample", "end_sample")


T3_SQL = f"SELECT stream_id, chunk_id, start_sample, end_sample FROM ({W1_SQL}) QUALIFY chunk_id < max(chunk_id) OVER (PARTITION BY stream_id)"


def _markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans, some of which are markers of silence, ends or restarts instead, and some without a start."""
    rows = spans(spark, sf_dir, "event_id")
    kind = F.when(F.col("event_id") % 29 == 0, "no_speech").when(F.col("event_id") % 97 == 0, "eof").when(F.col("event_id") % 61 == 0, "restart").otherwise("vad")
    return rows.select("stream_id", "seq", kind.alias("kind"), F.when(F.col("event_id") % 41 != 0, F.col("start_sample")).alias("start_sample"), "end_sample", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("p"), F.col("event_id") % 3)).alias("override"))


_MARKED_SQL = SPANS_SQL.replace("FROM events)", ", event_id FROM events)").replace(" AS end_sample\n", " AS end_sample") + """, marked AS (
  SELECT stream_id, seq, CASE WHEN event_id % 29 = 0 THEN 'no_speech' WHEN event_id % 97 = 0 THEN 'eof' WHEN event_id % 61 = 0 THEN 'restart' ELSE 'vad' END AS kind, CASE WHEN event_id % 41 <> 0 THEN start_sample END AS s, end_sample AS e, CASE WHEN event_id % 5 = 0 THEN 'p' || (event_id % 3) END AS override FROM spans
), judged AS (
  SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS watermark, false AS ended, 'start' AS status FROM marked
  UNION ALL
  SELECT stream_id, seq, CASE WHEN kind = 'restart' THEN 0 WHEN status = 'accepted' AND kind IN ('vad', 'no_speech') THEN e ELSE watermark END, kind <> 'restart' AND (ended OR kind = 'eof'), status FROM (
    SELECT m.*, j.watermark, j.ended, CASE WHEN m.kind = 'restart' THEN 'accepted' WHEN j.ended THEN CASE WHEN m.kind = 'eof' THEN 'accepted' ELSE 'after_eof' END WHEN m.kind = 'eof' THEN 'accepted'
      WHEN m.kind = 'no_speech' THEN CASE WHEN m.e < j.watermark THEN 'vad_regression' ELSE 'accepted' END WHEN m.s IS NULL THEN 'missing_bounds'
      WHEN m.e <= m.s THEN 'invalid_span' WHEN m.s < j.watermark THEN 'vad_regression' ELSE 'accepted' END AS status
    FROM judged j JOIN marked m ON m.stream_id = j.stream_id AND m.seq = j.seq + 1)
)"""


def r4_marker_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and watermark after every span and every marker."""
    return cut.outcomes(_markers(spark, sf_dir))


R4_SQL = f"WITH RECURSIVE {_MARKED_SQL} SELECT stream_id, seq, status, watermark FROM judged WHERE seq > 0"


def t9_marker_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of streams with markers: silence beyond the limit, an end and a restart close the open chunk; a chunk has the parameters of the span that opened it."""
    return cut.cut(_markers(spark, sf_dir), LIMIT, GAP).select("stream_id", "chunk_id", "start_sample", "end_sample", "override_at_start", F.size("subs").cast("bigint").alias("n_subs"))


T9_SQL = f"""WITH RECURSIVE {_MARKED_SQL}, counted AS (
  SELECT m.*, CASE WHEN m.kind = 'vad' THEN m.e - m.s END AS len, CASE WHEN m.kind = 'vad' AND m.e - m.s > {LIMIT} THEN (m.e - m.s + {LIMIT - 1}) // {LIMIT} ELSE 1 END AS n
  FROM marked m JOIN judged j ON m.stream_id = j.stream_id AND m.seq = j.seq WHERE j.status = 'accepted'
), parts AS (SELECT *, unnest(range(n)) AS i FROM counted
), steps AS (
  SELECT stream_id, kind, CASE WHEN kind = 'vad' THEN s + i * len // n END AS s, CASE WHEN kind <> 'vad' OR i = n - 1 THEN e ELSE s + (i + 1) * len // n END AS e, row_number() OVER (PARTITION BY stream_id ORDER BY seq, i) AS k, override FROM parts
), fold AS (
  SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS k, 'start' AS kind, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS cs, CAST(0 AS BIGINT) AS ce, CAST(0 AS BIGINT) AS id FROM steps
  UNION ALL
  SELECT stream_id, k, kind, s, e, CASE WHEN kind <> 'vad' THEN CASE WHEN NOT closes THEN cs END WHEN closes OR cs IS NULL THEN s ELSE cs END, CASE WHEN kind = 'vad' THEN e ELSE ce END, id + CASE WHEN closes THEN 1 ELSE 0 END FROM (
    SELECT u.stream_id, u.k, u.kind, u.s, u.e, f.cs, f.ce, f.id, f.cs IS NOT NULL AND CASE u.kind WHEN 'vad' THEN f.ce > f.cs AND (u.s - f.ce > {GAP} OR u.e - f.cs > {LIMIT}) WHEN 'no_speech' THEN f.ce > f.cs AND u.e - f.ce > {GAP} ELSE true END AS closes
    FROM fold f JOIN steps u ON u.stream_id = f.stream_id AND u.k = f.k + 1)
)
SELECT f.stream_id, f.id AS chunk_id, min(f.s) AS start_sample, max_by(f.e, f.k) AS end_sample, first(u.override ORDER BY f.k) AS override_at_start, count(*) AS n_subs
FROM fold f JOIN steps u ON u.stream_id = f.stream_id AND u.k = f.k WHERE f.kind = 'vad' GROUP BY f.stream_id, f.id"""


def _streamed(spark: SparkSession, rows: DataFrame, of_stream: Callable[[DataFrame], DataFrame], schema: str, files: int = 3) -> DataFrame:
    """of_stream over rows that come in several triggers, to their end. rows: in the order of column `arrives`, a number from 0 to files - 1."""
    at = shared_folder(spark, "stream")
    rows.repartitionByRange(files, "arrives").write.parquet(f"{at}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    query = of_stream(source).writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    remove_folder(spark, f"{at}/in")
    remove_folder(spark, f"{at}/state")
    return spark.read.schema(schema).parquet(f"{at}/out")


def t5_stream_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets appended as a stream in one trigger, with each stream's buffer in the state store."""
    rows = _packets(spark, sf_dir).withColumn("arrives", F.lit(0))
    return _streamed(spark, rows, folds.append_packets_stream, ingest.PACKETS, 1).select("stream_id", "seq", "status", "gap", "n_samples", "total_samples")


def t8_stream_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved chunks that come out of order in three triggers, emitted in order; pending ones never come."""
    rows = chunks(spark, sf_dir).where("o_orderstatus <> 'P'").select("stream_id", "chunk_id", F.col("o_orderkey").cast("string").alias("payload"), (F.col("o_orderkey") % 3).cast("int").alias("arrives"))
    found = _streamed(spark, rows, folds.in_order_stream, "stream_id bigint, chunk_id bigint, payload string")
    return found.select("stream_id", "chunk_id", F.col("payload").cast("bigint").alias("o_orderkey"))


_DUE = {"accepted": "status = 'accepted'", "rejected": "status <> 'accepted'", "full": "status = 'backpressure' OR live_samples >= 96000"}


def t2_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of packets that come in three triggers, dealt to tables of accepted, rejected and crowded ones."""
    rows = _packets(spark, sf_dir)
    rows = rows.withColumn("arrives", F.least(F.lit(2), F.call_function("div", F.col("seq"), F.lit(40).cast("bigint"))).cast("int"))
    at = shared_folder(spark, "fan-out")
    # Files come in the order in which they were written, two at a time.
    for k in range(3):
        rows.where(F.col("arrives") == k).repartition(2).write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    sinks.fan_out(folds.append_packets_stream(source), {k: F.expr(v) for k, v in _DUE.items()}, f"{at}/out", f"{at}/state").awaitTermination()
    remove_folder(spark, f"{at}/in")
    remove_folder(spark, f"{at}/state")
    found = [sinks.read_table(spark, f"{at}/out", name, ingest.PACKETS) for name in _DUE]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("table", "stream_id", "seq", "status", "gap", "n_samples", F.col("live_samples").alias("live"))


def _t2_sql() -> str:
    head, body = R1_SQL.rsplit("\nSELECT", 1)
    return f"""{head}, outcomes AS (SELECT {body.replace("total AS total_samples", "total AS live")})
SELECT 'accepted' AS "table", * FROM outcomes WHERE status = 'accepted' UNION ALL SELECT 'rejected', * FROM outcomes WHERE status <> 'accepted' UNION ALL SELECT 'full', * FROM outcomes WHERE status = 'backpressure' OR live >= 96000"""


T2_SQL = _t2_sql()


def r7_streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of r7 and their chunks as two streams that meet in the state store; a last row on each side lets the unknown ones go."""
    rows = chunks(spark, sf_dir)
    moment = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) + seconds)
    phase = F.when(F.col("o_orderstatus") == "F", "awaiting_asr").when(F.col("o_orderstatus") == "O", "awaiting_alignment").otherwise("ready")
    end = spark.range(1).select(F.lit(-1).cast("bigint").alias("stream_id"), F.lit(-1).cast("bigint").alias("chunk_id"), F.lit("awaiting_asr").alias("phase"), F.lit(-1).cast("bigint").alias("o_orderkey"), moment(F.lit(1 << 28)).alias("at"))
    made = rows.select("stream_id", "chunk_id", phase.alias("phase"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"), moment(F.col("chunk_id")).alias("at"))
    named = F.col("chunk_id") + F.when(F.col("o_orderkey") % 50 == 0, 100_000).otherwise(0)
    answers = rows.select("stream_id", named.alias("chunk_id"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"), moment(F.col("chunk_id") + F.col("o_orderkey") % 300).alias("at"))
    at = shared_folder(spark, "answers")
    sides = {"chunks": made.unionByName(end).drop("o_orderkey"), "answers": answers.unionByName(end.drop("phase"))}
    for name, side in sides.items():
        side.repartitionByRange(3, "at").write.parquet(f"{at}/{name}")
    streams = [spark.readStream.schema(side.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/{name}") for name, side in sides.items()]
    met = answer_stream(*streams, "awaiting_asr", "30 days")
    query = met.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    for folder in ("chunks", "answers", "state"):
        remove_folder(spark, f"{at}/{folder}")
    return spark.read.schema(met.schema).parquet(f"{at}/out").where("stream_id >= 0").select("stream_id", "chunk_id", "o_orderkey", "status")


R7_SQL = f"""WITH {CHUNKS_SQL} SELECT stream_id, chunk_id + CASE WHEN o_orderkey % 50 = 0 THEN 100000 ELSE 0 END AS chunk_id, o_orderkey,
  CASE WHEN o_orderkey % 50 <> 0 AND o_orderstatus = 'F' THEN 'accepted' ELSE 'unknown_chunk' END AS status FROM chunks"""
T8_SQL = f"""WITH {CHUNKS_SQL}, nth AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY chunk_id) - 1 AS n FROM chunks WHERE o_orderstatus <> 'P')
SELECT stream_id, chunk_id, o_orderkey FROM nth WHERE n = chunk_id"""

QUERIES = {
    "t2_fan_out": t2_fan_out, "r7_streamed_answers": r7_streamed_answers,
    "r4_marker_outcomes": r4_marker_outcomes, "t9_marker_cut": t9_marker_cut, "t5_stream_packets": t5_stream_packets, "t8_stream_in_order": t8_stream_in_order,
    "w1_cut": w1_cut, "t3_stream_cut": t3_stream_cut, "r2_span_outcomes": r2_span_outcomes, "w8_hard_split": w8_hard_split, "r1_append_packets": r1_append_packets, "p1_sample_to_pts": p1_sample_to_pts,
    "p5_would_accept": p5_would_accept, "o4_interval_union": o4_interval_union, "j9_interval_clip": j9_interval_clip, "j7_speech_frames": j7_speech_frames, "w5_frame_runs": w5_frame_runs,
}
ORACLE_SQL = {
    "t2_fan_out": T2_SQL, "r7_streamed_answers": R7_SQL,
    "r4_marker_outcomes": R4_SQL, "t9_marker_cut": T9_SQL, "t5_stream_packets": R1_SQL, "t8_stream_in_order": T8_SQL,
    "t3_stream_cut": T3_SQL,
    "w1_cut": W1_SQL, "r2_span_outcomes": R2_SQL, "w8_hard_split": W8_SQL, "r1_append_packets": R1_SQL, "p1_sample_to_pts": P1_SQL,
    "p5_would_accept": P5_SQL, "o4_interval_union": O4_SQL, "j9_interval_clip": J9_SQL, "j7_speech_frames": J7_SQL, "w5_frame_runs": W5_SQL,
}
