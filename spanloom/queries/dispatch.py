"""Queries over chunks: decoding attempts, the language lock, admission, emission, the aligner registry and recogniser statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators import asr, compose, dispatch, registry, runs, validate
from spanloom.operators.dispatch import Ladder
from spanloom.queries.fixtures import CHUNKS_SQL, chunks, documents, table

LADDER = Ladder()


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as attempts; all columns break ties, as the key isn't unique."""
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    order = Window.partitionBy("l_orderkey").orderBy(*columns)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"),
        (F.row_number().over(order) - 1).alias("attempt"),
        F.when(F.col("l_partkey") % 23 == 0, 0).otherwise(F.col("l_linenumber")).alias("segments"),
        (F.col("l_quantity") / -20).alias("avg_logprob"),
        (F.col("l_suppkey") % 10 / 10).alias("no_speech_prob"),
        (F.col("l_tax") * 40).alias("compression_ratio"),
        F.concat("l_returnflag", "l_linestatus").alias("text"),
        F.lit("en").alias("language"),
    )


def w9_decode_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dispatch.first_accepted(_attempts(spark, sf_dir), LADDER, ["chunk_id"])
    return found.withColumn("temperature", F.round("temperature", 4))


W9_SQL = """WITH attempts AS (
  SELECT l_orderkey AS chunk_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS attempt,
    CASE WHEN l_partkey % 23 = 0 THEN 0 ELSE l_linenumber END AS segments, l_quantity / -20 AS lp, (l_suppkey % 10)::DOUBLE / 10 AS nsp, l_tax * 40 AS cr, l_returnflag || l_linestatus AS text FROM lineitem
), judged AS (
  SELECT *, CASE WHEN segments = 0 THEN 'accept_empty' WHEN nsp > 0.6::DOUBLE AND lp < -1 THEN 'accept_empty' WHEN lp >= -1 AND cr <= 2.4::DOUBLE THEN 'accept' END AS verdict FROM attempts WHERE attempt < 6
), firsts AS (SELECT chunk_id, min(attempt) FILTER (verdict IS NOT NULL) AS attempt FROM judged GROUP BY chunk_id)
SELECT f.chunk_id, coalesce(j.verdict, 'all_temperatures_exhausted') AS status, f.attempt, round(f.attempt * 0.2::DOUBLE, 4) AS temperature, CASE WHEN j.verdict = 'accept' THEN j.text WHEN j.verdict IS NOT NULL THEN '' END AS text
FROM firsts f LEFT JOIN judged j ON j.chunk_id = f.chunk_id AND j.attempt = f.attempt"""


def g1_language_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lock after seven observations, over the chunks that are resolved: pending orders aren't."""
    return dispatch.language_lock(chunks(spark, sf_dir).where("o_orderstatus <> 'P'"), 7)


G1_SQL = f"""WITH {CHUNKS_SQL}, nth AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY chunk_id) - 1 AS n FROM chunks WHERE o_orderstatus <> 'P'
), obs AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY chunk_id) AS o FROM nth WHERE n = chunk_id AND language IS NOT NULL
), counted AS (SELECT stream_id, language, count(*) AS c, min(o) AS f FROM obs WHERE o <= 7 GROUP BY stream_id, language
), ranked AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY c DESC, f) AS r, sum(c) OVER (PARTITION BY stream_id) AS total FROM counted)
SELECT stream_id, CASE WHEN total = 7 THEN language END AS language, CAST(total AS BIGINT) AS observed FROM ranked WHERE r = 1"""


def w10_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be emitted of every stream: chunks up to the first pending order."""
    return dispatch.in_order(chunks(spark, sf_dir).where("o_orderstatus <> 'P'")).select("stream_id", "chunk_id", "emit_index", "o_orderkey")


W10_SQL = f"""WITH {CHUNKS_SQL}, nth AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY chunk_id) - 1 AS emit_index FROM chunks WHERE o_orderstatus <> 'P')
SELECT stream_id, chunk_id, emit_index, o_orderkey FROM nth WHERE emit_index = chunk_id"""


def r7_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by chunk: one for every order and one for a chunk that isn't there, against chunks in different phases."""
    rows = chunks(spark, sf_dir)
    phased = rows.withColumn("phase", F.when(F.col("o_orderstatus") == "F", "awaiting_asr").when(F.col("o_orderstatus") == "O", "awaiting_alignment").otherwise("ready"))
    answers = rows.select("stream_id", (F.col("chunk_id") + F.when(F.col("o_orderkey") % 50 == 0, 100_000).otherwise(0)).alias("chunk_id"), "o_orderkey")
    return dispatch.answer_chunks(phased, answers, "awaiting_asr").select("stream_id", "chunk_id", "o_orderkey", "status")


R7_SQL = f"""WITH {CHUNKS_SQL} SELECT stream_id, chunk_id + CASE WHEN o_orderkey % 50 = 0 THEN 100000 ELSE 0 END AS chunk_id, o_orderkey,
  CASE WHEN o_orderkey % 50 <> 0 AND o_orderstatus = 'F' THEN 'accepted' ELSE 'unknown_chunk' END AS status FROM chunks"""


def w11_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each stream cut and answered in turn, with at most three in flight and a lock after two observations."""
    rows = chunks(spark, sf_dir)
    cuts = rows.select("stream_id", (F.col("chunk_id") * 10).alias("seq"), F.lit("cut").alias("kind"), "chunk_id", "language")
    results = rows.select("stream_id", (F.col("chunk_id") * 10 + 25 + F.col("chunk_id") % 3 * 12).alias("seq"), F.lit("result").alias("kind"), "chunk_id", "language")
    return dispatch.admit(cuts.unionByName(results), max_in_flight=3, observations=2)


#: The queue is the range from the first chunk that hasn't started to the last that was cut; of two observations the first is the mode.
W11_SQL = f"""WITH RECURSIVE {CHUNKS_SQL}, events AS (
  SELECT stream_id, chunk_id * 10 AS seq, 'cut' AS kind, chunk_id, language FROM chunks UNION ALL SELECT stream_id, chunk_id * 10 + 25 + chunk_id % 3 * 12, 'result', chunk_id, language FROM chunks
), numbered AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS k FROM events
), fold AS (
  SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS seq, 'none' AS kind, CAST(NULL AS BIGINT) AS chunk_id, CAST(NULL AS VARCHAR) AS language, false AS hit, CAST(0 AS BIGINT) AS q0, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS c,
    CAST([] AS BIGINT[]) AS running, CAST([] AS STRUCT(id BIGINT, lang VARCHAR)[]) AS known, CAST(0 AS BIGINT) AS cur, CAST([] AS VARCHAR[]) AS obs FROM events
  UNION ALL
  SELECT stream_id, k, seq, kind, chunk_id, language, hit, q, q + p, c, running || range(q, q + p), known, cur, obs FROM (
    SELECT *, CASE WHEN kind = 'cut' OR hit THEN greatest(0, least(c - q, 3 - len(running), CASE WHEN len(obs) >= 2 THEN c - q ELSE cur + 2 - len(obs) - q END)) ELSE 0 END AS p FROM (
      SELECT * EXCLUDE (before, obs), (obs || list_filter(list_transform(range(before, cur), lambda x: list_filter(known, lambda y: y.id = x)[1].lang), lambda x: x IS NOT NULL))[1:2] AS obs FROM (
        SELECT * EXCLUDE (cur), cur AS before, CASE WHEN hit AND len(obs) < 2 THEN list_filter(range(cur, cur + len(known) + 1), lambda x: NOT list_contains(list_transform(known, lambda y: y.id), x))[1] ELSE cur END AS cur FROM (
          SELECT e.stream_id, e.k, e.seq, e.kind, e.chunk_id, e.language, e.kind = 'result' AND list_contains(f.running, e.chunk_id) AS hit, f.q, f.c + CASE WHEN e.kind = 'cut' THEN 1 ELSE 0 END AS c,
            CASE WHEN e.kind = 'result' THEN list_filter(f.running, lambda x: x <> e.chunk_id) ELSE f.running END AS running,
            CASE WHEN e.kind = 'result' AND list_contains(f.running, e.chunk_id) AND len(f.obs) < 2 THEN list_append(f.known, {{'id': e.chunk_id, 'lang': e.language}}) ELSE f.known END AS known, f.cur, f.obs
          FROM fold f JOIN numbered e ON e.stream_id = f.stream_id AND e.k = f.k + 1)))))
SELECT stream_id, seq, CASE WHEN hit THEN 'resolved' ELSE 'unknown_chunk' END AS action, chunk_id, CASE WHEN hit THEN language END AS language FROM fold WHERE kind = 'result'
UNION ALL SELECT stream_id, seq, 'start', unnest(range(q0, q)), CASE WHEN len(obs) >= 2 THEN obs[1] END FROM fold WHERE kind <> 'none'"""


def j1_registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations as languages, found in a registry of even nations with a fallback."""
    entries = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("key"), F.concat(F.lit("a"), F.col("n_nationkey")).alias("aligner_id"), F.col("n_name").alias("language"), F.col("n_nationkey").alias("seq"))
    twice = entries.unionByName(entries.where("seq % 4 = 0").withColumn("aligner_id", F.concat("aligner_id", F.lit("b"))).withColumn("seq", F.col("seq") + 100))
    wide = twice.unionByName(spark.createDataFrame([("any", "fallback", "mul", 0)], "key string, aligner_id string, language string, seq int"))
    asked = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("language"))
    with_any = registry.lookup(asked, registry.register(wide))
    without = registry.lookup(asked, registry.register(twice), policy="error").select("s_suppkey", F.col("status").alias("strict_status"))
    return with_any.join(without, "s_suppkey")


J1_SQL = """SELECT s_suppkey, n_name AS language, CASE WHEN n_nationkey % 2 = 1 THEN 'fallback' WHEN n_nationkey % 4 = 0 THEN 'a' || n_nationkey || 'b' ELSE 'a' || n_nationkey END AS aligner_id,
  CASE WHEN n_nationkey % 2 = 1 THEN 'any' ELSE 'exact' END AS matched, 'ok' AS status, CASE WHEN n_nationkey % 2 = 1 THEN 'language_unsupported' ELSE 'ok' END AS strict_status
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def g4_segment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of means of discounts by order and line, and the mean of taxes."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("segment"), (-F.col("l_discount")).alias("logprob"), F.col("l_tax").alias("no_speech_prob"))
    found = asr.segment_statistics(rows, ["chunk_id"]).join(asr.no_speech(rows, ["chunk_id"]), "chunk_id")
    return found.select("chunk_id", "segments", (F.round("avg_logprob", 6) + 0.0).alias("avg_logprob"), F.round("no_speech_prob", 6).alias("no_speech_prob"))


G4_SQL = """WITH per AS (SELECT l_orderkey AS chunk_id, l_linenumber, avg(-l_discount) AS m FROM lineitem GROUP BY 1, 2), flat AS (SELECT l_orderkey AS chunk_id, avg(l_tax) AS n FROM lineitem GROUP BY 1)
SELECT p.chunk_id, count(*) AS segments, round(avg(m), 6) + 0.0 AS avg_logprob, round(any_value(n), 6) AS no_speech_prob FROM per p JOIN flat f ON p.chunk_id = f.chunk_id GROUP BY p.chunk_id"""


def g7_joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asr.joined_text(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


G7_SQL = "SELECT conv_id, trim(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id"


def g6_compression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio of every document's bytes to its deflated bytes, and whether it passes the gate."""
    rows = asr.compression_ratio(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.round(F.col("compression_ratio").cast("double"), 5).alias("ratio"), (F.col("compression_ratio") <= LADDER.compression).alias("passes"))


def g8_token_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token times by run: lines of an order as tokens of two bytes against its runs of five bytes."""
    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    toks = rows.select("l_orderkey", (F.row_number().over(order) * 2 - 2).cast("bigint").alias("byte_offset"), F.lit(2).cast("bigint").alias("byte_len"), F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey")).alias("t_dtw_cs"))
    spans = rows.select("l_orderkey").distinct().withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumns({"byte_start": (F.col("run") * 4).cast("bigint"), "byte_end": (F.col("run") * 4 + F.when(F.col("l_orderkey") % 2 == 0, 4).otherwise(5)).cast("bigint")})
    return runs.run_times(spans, toks, ["l_orderkey"]).select("l_orderkey", "run", "lo_dtw", "hi_dtw", "all_timed")


G8_SQL = """WITH toks AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) * 2 - 2 AS b, CASE WHEN l_partkey % 9 <> 0 THEN l_partkey END AS t FROM lineitem),
spans AS (SELECT l_orderkey, unnest(range(3)) AS run FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
bounds AS (SELECT *, run * 4 AS s, run * 4 + CASE WHEN l_orderkey % 2 = 0 THEN 4 ELSE 5 END AS e FROM spans),
met AS (SELECT x.l_orderkey, x.run, t.t, t.b >= x.s AND t.b + 2 <= x.e AS inside, NOT (t.b >= x.s AND t.b + 2 <= x.e) AND least(t.b + 2, x.e) > greatest(t.b, x.s) AS crosses FROM bounds x LEFT JOIN toks t ON t.l_orderkey = x.l_orderkey)
SELECT l_orderkey, CAST(run AS INTEGER) AS run, min(t) FILTER (inside) AS lo_dtw, max(t) FILTER (inside) AS hi_dtw, coalesce(bool_or(inside), false) AND NOT coalesce(bool_or(crosses), false) AND bool_and(NOT coalesce(inside, false) OR t IS NOT NULL) AS all_timed FROM met GROUP BY l_orderkey, run"""


def o1_ordered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as words, by time and then as given."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("start_pts"), F.col("l_tax").alias("end_pts"), F.row_number().over(order).alias("emitted"))
    return compose.ordered_words(rows, ["l_orderkey"])


O1_SQL = """WITH rows AS (SELECT l_orderkey, l_quantity AS start_pts, l_tax AS end_pts, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS emitted FROM lineitem)
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY start_pts, end_pts, emitted) - 1 AS position FROM rows"""


def o7_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as transcripts and pending ones as errors, in one table."""
    rows = chunks(spark, sf_dir)
    good = rows.where("o_orderstatus <> 'P'").select("stream_id", "chunk_id", "language")
    bad = rows.where("o_orderstatus = 'P'").select("stream_id", "chunk_id", F.lit("work_failed").alias("code"), validate.recoverable(F.lit("work_failed")).alias("recoverable"))
    return compose.events(good, bad)


O7_SQL = f"""WITH {CHUNKS_SQL} SELECT stream_id, chunk_id, CASE WHEN o_orderstatus <> 'P' THEN language END AS language, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'transcript' END AS kind,
  CASE WHEN o_orderstatus = 'P' THEN 'work_failed' END AS code, CASE WHEN o_orderstatus = 'P' THEN false END AS recoverable FROM chunks"""


def r14_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a stream by the source of their bounds."""
    source = F.element_at(F.array(F.lit("dtw"), F.lit("segment"), F.lit("wholeclip")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return runs.telemetry(chunks(spark, sf_dir).select("stream_id", source.alias("bounds_source"), (F.col("o_orderstatus") == "F").alias("aligned")), ["stream_id"])


R14_SQL = f"""WITH {CHUNKS_SQL} SELECT stream_id, count(*) FILTER (o_orderkey % 3 = 0) AS n_dtw, count(*) FILTER (o_orderkey % 3 = 1) AS n_segment, count(*) FILTER (o_orderkey % 3 = 2) AS n_wholeclip, count(*) FILTER (o_orderstatus <> 'F') AS n_unaligned FROM chunks GROUP BY stream_id"""


def p19_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's language by override, lock and default."""
    rows = chunks(spark, sf_dir).select("stream_id", "chunk_id", "language", (F.col("o_orderkey") % 4 == 0).alias("set"), F.when(F.col("stream_id") % 2 == 0, "de").alias("locked"))
    return rows.select("stream_id", "chunk_id", asr.effective(F.lit("auto"), F.col("locked"), F.col("language"), F.col("set")).alias("language"))


P19_SQL = f"""WITH {CHUNKS_SQL} SELECT stream_id, chunk_id, CASE WHEN o_orderkey % 4 = 0 THEN language WHEN stream_id % 2 = 0 THEN 'de' ELSE 'auto' END AS language FROM chunks"""


def run_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a clip that runs with given bounds cover."""
    rows = chunks(spark, sf_dir).select("stream_id", "chunk_id", (F.col("o_orderkey") % 4000 - 200).alias("t0"), (F.col("o_orderkey") * 7 % 5000).alias("t1"), F.when(F.col("o_orderkey") % 6 == 0, "wholeclip").otherwise("segment").alias("source"))
    return rows.select("stream_id", "chunk_id", runs.slice_bounds(F.col("t0"), F.col("t1"), F.col("source"), F.lit(40_000).cast("bigint")).alias("s")).select("stream_id", "chunk_id", "s.lo", "s.hi")


RUN_SLICES_SQL = f"""WITH {CHUNKS_SQL}, r AS (SELECT stream_id, chunk_id, o_orderkey % 4000 - 200 AS t0, o_orderkey * 7 % 5000 AS t1, o_orderkey % 6 = 0 AS w FROM chunks)
SELECT stream_id, chunk_id, CASE WHEN w THEN 0 WHEN t0 < 0 OR t1 <= t0 OR least(t0 * 16, 40000) >= least(t1 * 16, 40000) THEN 0 ELSE least(t0 * 16, 40000) END AS lo,
  CASE WHEN w THEN 40000 WHEN t0 < 0 OR t1 <= t0 OR least(t0 * 16, 40000) >= least(t1 * 16, 40000) THEN 0 ELSE least(t1 * 16, 40000) END AS hi FROM r"""

QUERIES = {
    "w9_decode_ladder": w9_decode_ladder, "g1_language_lock": g1_language_lock, "w10_in_order": w10_in_order, "r7_answers": r7_answers, "w11_admission": w11_admission, "j1_registry_lookup": j1_registry_lookup,
    "g4_segment_statistics": g4_segment_statistics, "g7_joined_text": g7_joined_text, "g6_compression_gate": g6_compression_gate, "g8_token_times": g8_token_times, "o1_ordered_words": o1_ordered_words,
    "o7_events": o7_events, "r14_telemetry": r14_telemetry, "p19_overrides": p19_overrides, "run_slices": run_slices,
}
ORACLE_SQL = {
    "w11_admission": W11_SQL, "w9_decode_ladder": W9_SQL, "g1_language_lock": G1_SQL, "w10_in_order": W10_SQL, "r7_answers": R7_SQL, "j1_registry_lookup": J1_SQL, "g4_segment_statistics": G4_SQL, "g7_joined_text": G7_SQL,
    "g8_token_times": G8_SQL, "o1_ordered_words": O1_SQL, "o7_events": O7_SQL, "r14_telemetry": R14_SQL, "p19_overrides": P19_SQL, "run_slices": RUN_SLICES_SQL,
}
