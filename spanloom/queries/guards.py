"""Smaller operators: pre-checks, slices, state totals, decisions, vocabulary lookups and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import clock, display
from spanloom.operators import cut, ingest, intervals, registry, tokens, validate
from spanloom.queries.fixtures import CHUNKS_SQL, FRAMES_SQL, SPANS_SQL, chunks, documents, frames, spans, table
from spanloom.sources import vocabulary


def r3_packet_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four spans of a stream at a time as a packet, against its first start as watermark and audio up to a day after its last start."""
    rows = spans(spark, sf_dir).withColumn("packet_id", F.call_function("div", F.col("seq") - 1, F.lit(4).cast("bigint"))).withColumn("start_seq", F.col("seq"))
    w = Window.partitionBy("stream_id", "packet_id")
    rows = rows.withColumn("watermark", F.min("start_sample").over(w)).withColumn("high_water", F.max("start_sample").over(w) + 24 * 3600 * 16_000)
    return cut.precheck_packets(rows, F.col("packet_id"))


R3_SQL = f"""WITH {SPANS_SQL}, p AS (SELECT *, (seq - 1) // 4 AS packet_id FROM spans),
b AS (SELECT *, min(start_sample) OVER (PARTITION BY stream_id, packet_id) AS wm, max(start_sample) OVER (PARTITION BY stream_id, packet_id) + 1382400000 AS hw,
  max(end_sample) OVER (PARTITION BY stream_id, packet_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT stream_id, packet_id, bool_and(end_sample > start_sample AND start_sample >= greatest(wm, coalesce(before, wm)) AND end_sample <= hw) AS accepted, count(*) AS n_spans FROM b GROUP BY stream_id, packet_id"""


def r10_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundled vocabulary beside its special tokens, and how often the documents hold each of its characters, small letters as capitals."""
    words = vocabulary.bundled(spark)
    special = tokens.special_tokens(words)
    chars = documents(spark, sf_dir).select(F.explode(F.split(tokens.ascii_upper(F.col("text")), "")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counted = words.join(chars, "token", "left").select("token", "id", F.coalesce("n", F.lit(0)).alias("n"))
    return counted.withColumns({c: special.select(c).scalar() for c in special.columns})


_VOCAB = ", ".join("('" + t.replace("'", "''") + f"', {i})" for t, i in vocabulary.BUNDLED)
R10_SQL = f"""WITH chars AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '')) AS ch FROM documents) GROUP BY ch)
SELECT token, id, coalesce(n, 0) AS n, 0 AS blank_id, 3 AS unk_id, 4 AS delimiter_id, true AS uppercase_only FROM (VALUES {_VOCAB}) v(token, id) LEFT JOIN chars ON ch = token"""


def j4_character_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each character of the conversations is in the vocabulary, upper-cased in ASCII alone, and which aren't."""
    chars = table(spark, sf_dir, "conversations").select(F.explode(F.filter(F.split("text", ""), lambda c: F.length(c) > 0)).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    known = vocabulary.bundled(spark).where(F.length("token") == 1)
    return chars.withColumn("projected", tokens.ascii_upper(F.col("ch"))).join(F.broadcast(known), F.col("projected") == F.col("token"), "left").select("ch", "n", "projected", "id")


J4_SQL = f"""WITH v(token, id) AS (VALUES {_VOCAB}), c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM conversations) WHERE len(ch) > 0 GROUP BY ch),
p AS (SELECT *, translate(ch, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS projected FROM c)
SELECT ch, n, projected, id FROM p LEFT JOIN v ON len(token) = 1 AND projected = token"""


def p3_audio_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of vectors taken as buffers of which eight samples are trimmed, with their output times."""
    rows = frames(spark, sf_dir).withColumn("start", F.col("frame") % 20 + 8).withColumn("end", F.col("frame") % 20 + 8 + F.col("clip_id") * 3)
    audio = ingest.chunk_audio(F.slice("logits", 9, 56), F.col("start"), F.col("end"), F.lit(8))
    total = F.aggregate(audio, F.lit(0.0), lambda a, x: a + x.cast("double"))
    times = clock.saturating_range(F.col("start").cast("bigint"), F.col("end").cast("bigint"), F.lit(90).cast("bigint"), F.lit(1), F.lit(48_000))
    expected = clock.next_expected_pts(F.col("end"), F.lit(90).cast("bigint"), F.lit(1), F.lit(48_000))
    return rows.select("clip_id", "frame", F.size(audio).alias("n"), F.round(total, 5).alias("total"), times["start_pts"].alias("start_pts"), times["end_pts"].alias("end_pts"), expected.alias("next_pts"))


P3_SQL = f"""WITH {FRAMES_SQL}, s AS (SELECT *, frame % 20 + 8 AS b, frame % 20 + 8 + clip_id * 3 AS e FROM frames)
SELECT clip_id, frame, len(logits[b + 1:e]) AS n, round(coalesce(list_sum(list_transform(logits[b + 1:e], lambda x: CAST(x AS DOUBLE))), 0), 5) AS total, 90 + b * 3 AS start_pts, 90 + e * 3 AS end_pts, 90 + e * 3 AS next_pts FROM s"""


def p6_buffer_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("stream_id"), F.col("o_orderkey").alias("live_samples"), (F.col("o_orderstatus") == "P").cast("int").alias("in_flight"), F.when(F.col("o_custkey") % 97 < 20, 0).otherwise((F.col("o_orderstatus") == "O").cast("int")).alias("queued"))
    return ingest.buffered(rows)


P6_SQL = """SELECT o_custkey % 97 AS stream_id, CAST(sum(o_orderkey) AS BIGINT) AS buffered_samples, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS in_flight,
  sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END + CASE WHEN o_custkey % 97 < 20 THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) = 0 AS is_idle FROM orders GROUP BY 1"""


def p20_owner_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the aligner that prepared a chunk finishes it, and whether its decisions are in its language."""
    rows = chunks(spark, sf_dir).withColumn("aligner_id", F.concat(F.lit("a"), F.col("o_orderkey") % 3))
    return registry.owned(rows, "a1").select("stream_id", "chunk_id", F.col("status").alias("owner"), F.coalesce(validate.decision_language(F.lit("1"), F.col("language")), F.lit("none")).alias("language"))


P20_SQL = f"""WITH {CHUNKS_SQL} SELECT stream_id, chunk_id, CASE WHEN o_orderkey % 3 = 1 THEN 'ok' ELSE 'wrong_owner' END AS owner, CASE WHEN language = '1' THEN 'ok' ELSE 'decision_language' END AS language FROM chunks"""


def p21_run_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as runs in the language of their role, with decisions for none, for all, for all with a wrong last one, or for all but the last."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chunk_id"), (F.row_number().over(order) - 1).alias("run"), F.col("role").alias("language"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    last, kind = F.col("run") == F.col("n") - 1, F.col("chunk_id") % 4
    decided = rows.where((kind != 0) & ~((kind == 3) & last)).withColumn("language", F.when((kind == 2) & last, "x").otherwise(F.col("language")))
    return validate.decisions(rows.select("chunk_id").distinct().withColumn("language", F.lit("en")), rows, decided)


P21_SQL = """WITH s AS (SELECT conv_id AS chunk_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT chunk_id, CASE WHEN chunk_id % 4 = 2 THEN 'decision_language' WHEN chunk_id % 4 = 3 AND n > 1 THEN 'decision_shape' ELSE 'ok' END AS status FROM s"""


def p22_decision_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line statuses of an order as its events, against decisions that lack the last line of every fifth order and differ in every seventh."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    events = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(order) - 1).alias("event"), F.col("l_linestatus").alias("kind"), F.col("l_returnflag").alias("ch"), F.col("l_linenumber").alias("char_index"), F.col("l_linenumber").alias("word_index"))
    last = F.max("event").over(Window.partitionBy("l_orderkey"))
    decided = events.withColumn("_last", last).where((F.col("l_orderkey") % 5 != 0) | (F.col("event") < F.col("_last"))).withColumn("kind", F.when(F.col("l_orderkey") % 7 == 0, "x").otherwise(F.col("kind"))).drop("_last")
    return tokens.match_decisions(events, decided, ["l_orderkey"])


P22_SQL = "SELECT l_orderkey, l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 0 AS matches FROM lineitem GROUP BY l_orderkey"


def x5_speech_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 700).alias("w"), (F.col("o_custkey") / 3.0).alias("spf"))
    return rows.select("o_orderkey", intervals.speech_threshold(F.col("w"), F.col("spf")).alias("threshold"))


X5_SQL = """WITH r AS (SELECT o_orderkey, o_orderkey % 700 AS w, CAST(floor(o_custkey / 3.0::DOUBLE) AS BIGINT) AS f FROM orders)
SELECT o_orderkey, CASE WHEN w > 0 THEN least(greatest(1, w // 2 + w % 2), greatest(1, f // 2 + f % 2)) ELSE greatest(1, f // 2 + f % 2) END AS threshold FROM r"""


def s13_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of every policy for the symbols of the documents, under the language asked for."""
    chars = documents(spark, sf_dir).select(F.explode(F.filter(F.split("text", ""), lambda c: F.length(c) > 0)).alias("ch"), "lang").groupBy("ch", "lang").agg(F.count("*").alias("n"))
    kind = F.when(F.col("ch") == ".", "internal_punct").otherwise("symbol")
    rows = tokens.restamp(chars.withColumn("kind", kind), F.col("lang")).drop("lang")
    return rows.select("ch", "language", "n", "kind", *(tokens.decide(F.col("kind"), F.col("ch"), p).alias(p) for p in ("default", "wildcard_all", "fail_all")))


S13_SQL = r"""WITH c AS (SELECT ch, lang AS language, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch, lang FROM documents) WHERE len(ch) > 0 GROUP BY ch, lang)
SELECT ch, language, n, CASE WHEN ch = '.' THEN 'internal_punct' ELSE 'symbol' END AS kind, CASE WHEN ch = '.' OR regexp_matches(ch, '^[\p{L}\p{N}''\x{2019}]$') THEN 'wildcard' ELSE 'fail_closed' END AS "default",
  'wildcard' AS wildcard_all, 'fail_closed' AS fail_all FROM c"""


def s16_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of spans as text."""
    codes = ("vad_regression", "after_eof", "unknown_chunk", "odd", "vad_ahead_of_audio", "semantic_oov")
    code = F.element_at(F.array(*(F.lit(c) for c in codes)), (F.col("seq") % len(codes) + 1).cast("int"))
    fields = {"kind": F.lit("VadSegment"), "advance": F.col("start_sample") - F.col("end_sample"), "vad_end": F.col("end_sample"), "buffered": F.col("start_sample"), "chunk_id": F.when(F.col("seq") % 12 != 2, F.col("seq")), "language": F.lit("en")}
    return spans(spark, sf_dir).select("stream_id", "seq", display.message(code, fields).alias("message"))


S16_SQL = f"""WITH {SPANS_SQL} SELECT stream_id, seq, CASE seq % 6 WHEN 0 THEN 'PTS regression on VadSegment: advance = ' || (start_sample - end_sample) WHEN 1 THEN 'operation rejected after handle_eof'
  WHEN 2 THEN 'unknown or already-resolved chunk_id ' || CASE WHEN seq % 12 <> 2 THEN CAST(seq AS VARCHAR) ELSE '?' END WHEN 3 THEN 'odd'
  WHEN 4 THEN 'VAD segment end ' || end_sample || ' is past buffered samples ' || start_sample ELSE 'alignment semantic-OOV: language=en message=?' END AS message FROM spans"""

QUERIES = {
    "r3_packet_precheck": r3_packet_precheck, "r10_vocabulary": r10_vocabulary, "j4_character_lookup": j4_character_lookup, "p3_audio_slices": p3_audio_slices, "p6_buffer_state": p6_buffer_state,
    "p20_owner_checks": p20_owner_checks, "p21_run_decisions": p21_run_decisions, "p22_decision_match": p22_decision_match, "x5_speech_thresholds": x5_speech_thresholds, "s13_policies": s13_policies, "s16_messages": s16_messages,
}
ORACLE_SQL = {
    "r3_packet_precheck": R3_SQL, "r10_vocabulary": R10_SQL, "j4_character_lookup": J4_SQL, "p3_audio_slices": P3_SQL, "p6_buffer_state": P6_SQL,
    "p20_owner_checks": P20_SQL, "p21_run_decisions": P21_SQL, "p22_decision_match": P22_SQL, "x5_speech_thresholds": X5_SQL, "s13_policies": S13_SQL, "s16_messages": S16_SQL,
}
