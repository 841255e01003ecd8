"""Log-probability, alignment and word composition queries over clips of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import numeric
from spanloom.operators import compose, ctc, intervals, validate
from spanloom.queries.fixtures import BLANK, FRAMES_SQL, LOG_PROBS_SQL, TOKENS, WORD_IDX, clip_tokens, frames, table


def _log_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("clip_id", "frame", numeric.log_softmax(F.col("logits")).alias("lp"))


def x1_log_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _log_probs(spark, sf_dir).select("clip_id", "frame", F.posexplode("lp").alias("vocab", "lp"))
    return cells.withColumn("lp", F.round(F.col("lp").cast("double"), 4) + 0.0)


X1_SQL = f"""WITH {LOG_PROBS_SQL}, cells AS (SELECT clip_id, frame, lp, unnest(range(len(lp))) AS vocab FROM lps)
SELECT clip_id, frame, vocab, round(CAST(lp[vocab + 1] AS DOUBLE), 4) + 0.0 AS lp FROM cells"""


def g16_frame_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a wildcard emits, and the log-sum-exp, of every frame."""
    rows = frames(spark, sf_dir)
    return rows.select("clip_id", "frame", F.round(numeric.best_nonblank(F.col("logits"), BLANK).cast("double"), 5).alias("best"), F.round(numeric.log_sum_exp(F.col("logits")), 5).alias("lse"))


G16_SQL = f"""WITH {LOG_PROBS_SQL} SELECT f.clip_id, f.frame, round(CAST(list_max(f.logits[2:]) AS DOUBLE), 5) AS best, round(s.top + s.rest, 5) AS lse
FROM frames f JOIN sums s ON f.clip_id = s.clip_id AND f.frame = s.frame"""


def p10_log_prob_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first bad cell of raw vectors read as log-probabilities, and the first sample over a bound made infinite."""
    rows = frames(spark, sf_dir).withColumn("bad", numeric.bad_log_prob(F.col("logits")))
    spoiled = F.transform("logits", lambda x: F.when(x > 0.3, F.lit(float("inf")).cast("float")).otherwise(x))
    return rows.select("clip_id", "frame", F.col("bad.vocab").alias("vocab"), F.col("bad.kind").alias("kind"), numeric.first_bad_sample(spoiled).cast("bigint").alias("sample"))


P10_SQL = f"""WITH {FRAMES_SQL}, found AS (
  SELECT *, list_position(list_transform(logits, lambda x: x > 0), true) AS hit, list_position(list_transform(logits, lambda x: CAST(x AS DOUBLE) > 0.3), true) AS hot FROM frames)
SELECT clip_id, frame, CASE WHEN hit > 0 THEN hit - 1 END AS vocab, CASE WHEN hit > 0 THEN 'positive' END AS kind, CASE WHEN hot > 0 THEN hot - 1 END AS sample FROM found"""


def g12_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of vectors after standardising, whole and over their middle half alone."""
    half = F.array(F.struct(F.lit(16).alias("start"), F.lit(48).alias("end")))
    rows = frames(spark, sf_dir).select("clip_id", "frame", numeric.standardize(F.col("logits")).alias("a"), intervals.standardize_masked(F.col("logits"), half).alias("b"))
    at = lambda c, i: F.round(F.get(c, F.lit(i)).cast("double"), 4) + 0.0
    return rows.select("clip_id", "frame", at("a", 0).alias("first"), at("a", 63).alias("last"), at("b", 0).alias("silent"), at("b", 20).alias("voiced"))


G12_SQL = f"""WITH {FRAMES_SQL}, x AS (SELECT clip_id, frame, list_transform(logits, lambda v: CAST(v AS DOUBLE)) AS v, list_transform(logits[17:48], lambda v: CAST(v AS DOUBLE)) AS m FROM frames
), s AS (SELECT *, list_avg(v) AS mu, list_var_pop(v) AS va, list_avg(m) AS mm, list_var_pop(m) AS vm FROM x)
SELECT clip_id, frame, round(CAST(CAST((v[1] - mu) / sqrt(va + 1e-7) AS FLOAT) AS DOUBLE), 4) + 0.0 AS first, round(CAST(CAST((v[64] - mu) / sqrt(va + 1e-7) AS FLOAT) AS DOUBLE), 4) + 0.0 AS last,
  0.0::DOUBLE AS silent, round(CAST(CAST((v[21] - mm) / sqrt(vm + 1e-7) AS FLOAT) AS DOUBLE), 4) + 0.0 AS voiced FROM s"""


def x2_trellis_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log_probs(spark, sf_dir)
    return ctc.end_scores(rows, clip_tokens(rows)).select("clip_id", F.round(F.col("end_score").cast("double"), 2).alias("end_score"))


_N = len(TOKENS)
_TOK_SQL = "[" + ", ".join(map(str, TOKENS)) + "]"
X2_SQL = f"""WITH RECURSIVE {LOG_PROBS_SQL}, sized AS (SELECT clip_id, max(frame) + 1 AS total FROM lps GROUP BY clip_id),
fold AS (
  SELECT clip_id, CAST(0 AS BIGINT) AS t, [CAST(0 AS FLOAT)] || list_transform(range({_N - 1}), lambda i: CAST('-inf' AS FLOAT)) AS acc FROM sized
  UNION ALL
  SELECT f.clip_id, f.t + 1,
    [CASE WHEN f.t + 1 > s.total - {_N} THEN CAST('inf' AS FLOAT) ELSE CAST(f.acc[1] + n.lp[{BLANK + 1}] AS FLOAT) END] ||
    list_transform(range(1, {_N}), lambda j: greatest(CAST(f.acc[j + 1] + l.lp[{BLANK + 1}] AS FLOAT),
      CAST(f.acc[j] + CASE WHEN {_TOK_SQL}[j + 1] = -1 THEN list_max(l.lp[2:]) ELSE l.lp[{_TOK_SQL}[j + 1] + 1] END AS FLOAT)))
  FROM fold f JOIN sized s ON s.clip_id = f.clip_id JOIN lps l ON l.clip_id = f.clip_id AND l.frame = f.t JOIN lps n ON n.clip_id = f.clip_id AND n.frame = f.t + 1
)
SELECT f.clip_id, round(CAST(f.acc[{_N}] AS DOUBLE), 2) AS end_score FROM fold f JOIN sized s ON s.clip_id = f.clip_id AND f.t = s.total - 1"""

#: The path of every clip: all beams stand at one frame, so the recursion is over frames, from the last one back.
_PATH_SQL = X2_SQL[: X2_SQL.rindex("SELECT f.clip_id, round")].rstrip() + f""", back AS (
  SELECT f.clip_id, f.t, [{{'j': CAST({_N - 1} AS BIGINT), 'path': [CAST({_N - 1} AS BIGINT)]}}] AS beams FROM fold f JOIN sized s ON s.clip_id = f.clip_id AND f.t = s.total - 1 WHERE isfinite(f.acc[{_N}])
  UNION ALL
  SELECT b.clip_id, b.t - 1, list_transform(list_sort(list_filter(flatten(list_transform(range(len(b.beams)), lambda k: [
      {{'neg': -f.acc[b.beams[k + 1].j + 1], 'idx': 2 * k, 'j': b.beams[k + 1].j, 'path': [b.beams[k + 1].j] || b.beams[k + 1].path}},
      {{'neg': -f.acc[b.beams[k + 1].j], 'idx': 2 * k + 1, 'j': b.beams[k + 1].j - 1, 'path': [b.beams[k + 1].j - 1] || b.beams[k + 1].path}}])),
      lambda c: c.j >= 0 AND coalesce(isfinite(c.neg), false)))[1:2], lambda c: {{'j': c.j, 'path': c.path}})
  FROM back b JOIN fold f ON f.clip_id = b.clip_id AND f.t = b.t - 1 WHERE b.t > 0 AND len(b.beams) > 0 AND b.beams[1].j > 0
), won AS (
  SELECT clip_id, t, beams[1].path AS path FROM back WHERE len(beams) > 0 AND beams[1].j = 0
), steps AS (
  SELECT w.clip_id, l.frame, CASE WHEN l.frame < w.t THEN 0 ELSE w.path[l.frame - w.t + 1] END AS j, CASE WHEN l.frame >= w.t THEN w.path[l.frame - w.t + 2] END AS next_j, l.lp FROM won w JOIN lps l ON l.clip_id = w.clip_id
), path AS (
  SELECT clip_id, frame, j AS token_index, CAST(exp(CASE WHEN next_j IS NULL OR next_j = j THEN lp[{BLANK + 1}] WHEN {_TOK_SQL}[next_j + 1] = -1 THEN list_max(lp[2:]) ELSE lp[{_TOK_SQL}[next_j + 1] + 1] END::DOUBLE) AS FLOAT) AS score FROM steps
)
"""
X3_SQL = _PATH_SQL + """SELECT s.clip_id, CASE WHEN p.clip_id IS NULL THEN 'no_alignment_path' ELSE 'ok' END AS status, p.frame, p.token_index, round(CAST(p.score AS DOUBLE), 4) AS score
FROM sized s LEFT JOIN path p ON p.clip_id = s.clip_id"""
_WORD_SQL = "[" + ", ".join("NULL" if w is None else str(w) for w in WORD_IDX) + "]"
X4_SQL = _PATH_SQL.rstrip() + f""", m1 AS (SELECT *, CASE WHEN token_index = lag(token_index) OVER (PARTITION BY clip_id ORDER BY frame) THEN 0 ELSE 1 END AS c FROM path),
m2 AS (SELECT *, sum(c) OVER (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS segment FROM m1),
m3 AS (SELECT clip_id, segment, {_WORD_SQL}[token_index + 1] AS word_index, min(frame) AS b, max(frame) + 1 AS e, CAST(avg(CAST(score AS DOUBLE)) AS FLOAT) AS score FROM m2 GROUP BY clip_id, segment, token_index),
m4 AS (SELECT *, CASE WHEN word_index = lag(word_index) OVER (PARTITION BY clip_id ORDER BY segment) THEN 0 ELSE 1 END AS c FROM m3),
m5 AS (SELECT *, sum(c) OVER (PARTITION BY clip_id ORDER BY segment ROWS UNBOUNDED PRECEDING) AS word FROM m4)
SELECT clip_id, word_index, min(b) AS start_frame, max(e) AS end_frame, round(CAST(CAST(sum(CAST(score AS DOUBLE) * (e - b)) / sum(e - b) AS FLOAT) AS DOUBLE), 4) AS score
FROM m5 WHERE word_index IS NOT NULL GROUP BY clip_id, word, word_index"""


def x3_beam_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log_probs(spark, sf_dir)
    path = ctc.align(rows, clip_tokens(rows))
    return path.select("clip_id", "status", "frame", "token_index", F.round(F.col("score").cast("double"), 4).alias("score"))


def x4_align_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every clip, from trellis to merges."""
    rows = _log_probs(spark, sf_dir)
    segments = ctc.merge_repeats(ctc.align(rows, clip_tokens(rows)).where("status = 'ok'"))
    index = F.array(*(F.lit(w).cast("int") for w in WORD_IDX))
    words = ctc.merge_words(segments.withColumn("word_index", F.get(index, F.col("token_index"))))
    return words.select("clip_id", "word_index", "start_frame", "end_frame", F.round(F.col("score").cast("double"), 4).alias("score"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths like a beam's: a user's events in order, their types as tokens (sign-up: a separator)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    token = F.element_at(F.create_map(*(F.lit(x) for k, v in _TYPES.items() for x in (k, v))), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), (F.row_number().over(order) - 1).alias("frame"), token.alias("token_index"), (F.col("value") / 1000).cast("float").alias("score"))


_TYPES = {"view": 0, "click": 1, "error": 2, "purchase": 3, "signup": 4}
_PATHS_SQL = f"""paths AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _TYPES.items())} END AS token_index, CAST(value / 1000 AS FLOAT) AS score FROM events)"""
_SEGMENTS_SQL = f"""{_PATHS_SQL}, marked AS (SELECT *, CASE WHEN token_index = lag(token_index) OVER (PARTITION BY clip_id ORDER BY frame) THEN 0 ELSE 1 END AS c FROM paths),
numbered AS (SELECT *, sum(c) OVER (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS segment FROM marked),
segments AS (SELECT clip_id, segment, token_index, min(frame) AS start_frame, max(frame) + 1 AS end_frame, CAST(avg(CAST(score AS DOUBLE)) AS FLOAT) AS score FROM numbered GROUP BY clip_id, segment, token_index)"""


def g9_merge_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctc.merge_repeats(_paths(spark, sf_dir)).withColumn("score", F.round(F.col("score").cast("double"), 5))


G9_SQL = f"WITH {_SEGMENTS_SQL} SELECT clip_id, segment, token_index, start_frame, end_frame, round(CAST(score AS DOUBLE), 5) AS score FROM segments"


def g10_merge_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = ctc.merge_repeats(_paths(spark, sf_dir)).withColumn("word_index", F.when(F.col("token_index") != 4, F.call_function("div", F.col("token_index"), F.lit(2))))
    return ctc.merge_words(segments).withColumn("score", F.round(F.col("score").cast("double"), 5))


G10_SQL = f"""WITH {_SEGMENTS_SQL}, worded AS (SELECT *, CASE WHEN token_index <> 4 THEN token_index // 2 END AS word_index FROM segments),
changed AS (SELECT *, CASE WHEN word_index = lag(word_index) OVER (PARTITION BY clip_id ORDER BY segment) THEN 0 ELSE 1 END AS c2 FROM worded),
grouped AS (SELECT *, sum(c2) OVER (PARTITION BY clip_id ORDER BY segment ROWS UNBOUNDED PRECEDING) AS word FROM changed)
SELECT clip_id, word, word_index, min(start_frame) AS start_frame, max(end_frame) AS end_frame,
  round(CAST(CAST(sum(CAST(score AS DOUBLE) * (end_frame - start_frame)) / sum(end_frame - start_frame) AS FLOAT) AS DOUBLE), 5) AS score
FROM grouped WHERE word_index IS NOT NULL GROUP BY clip_id, word, word_index"""


def x7_compose_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events as words, cut by which events count as speech."""
    paths = _paths(spark, sf_dir)
    words = ctc.merge_repeats(paths).select("clip_id", F.col("segment").cast("int").alias("word_index"), "start_frame", "end_frame", "score")
    clips = paths.groupBy("clip_id").agg(F.count("*").alias("frames")).select("clip_id", "frames", F.lit(320.5).alias("spf"), F.lit(1000).cast("bigint").alias("first_sample"), (F.col("frames") * 300).alias("real_samples"), (F.col("frames") * 310).alias("chunk_end"))
    speech = paths.select("clip_id", "frame", (F.col("score") < 0.05).alias("is_speech"))
    surfaces = words.where("word_index % 9 <> 0").select("clip_id", "word_index", F.concat(F.lit("w"), F.col("word_index")).alias("text"))
    return compose.compose_words(words, clips, speech, surfaces).withColumn("score", F.round(F.col("score").cast("double"), 5))


X7_SQL = f"""WITH {_SEGMENTS_SQL}, clips AS (SELECT clip_id, count(*) AS frames FROM paths GROUP BY clip_id),
flags AS (SELECT s.clip_id, s.segment, p.frame, p.score < CAST(0.05 AS DOUBLE) AS speech FROM segments s JOIN paths p ON s.clip_id = p.clip_id AND p.frame >= s.start_frame AND p.frame < s.end_frame),
c1 AS (SELECT *, CASE WHEN speech = lag(speech) OVER (PARTITION BY clip_id, segment ORDER BY frame) THEN 0 ELSE 1 END AS c FROM flags),
c2 AS (SELECT *, sum(c) OVER (PARTITION BY clip_id, segment ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM c1),
c3 AS (SELECT clip_id, segment, run, count(*) AS n, bool_and(speech) AS speech FROM c2 GROUP BY clip_id, segment, run),
c4 AS (SELECT clip_id, segment, sum(CASE WHEN speech THEN n ELSE 0 END) AS voiced, CAST(sum(CASE WHEN speech THEN n ELSE 0 END)::DOUBLE / sum(n) AS FLOAT) AS coverage, max(CASE WHEN speech THEN 0 ELSE n END) AS longest FROM c3 GROUP BY clip_id, segment),
timed AS (SELECT s.*, c.frames, 1000 + CAST(round(s.start_frame * 320.5::DOUBLE) AS BIGINT) AS b, 1000 + CAST(round(s.end_frame * 320.5::DOUBLE) AS BIGINT) AS e, 1000 + c.frames * 300 AS real_end, c.frames * 310 AS chunk_end, v.voiced, v.coverage, v.longest
  FROM segments s JOIN clips c ON s.clip_id = c.clip_id JOIN c4 v ON v.clip_id = s.clip_id AND v.segment = s.segment)
SELECT clip_id, CAST(segment AS INTEGER) AS word_index, CASE WHEN segment % 9 <> 0 THEN 'w' || CAST(segment AS BIGINT) END AS text, b AS start_sample, least(e, real_end) AS end_sample, round(CAST(score AS DOUBLE), 5) AS score,
  CASE WHEN segment % 9 = 0 THEN 'unknown_word' WHEN voiced = 0 THEN 'no_speech' WHEN coverage < 0.5 THEN 'low_coverage' WHEN longest > 4 THEN 'long_silence'
    WHEN b >= chunk_end OR e <= b THEN 'overshoot' WHEN least(e, real_end) <= b THEN 'clamped_empty' END AS drop_reason FROM timed"""


def p12_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape guard over sizes taken from orders."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3000).alias("t"), (F.col("o_custkey") * 37 % 40_000).alias("n"))
    t, n = F.col("t"), F.col("n")
    ids = F.array((n % 40).cast("int"), F.lit(-1), (t % 5 - 2).cast("int"))
    return rows.select(
        "o_orderkey",
        validate.cell_budget(t, n).alias("cells"),
        validate.frame_budget(t * 1000).alias("frames"),
        validate.output_dims(n % 33, t % 7, (n % 33) * (t % 7) * F.when(t % 10 == 0, 2).otherwise(1)).alias("dims"),
        validate.stride(t, t * 320 + n % 1300 - 650).alias("stride"),
        validate.vocab_dim(n % 33, F.lit(32)).alias("vocab"),
        validate.token_range(ids, F.lit(32), 0).alias("ids"),
        validate.decision_shape(t % 4, n % 4).alias("shape"),
    )


P12_SQL = """WITH rows AS (SELECT o_orderkey, o_orderkey % 3000 AS t, o_custkey * 37 % 40000 AS n FROM orders)
SELECT o_orderkey, CASE WHEN t < n THEN 'no_alignment_path' WHEN t * n > 32000000 THEN 'no_alignment_path' WHEN t * 4 > 2000000 THEN 'no_alignment_path' ELSE 'ok' END AS cells,
  CASE WHEN t * 1000 > 2000000 THEN 'frame_budget' ELSE 'ok' END AS frames,
  CASE WHEN n % 33 = 0 THEN 'bad_shape' WHEN t % 7 = 0 THEN 'empty' WHEN t % 10 = 0 THEN 'bad_shape' ELSE 'ok' END AS dims,
  CASE WHEN abs(650 - n % 1300) <= 640 THEN 'ok' ELSE 'bad_stride' END AS stride, CASE WHEN n % 33 = 32 THEN 'ok' ELSE 'vocab_mismatch' END AS vocab,
  CASE WHEN n % 40 >= 32 OR t % 5 - 2 < -1 THEN 'token_out_of_range' ELSE 'ok' END AS ids, CASE WHEN t % 4 IN (0, 1) OR t % 4 = n % 4 THEN 'ok' ELSE 'decision_shape' END AS shape FROM rows"""


def p7_mask_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as samples: silence outside two spans set to zero, padded to the encoder's least input, and a slice of them."""
    two = F.array(F.struct(F.lit(3).alias("start"), F.lit(9).alias("end")), F.struct(F.lit(30).alias("start"), F.lit(41).alias("end")))
    rows = frames(spark, sf_dir).select("clip_id", "frame", intervals.pad_samples(intervals.mask_samples(F.col("logits"), two)).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rows.select("clip_id", "frame", F.size("x").alias("n"), F.round(total, 5).alias("kept"), F.count_if(F.lit(True)).over(Window.partitionBy("clip_id")).alias("frames"))


P7_SQL = f"""WITH {FRAMES_SQL} SELECT clip_id, frame, 400 AS n, round(list_sum(list_transform(logits[4:9] || logits[31:41], lambda v: CAST(v AS DOUBLE))), 5) AS kept, count(*) OVER (PARTITION BY clip_id) AS frames FROM frames"""

QUERIES = {
    "x1_log_softmax": x1_log_softmax, "g16_frame_reductions": g16_frame_reductions, "p10_log_prob_guard": p10_log_prob_guard, "g12_standardize": g12_standardize, "x2_trellis_end": x2_trellis_end,
    "x3_beam_path": x3_beam_path, "x4_align_words": x4_align_words, "g9_merge_repeats": g9_merge_repeats, "g10_merge_words": g10_merge_words, "x7_compose_words": x7_compose_words, "p12_guards": p12_guards, "p7_mask_samples": p7_mask_samples,
}
ORACLE_SQL = {
    "x1_log_softmax": X1_SQL, "g16_frame_reductions": G16_SQL, "p10_log_prob_guard": P10_SQL, "g12_standardize": G12_SQL, "x2_trellis_end": X2_SQL, "x3_beam_path": X3_SQL, "x4_align_words": X4_SQL,
    "g9_merge_repeats": G9_SQL, "g10_merge_words": G10_SQL, "x7_compose_words": X7_SQL, "p12_guards": P12_SQL, "p7_mask_samples": P7_SQL,
}
