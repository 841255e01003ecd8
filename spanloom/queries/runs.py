"""Whole chunks aligned run by run: turns of a conversation as runs, vectors as the model's frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import numeric
from spanloom.operators import registry
from spanloom.plans.align_runs import Aligned, align_runs
from spanloom.queries.fixtures import BLANK, LOG_PROBS_SQL, frames, table
from spanloom.sources.vocabulary import BUNDLED

_ID = dict(BUNDLED)
_S = _ID["|"]


def _ids(*words: str) -> tuple[list[int], list[int | None]]:
    """Token ids and word numbers of spoken words; * stands for a wildcard."""
    ids, of = [], []
    for i, w in enumerate(words):
        ids += [_S] * (i > 0) + [-1 if c == "*" else _ID[c] for c in w]
        of += [None] * (i > 0) + [i] * len(w)
    return ids, of


#: Language, text, tokens, surfaces and what becomes of a run without regard to its frames.
CASES = [
    ("en", "ab cd", _ids("AB", "CD"), ["ab", "cd"], "ok"),
    ("de", "Ein Haus.", _ids("EIN", "HAUS*"), ["Ein", "Haus."], "ok"),
    ("xx", "hello", ([], []), [], "skipped"),
    ("en", "... !", ([], []), [], "empty_text"),
    ("en", "a € b", ([], []), [], "semantic_oov"),
    ("fr", "l'eau va", _ids("L'", "EAU", "VA"), ["l'", "eau", "va"], "ok"),
    ("en", "up-to 9", _ids("UP", "TO", "*"), ["up", "to", "9"], "ok"),
    ("ru", "да", ([], []), [], "no_normalizer"),
]


def _aligned(spark: SparkSession, sf_dir: str) -> Aligned:
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chunk_id"), (F.row_number().over(order) - 1).cast("bigint").alias("run"))
    which = (F.col("chunk_id") * 7 + F.col("run") * 3) % 8
    turns = turns.withColumn("case", F.when((which == 7) & (F.col("chunk_id") % 5 != 0), 0).otherwise(which).cast("int"))
    cases = spark.createDataFrame([(k, language, text) for k, (language, text, *_) in enumerate(CASES)], "case int, language string, text string")
    source = F.element_at(F.array(F.lit("dtw"), F.lit("segment"), F.lit("wholeclip")), ((F.col("chunk_id") + F.col("run")) % 3 + 1).cast("int"))
    found = turns.join(F.broadcast(cases), "case").withColumn("bounds_source", source).withColumn("t0_ms", F.col("run") * F.when(F.col("bounds_source") == "dtw", 400).otherwise(300))
    found = found.withColumn("t1_ms", F.col("t0_ms") + F.when(F.col("bounds_source") == "dtw", 900).otherwise(1500))
    chunks = turns.select("chunk_id").distinct().select("chunk_id", (F.col("chunk_id") * 100_000).alias("first_sample"), (64_000 + F.col("chunk_id") % 100).alias("n_samples"))
    entries = spark.createDataFrame([(x, f"a-{x}", x, i) for i, x in enumerate(("en", "de", "fr", "ru"))], "key string, aligner_id string, language string, seq int")
    speech = chunks.select("chunk_id", F.lit(0).cast("bigint").alias("start"), F.col("n_samples").alias("end"))
    held = frames(spark, sf_dir).select(F.col("clip_id").alias("emission_id"), "frame", numeric.log_softmax(F.col("logits")).alias("lp"))

    def encode(slices: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A run's frames are those of the label that its chunk and number point at."""
        return held, slices.select("clip_id", ((F.col("chunk_id") + F.col("run")) % 10).alias("emission_id"))

    return align_runs(chunks, found, registry.register(entries), speech, BUNDLED, encode, blank=BLANK)


def run_alignment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _aligned(spark, sf_dir).words
    return words.withColumn("score", F.round(F.col("score").cast("double"), 4))


def run_alignment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).chunks


_LIST = lambda xs: "[" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in xs) + "]"
_VALUES = ", ".join(f"({k}, '{language}', {_LIST(ids)}::BIGINT[], {_LIST(of)}::BIGINT[], {_LIST(surfaces)}::VARCHAR[], '{outcome}')" for k, (language, _, (ids, of), surfaces, outcome) in enumerate(CASES))
_RUNS_SQL = f"""WITH RECURSIVE {LOG_PROBS_SQL}, cases(c, language, tok, widx, surfaces, outcome) AS (VALUES {_VALUES}),
turns AS (SELECT conv_id AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run FROM conversations),
picked AS (SELECT *, CASE WHEN (chunk_id * 7 + run * 3) % 8 = 7 AND chunk_id % 5 <> 0 THEN 0 ELSE (chunk_id * 7 + run * 3) % 8 END AS c, (chunk_id + run) % 3 AS src, (chunk_id + run) % 10 AS label, 64000 + chunk_id % 100 AS clip FROM turns),
ms AS (SELECT *, run * CASE WHEN src = 0 THEN 400 ELSE 300 END AS t0, run * CASE WHEN src = 0 THEN 400 ELSE 300 END + CASE WHEN src = 0 THEN 900 ELSE 1500 END AS t1 FROM picked),
sliced AS (SELECT *, CASE WHEN src = 2 THEN 0 WHEN t0 * 16 >= clip THEN 0 ELSE t0 * 16 END AS lo, CASE WHEN src = 2 THEN clip WHEN t0 * 16 >= clip THEN 0 ELSE least(t1 * 16, clip) END AS hi FROM ms),
sized AS (SELECT clip_id, max(frame) + 1 AS total FROM lps GROUP BY clip_id),
clips AS (SELECT s.clip_id, c.c, s.total, c.tok, c.widx, len(c.tok) AS n FROM sized s CROSS JOIN cases c WHERE c.outcome = 'ok' AND s.total >= len(c.tok)),
fold AS (
  SELECT clip_id, c, CAST(0 AS BIGINT) AS t, [CAST(0 AS FLOAT)] || list_transform(range(n - 1), lambda i: CAST('-inf' AS FLOAT)) AS acc FROM clips
  UNION ALL
  SELECT f.clip_id, f.c, f.t + 1,
    [CASE WHEN f.t + 1 > s.total - s.n THEN CAST('inf' AS FLOAT) ELSE CAST(f.acc[1] + x.lp[{BLANK + 1}] AS FLOAT) END] ||
    list_transform(range(1, s.n), lambda j: greatest(CAST(f.acc[j + 1] + l.lp[{BLANK + 1}] AS FLOAT), CAST(f.acc[j] + CASE WHEN s.tok[j + 1] = -1 THEN list_max(l.lp[2:]) ELSE l.lp[s.tok[j + 1] + 1] END AS FLOAT)))
  FROM fold f JOIN clips s ON s.clip_id = f.clip_id AND s.c = f.c JOIN lps l ON l.clip_id = f.clip_id AND l.frame = f.t JOIN lps x ON x.clip_id = f.clip_id AND x.frame = f.t + 1
), back AS (
  SELECT f.clip_id, f.c, f.t, [{{'j': s.n - 1, 'path': [s.n - 1]}}] AS beams FROM fold f JOIN clips s ON s.clip_id = f.clip_id AND s.c = f.c AND f.t = s.total - 1 WHERE isfinite(f.acc[s.n])
  UNION ALL
  SELECT b.clip_id, b.c, b.t - 1, list_transform(list_sort(list_filter(flatten(list_transform(range(len(b.beams)), lambda k: [
      {{'neg': -f.acc[b.beams[k + 1].j + 1], 'idx': 2 * k, 'j': b.beams[k + 1].j, 'path': [b.beams[k + 1].j] || b.beams[k + 1].path}},
      {{'neg': -f.acc[b.beams[k + 1].j], 'idx': 2 * k + 1, 'j': b.beams[k + 1].j - 1, 'path': [b.beams[k + 1].j - 1] || b.beams[k + 1].path}}])),
      lambda x: x.j >= 0 AND coalesce(isfinite(x.neg), false)))[1:2], lambda x: {{'j': x.j, 'path': x.path}})
  FROM back b JOIN fold f ON f.clip_id = b.clip_id AND f.c = b.c AND f.t = b.t - 1 WHERE b.t > 0 AND len(b.beams) > 0 AND b.beams[1].j > 0
), won AS (SELECT clip_id, c, t, beams[1].path AS path FROM back WHERE len(beams) > 0 AND beams[1].j = 0
), steps AS (
  SELECT w.clip_id, w.c, l.frame, CASE WHEN l.frame < w.t THEN 0 ELSE w.path[l.frame - w.t + 1] END AS j, CASE WHEN l.frame >= w.t THEN w.path[l.frame - w.t + 2] END AS next_j, l.lp FROM won w JOIN lps l ON l.clip_id = w.clip_id
), path AS (
  SELECT p.clip_id, p.c, p.frame, p.j, s.widx[p.j + 1] AS word_index, CAST(exp(CASE WHEN next_j IS NULL OR next_j = j THEN lp[{BLANK + 1}] WHEN s.tok[next_j + 1] = -1 THEN list_max(lp[2:]) ELSE lp[s.tok[next_j + 1] + 1] END::DOUBLE) AS FLOAT) AS score
  FROM steps p JOIN clips s ON s.clip_id = p.clip_id AND s.c = p.c
), segments AS (SELECT clip_id, c, j, word_index, min(frame) AS b, max(frame) + 1 AS e, CAST(avg(CAST(score AS DOUBLE)) AS FLOAT) AS score FROM path GROUP BY clip_id, c, j, word_index),
spoken AS (SELECT clip_id, c, word_index, min(b) AS b, max(e) AS e, CAST(sum(CAST(score AS DOUBLE) * (e - b)) / sum(e - b) AS FLOAT) AS score FROM segments WHERE word_index IS NOT NULL GROUP BY clip_id, c, word_index),
judged AS (
  SELECT r.*, k.language, k.surfaces, z.total, CASE WHEN k.outcome <> 'ok' THEN k.outcome WHEN w.clip_id IS NULL THEN 'no_alignment_path' ELSE 'ok' END AS status
  FROM sliced r JOIN cases k ON k.c = r.c LEFT JOIN sized z ON z.clip_id = r.label LEFT JOIN won w ON w.clip_id = r.label AND w.c = r.c
), stops AS (SELECT *, min(CASE WHEN status = 'no_normalizer' THEN run END) OVER (PARTITION BY chunk_id) AS stop FROM judged)
"""
RUN_WORDS_SQL = _RUNS_SQL.rstrip() + """, scaled AS (
  SELECT *, hi - lo AS real, greatest(hi - lo, 400) AS n, greatest(hi - lo, 400)::DOUBLE / (total - 1) AS spf, chunk_id * 100000 + lo AS first FROM stops WHERE stop IS NULL AND status = 'ok'
), met AS (
  SELECT s.chunk_id, s.run, s.language, p.word_index, s.surfaces[p.word_index + 1] AS text, s.first + CAST(round(p.b * s.spf) AS BIGINT) AS b, s.first + CAST(round(p.e * s.spf) AS BIGINT) AS e, s.first, s.real, s.n, p.score,
    len(list_filter(range(p.b, p.e), lambda f: least(CAST(round((f + 1) * s.spf) AS BIGINT), s.real) > CAST(round(f * s.spf) AS BIGINT))) AS voiced, p.e - p.b AS frames
  FROM scaled s JOIN spoken p ON p.clip_id = s.label AND p.c = s.c
), kept AS (
  SELECT *, least(e, first + real) AS clamped FROM met WHERE voiced > 0 AND voiced * 2 >= frames AND frames - voiced <= 4 AND b < first + n AND e > b AND least(e, first + real) > b
)
SELECT chunk_id, run, language, CAST(word_index AS INTEGER) AS word_index, text, b AS start_sample, clamped AS end_sample, round(CAST(score AS DOUBLE), 4) AS score,
  row_number() OVER (PARTITION BY chunk_id ORDER BY b, clamped, run, word_index) - 1 AS position FROM kept"""
RUN_CHUNKS_SQL = _RUNS_SQL.rstrip() + """
SELECT chunk_id, CASE WHEN any_value(stop) IS NOT NULL THEN 'no_normalizer' ELSE 'ok' END AS status, count(*) FILTER (src = 0 AND seen) AS n_dtw, count(*) FILTER (src = 1 AND seen) AS n_segment, count(*) FILTER (src = 2 AND seen) AS n_wholeclip,
  count(*) FILTER (status NOT IN ('ok', 'no_normalizer') AND seen) AS n_unaligned
FROM (SELECT *, stop IS NULL OR run <= stop AS seen FROM stops) GROUP BY chunk_id"""

QUERIES = {"run_alignment_words": run_alignment_words, "run_alignment_chunks": run_alignment_chunks}
ORACLE_SQL = {"run_alignment_words": RUN_WORDS_SQL, "run_alignment_chunks": RUN_CHUNKS_SQL}
