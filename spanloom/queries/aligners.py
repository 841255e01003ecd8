"""Turns of conversations as runs: the caller's decisions applied, a vocabulary for each aligner; and chunks' samples out of packets."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators import asr, ingest, texts, tokens, validate, vocabularies
from spanloom.plans.shared import cut, spread
from spanloom.queries.fixtures import FRAMES_SQL, frames, table
from spanloom.queries.language import ALPHABET, DELIMITER, LETTERS, _STEPS_SQL, _UPPER
from spanloom.sources.models import model_rows
from spanloom.sources.vocabulary import BUNDLED

KEYS = ["chunk_id", "run"]


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return spread(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("chunk_id"), (F.row_number().over(order) - 1).cast("bigint").alias("run"), "text"))


#: Turns in the place of documents; a turn's number is its conversation's, shifted, with its own.
_TURNS_SQL = _STEPS_SQL.replace(
    "docs AS (SELECT doc_id, text AS en FROM documents)",
    "turns AS (SELECT CAST(conv_id AS BIGINT) AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run, text FROM conversations), docs AS (SELECT chunk_id * 4096 + run AS doc_id, chunk_id, run, text AS en FROM turns)",
)

#: What is wrong with a conversation's decisions, by its number modulo 11.
SHORT, MOVED, STRICT, FOREIGN, CLIPPED, ABSENT, VAGUE = 3, 5, 6, 7, 8, 9, 10


def _decided(turns: DataFrame, events: DataFrame) -> DataFrame:
    """A caller's table of decisions by the default policy, one list a run, with what goes wrong in some conversations."""
    which, run_of = F.col("chunk_id") % 11, Window.partitionBy("chunk_id")
    ended = turns.select(*KEYS, (F.max("run").over(run_of) == F.col("run")).alias("last"))
    sent = (which != ABSENT) & ~((which == CLIPPED) & F.col("last"))
    none = lambda kind: F.lit(None).cast(kind)
    lists = ended.where(sent).select(*KEYS, none("string").alias("language"), none("bigint").alias("event"), none("string").alias("kind"), none("string").alias("ch"), none("bigint").alias("char_index"), none("bigint").alias("word_index"), none("string").alias("decision"))
    final = F.max("event").over(Window.partitionBy(*KEYS)) == F.col("event")
    decision = F.when((which == VAGUE) & (F.col("event") == 0), "maybe").when((which == STRICT) & (F.col("kind") == "boundary_punct"), "fail_closed").otherwise(tokens.decide(F.col("kind"), F.col("ch")))
    each = events.withColumn("final", final).join(ended, KEYS).where(sent & ~((which == SHORT) & F.col("final")))
    moved = F.col("char_index") + F.when((which == MOVED) & (F.col("event") == 0), 1).otherwise(0)
    language = F.when((which == FOREIGN) & (F.col("run") == 0), "de").otherwise("en")
    return lists.unionByName(each.select(*KEYS, language.alias("language"), "event", "kind", "ch", moved.cast("bigint").alias("char_index"), F.col("word_index").cast("bigint").alias("word_index"), decision.alias("decision")))


def s10_decisions_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's tokens under decisions that a caller made event by event, and what becomes of lists that don't fit."""
    turns = _turns(spark, sf_dir)
    # Every word has an id.
    empty = F.size("token_ids") == 0
    spelled = cut(texts.spell(turns, KEYS, "text", ALPHABET, DELIMITER).withColumn("status", F.when(empty, "empty_text").otherwise("ok")))
    events = cut(texts.oov_events(turns, KEYS, "text", ALPHABET))
    decided = _decided(spelled, events)
    of_chunk = validate.decisions(spelled.select("chunk_id").distinct().withColumn("language", F.lit("en")), spelled.select(*KEYS, F.lit("en").alias("language")), decided)
    applied = tokens.apply_decisions(spelled, events, decided, KEYS).join(of_chunk.select("chunk_id", F.col("status").alias("of_chunk")), "chunk_id")
    status = F.when(F.col("of_chunk") != "ok", F.col("of_chunk")).otherwise(F.col("status"))
    ids = F.when(status == "ok", F.array_join(F.col("token_ids").cast("array<string>"), " ")).otherwise("")
    return applied.select("chunk_id", "run", status.alias("status"), ids.alias("ids"))


_SPEAKABLE_SQL = r"regexp_matches(c, '^[\p{L}\p{N}''\x{2019}]$')"
S10_DECISIONS_SQL = rf"""WITH {_TURNS_SQL}, emitted AS (
  SELECT doc_id, word_index, s, CASE WHEN kind IS NOT NULL THEN '-1' ELSE CAST([{", ".join(str(i) for _, i in sorted(LETTERS))}][strpos('{"".join(t for t, _ in sorted(LETTERS)).replace("'", "''")}', {_UPPER})] AS VARCHAR) END AS id FROM kinds
  UNION ALL SELECT DISTINCT doc_id, word_index, -1, '{DELIMITER}' FROM kinds WHERE word_index > 0
), spelled AS (SELECT doc_id, string_agg(id, ' ' ORDER BY word_index, s) AS ids FROM emitted GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) FILTER (kind IS NOT NULL) AS events, coalesce(bool_or(kind = 'boundary_punct'), false) AS edges, coalesce(bool_or(kind = 'symbol' AND NOT {_SPEAKABLE_SQL}), false) AS mute FROM kinds GROUP BY doc_id
), sized AS (
  SELECT d.*, coalesce(c.events, 0) AS events, c.edges, c.mute, c.doc_id IS NULL AS blank, d.chunk_id % 11 AS which, count(*) OVER (PARTITION BY d.chunk_id) AS runs, max(CASE WHEN d.run = 0 THEN coalesce(c.events, 0) END) OVER (PARTITION BY d.chunk_id) AS first_events
  FROM docs d LEFT JOIN counted c ON c.doc_id = d.doc_id
), judged AS (
  SELECT *, CASE WHEN which = {CLIPPED} AND runs > 1 THEN 'decision_shape' WHEN which = {FOREIGN} AND first_events > 0 THEN 'decision_language' WHEN blank THEN 'empty_text' WHEN events = 0 THEN 'ok'
    WHEN which IN ({SHORT}, {ABSENT}, {CLIPPED}) THEN 'decision_length' WHEN which = {MOVED} THEN 'decision_event' WHEN which = {VAGUE} THEN 'unknown_decision' WHEN mute OR (which = {STRICT} AND edges) THEN 'semantic_oov' ELSE 'ok' END AS status FROM sized
)
SELECT j.chunk_id, j.run, j.status, CASE WHEN j.status = 'ok' THEN coalesce(s.ids, '') ELSE '' END AS ids FROM judged j LEFT JOIN spelled s ON s.doc_id = j.doc_id"""

_SMALL = "eanisrtdhulcgmobwfkzpväüßjöyqxéñóíàè"
#: Tokenizer files by aligner: capitals alone; small letters and other special tokens, added later; and files that can't be read.
FILES = [
    ("a-en", json.dumps({"model": {"vocab": dict(BUNDLED)}})),
    ("a-de", json.dumps({"model": {"type": "WordLevel", "vocab": {c: i for i, c in enumerate(_SMALL)}}, "added_tokens": [{"id": len(_SMALL) + k, "content": t} for k, t in enumerate(["|", "[UNK]", "[PAD]"])]})),
    ("a-fr", "{broken"), ("a-it", json.dumps({"model": {"type": "WordLevel"}})), ("a-es", json.dumps({"model": {"type": "Unigram", "vocab": {"a": 0}}})),
]


def r9_aligner_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn tokenised by the vocabulary of its own aligner, which is read from a file each; turns of aligners without one have a status."""
    files = spark.createDataFrame(FILES, "aligner_id string, spec string")
    vocab = vocabularies.of_aligners(vocabularies.tokens_of(files))
    which = F.element_at(F.array(*(F.lit(a) for a, _ in FILES)), F.when((F.col("chunk_id") + F.col("run")) % 29 < 3, (F.col("chunk_id") + F.col("run")) % 29 + 3).otherwise(F.col("run") % 2 + 1).cast("int"))
    turns = _turns(spark, sf_dir).withColumn("aligner_id", which)
    met = turns.join(vocabularies.parse(files).select("aligner_id", F.col("status").alias("read")), "aligner_id").join(vocab, "aligner_id", "left")
    # Texts without a vocabulary aren't spelled.
    met = met.withColumn("text", F.when(F.col("read") == "ok", F.col("text")))
    alphabet = tokens.RowAlphabet(F.col("characters"), F.col("character_ids"))
    spelled = texts.spell_by(met, [*KEYS, "aligner_id", "vocab_size", "blank_id", "read"], "text", alphabet, F.col("delimiter_id"))
    good = F.col("read") == "ok"
    ids = F.when(good & (F.col("status") == "ok"), F.array_join(F.col("token_ids").cast("array<string>"), " ")).otherwise("")
    return spelled.select(*KEYS, "aligner_id", "vocab_size", "blank_id", F.when(good, F.col("status")).otherwise(F.col("read")).alias("status"), ids.alias("ids"))


def _files_sql() -> str:
    return ", ".join("('" + a + "', '" + s.replace("'", "''") + "')" for a, s in FILES)


R9_SQL = rf"""WITH files(aligner_id, spec) AS (VALUES {_files_sql()}), read AS (
  SELECT aligner_id, spec, CASE WHEN NOT json_valid(spec) THEN 'bad_json' WHEN (TRY_CAST(spec AS JSON) -> '$.model.vocab') IS NULL THEN 'no_vocabulary'
    WHEN coalesce((TRY_CAST(spec AS JSON) ->> '$.model.type'), 'WordLevel') NOT IN ('WordLevel', 'BPE', 'WordPiece') THEN 'unknown_model' ELSE 'ok' END AS status FROM files
), own AS (
  SELECT aligner_id, unnest(json_keys((CAST(spec AS JSON) -> '$.model.vocab'))) AS token, CAST(spec AS JSON) AS j FROM read WHERE status = 'ok'
), entries AS (
  SELECT aligner_id, token, CAST(json_extract_string(j, '$.model.vocab."' || token || '"') AS INTEGER) AS id FROM own
  UNION ALL
  SELECT aligner_id, (t ->> 'content'), CAST((t ->> 'id') AS INTEGER) FROM (SELECT aligner_id, unnest(CAST((CAST(spec AS JSON) -> '$.added_tokens') AS JSON[])) AS t FROM read WHERE status = 'ok')
), special AS (
  SELECT aligner_id, CAST(max(id) + 1 AS INTEGER) AS vocab_size, coalesce(max(CASE WHEN token = '<pad>' THEN id END), max(CASE WHEN token = '[PAD]' THEN id END)) AS blank_id, max(CASE WHEN token = '|' THEN id END) AS delimiter_id,
    bool_or(token = 'A') AND NOT bool_or(token = 'a') AS upper_only FROM entries GROUP BY aligner_id
), {_TURNS_SQL.split(", chars AS (")[0]}, chars AS (
  SELECT *, CASE WHEN s >= prefix AND s < prefix + len(w) THEN substr(w, s - prefix + 1, 1) END AS c FROM steps
), placed AS (
  SELECT *, CASE WHEN (chunk_id + run) % 29 < 3 THEN ['a-fr', 'a-it', 'a-es'][(chunk_id + run) % 29 + 1] ELSE ['a-en', 'a-de'][run % 2 + 1] END AS aligner_id FROM docs
), looked AS (
  SELECT c.doc_id, c.word_index, c.s, c.c, e.id, p.delimiter_id FROM chars c JOIN placed d ON d.doc_id = c.doc_id JOIN special p ON p.aligner_id = d.aligner_id
  LEFT JOIN entries e ON e.aligner_id = d.aligner_id AND len(e.token) = 1 AND c.c <> '.' AND e.token = CASE WHEN p.upper_only THEN {_UPPER} ELSE c.c END
), emitted AS (
  SELECT doc_id, word_index, s, CAST(coalesce(id, -1) AS VARCHAR) AS id FROM looked
  UNION ALL SELECT DISTINCT doc_id, word_index, -1, CAST(delimiter_id AS VARCHAR) FROM looked WHERE word_index > 0
), spelled AS (SELECT doc_id, string_agg(id, ' ' ORDER BY word_index, s) AS ids FROM emitted GROUP BY doc_id
), failed AS (SELECT doc_id, bool_or(id IS NULL AND c IS NOT NULL AND c <> '.' AND NOT {_SPEAKABLE_SQL}) AS bad FROM looked GROUP BY doc_id)
SELECT d.chunk_id, d.run, d.aligner_id, p.vocab_size, p.blank_id, CASE WHEN r.status <> 'ok' THEN r.status WHEN f.bad THEN 'semantic_oov' ELSE 'ok' END AS status,
  CASE WHEN r.status <> 'ok' OR coalesce(f.bad, false) THEN '' ELSE coalesce(s.ids, '') END AS ids
FROM placed d JOIN read r ON r.aligner_id = d.aligner_id LEFT JOIN special p ON p.aligner_id = d.aligner_id LEFT JOIN spelled s ON s.doc_id = d.doc_id LEFT JOIN failed f ON f.doc_id = d.doc_id"""

#: Chunks overlap: they begin so many samples apart, and are so long.
STRIDE, LENGTH, LOW_STREAM, LOW_WATER = 900, 1_000, 3, 2_000


def p3_chunk_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as packets of 64 samples, a gap before every fifth and some that come too early, appended to buffers; overlapping chunks out of them."""
    vectors = frames(spark, sf_dir).select(F.col("clip_id").alias("stream_id"), F.col("frame").cast("bigint").alias("seq"), F.col("logits").alias("samples"))
    pts = F.col("seq") * 192 + F.call_function("div", F.col("seq"), F.lit(5).cast("bigint")) * 96 - F.when(F.col("seq") % 17 == 9, 1_000).otherwise(0)
    packets = vectors.select("stream_id", "seq", pts.alias("pts"), F.lit(1).alias("tb_num"), F.lit(48_000).alias("tb_den"), F.size("samples").cast("bigint").alias("n_samples"))
    placed = cut(ingest.append_packets(packets).where("status = 'accepted'").select("stream_id", "seq", "first_sample").join(vectors, ["stream_id", "seq"]))
    totals = placed.groupBy("stream_id").agg(F.max(F.col("first_sample") + F.size("samples")).alias("total"))
    numbered = totals.withColumn("chunk_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("total"), F.lit(STRIDE).cast("bigint")))))
    chunks = numbered.select("stream_id", "chunk_id", (F.col("chunk_id") * STRIDE).alias("start_sample"), (F.col("chunk_id") * STRIDE + LENGTH).alias("end_sample"))
    water = totals.where(F.col("stream_id") == LOW_STREAM).select("stream_id", F.lit(LOW_WATER).cast("bigint").alias("low_water"))
    found = ingest.chunk_samples(placed, chunks, ["stream_id"], water, bucket=512)
    total = lambda value: F.round(F.aggregate(F.transform("samples", value), F.lit(0.0), lambda a, x: a + x), 5)
    zeros = F.size(F.filter("samples", lambda x: x == 0))
    return found.select("stream_id", "chunk_id", "status", *(F.when(F.col("status") == "ok", c).alias(n) for n, c in (("n_samples", F.size("samples")), ("n_zero", zeros), ("total", total(lambda x: x.cast("double"))), ("weighted", total(lambda x, i: x.cast("double") * (i % 7))))))


P3_SAMPLES_SQL = f"""WITH {FRAMES_SQL}, placed AS (
  SELECT clip_id AS stream_id, 64 * frame + 32 * (frame // 5) AS first_sample, logits FROM frames WHERE frame % 17 <> 9
), samples AS (
  SELECT stream_id, first_sample + unnest(range(len(logits))) AS pos, CAST(unnest(logits) AS DOUBLE) AS x FROM placed
), totals AS (SELECT stream_id, max(pos) + 1 AS total FROM samples GROUP BY stream_id
), chunks AS (
  SELECT stream_id, total, unnest(range(total // {STRIDE} + 1)) AS chunk_id FROM totals
), judged AS (
  SELECT *, chunk_id * {STRIDE} AS b, CASE WHEN stream_id = {LOW_STREAM} AND chunk_id * {STRIDE} < {LOW_WATER} THEN 'trimmed' WHEN chunk_id * {STRIDE} + {LENGTH} > total THEN 'ahead_of_audio' ELSE 'ok' END AS status FROM chunks
), summed AS (
  SELECT j.stream_id, j.chunk_id, count(*) FILTER (x <> 0) AS n, sum(x) AS total, sum(x * ((pos - b) % 7)) AS weighted FROM judged j JOIN samples s ON s.stream_id = j.stream_id AND s.pos >= j.b AND s.pos < j.b + {LENGTH} WHERE j.status = 'ok' GROUP BY j.stream_id, j.chunk_id
)
SELECT j.stream_id, j.chunk_id, j.status, CASE WHEN j.status = 'ok' THEN {LENGTH} END AS n_samples, CAST(CASE WHEN j.status = 'ok' THEN {LENGTH} - coalesce(s.n, 0) END AS INTEGER) AS n_zero,
  CASE WHEN j.status = 'ok' THEN round(coalesce(s.total, 0), 5) + 0.0 END AS total, CASE WHEN j.status = 'ok' THEN round(coalesce(s.weighted, 0), 5) + 0.0 END AS weighted
FROM judged j LEFT JOIN summed s ON s.stream_id = j.stream_id AND s.chunk_id = j.chunk_id"""

#: Characters of a turn from which the model below fails.
TOO_LONG = 600


def _recognise(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Stands in for a recogniser: a turn's clauses as segments, each with a log-probability and a chance of silence; long turns fail."""
    rows = []
    for chunk, run, body in zip(*(batch.column(c).to_pylist() for c in ("chunk_id", "run", "text")), strict=True):
        if len(body) >= TOO_LONG:
            raise ValueError("too long")
        rows += [(chunk, run, k, part, -(len(part) % 16) / 16, 1 / (1 + part.count(" "))) for k, part in enumerate(body.split(","))]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["chunk_id", "run", "segment", "text", "logprob", "no_speech_prob"])


def r8_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model gives for every turn: segments put together, their statistics, and failures with their reason."""
    found = cut(model_rows(_turns(spark, sf_dir).where("text IS NOT NULL"), KEYS, _recognise, "segment int, text string, logprob double, no_speech_prob double"))
    good = found.where("error IS NULL")
    made = asr.joined_text(good, KEYS, "segment").join(asr.segment_statistics(good, KEYS), KEYS).join(asr.no_speech(good, KEYS), KEYS)
    whole = made.select(*KEYS, F.lit("ok").alias("status"), "text", "segments", F.round("avg_logprob", 6).alias("avg_logprob"), F.round("no_speech_prob", 6).alias("no_speech_prob"))
    none = lambda kind: F.lit(None).cast(kind)
    return whole.unionByName(found.where("error IS NOT NULL").select(*KEYS, F.col("error").alias("status"), none("string").alias("text"), none("bigint").alias("segments"), none("double").alias("avg_logprob"), none("double").alias("no_speech_prob")))


R8_SQL = f"""WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run, text FROM conversations
), parts AS (
  SELECT chunk_id, run, unnest(string_split(text, ',')) AS part FROM turns WHERE length(text) < {TOO_LONG}
), summed AS (
  SELECT chunk_id, run, count(*) AS segments, round(avg(-(length(part) % 16) / 16.0::DOUBLE), 6) AS avg_logprob, round(avg(1 / (1.0::DOUBLE + length(part) - length(replace(part, ' ', '')))), 6) AS no_speech_prob FROM parts GROUP BY chunk_id, run
)
SELECT t.chunk_id, t.run, CASE WHEN s.chunk_id IS NULL THEN 'ValueError: too long' ELSE 'ok' END AS status, CASE WHEN s.chunk_id IS NOT NULL THEN trim(replace(t.text, ',', '')) END AS text, s.segments, s.avg_logprob, s.no_speech_prob
FROM turns t LEFT JOIN summed s ON s.chunk_id = t.chunk_id AND s.run = t.run WHERE t.text IS NOT NULL"""

QUERIES = {"r8_model_rows": r8_model_rows, "s10_decisions_applied": s10_decisions_applied, "r9_aligner_vocabularies": r9_aligner_vocabularies, "p3_chunk_samples": p3_chunk_samples}
ORACLE_SQL = {"r8_model_rows": R8_SQL, "s10_decisions_applied": S10_DECISIONS_SQL, "r9_aligner_vocabularies": R9_SQL, "p3_chunk_samples": P3_SAMPLES_SQL}
