"""Queries over texts: normalisers, scripts, runs, tokens and out-of-vocabulary events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import language, script, text
from spanloom.operators import runs, texts, tokens
from spanloom.plans.shared import cut, spread
from spanloom.queries.fixtures import documents, table
from spanloom.sources.vocabulary import BUNDLED

LETTERS = [(t, i) for t, i in BUNDLED if len(t) == 1 and t != "|"]
ALPHABET = tokens.Alphabet.of(LETTERS, uppercase=True)
DELIMITER = dict(BUNDLED)["|"]


def s3_latin_normalizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English and French rules over every document."""
    return texts.summaries(documents(spark, sf_dir), ["doc_id"], {"en": (F.col("text"), False), "fr": (F.translate("text", "u", "'"), True)})


def _latin_sql(source: str, clitics: bool) -> str:
    """Words of column t by the Latin rules, as list of (w, surface, prefix, suffix) under the name source_words."""
    pieces = r"list_filter(regexp_split_to_array(regexp_replace(t, '([''\x{2019}])', '\1' || chr(1), 'g'), chr(1)), lambda p: len(p) > 0)" if clitics else "[t]"
    left_only = "i < len(ps)" if clitics else "false"
    return rf"""{source}_tokens AS (
  SELECT doc_id, pos, unnest(list_filter(regexp_split_to_array(body, '[{text.SPACE}]+'), lambda t: len(t) > 0)) AS t, unnest(range(len(list_filter(regexp_split_to_array(body, '[{text.SPACE}]+'), lambda t: len(t) > 0)))) AS k
  FROM (SELECT doc_id, 0 AS pos, {source} AS body FROM docs)
), {source}_split AS (SELECT doc_id, k, {pieces} AS ps FROM {source}_tokens
), {source}_pieces AS (SELECT doc_id, k, ps, unnest(range(1, len(ps) + 1)) AS i FROM {source}_split
), {source}_left AS (SELECT doc_id, k, i, ps[i] AS piece, {left_only} AS lo, regexp_replace(ps[i], '^[{_EDGE_SQL}]+', '') AS l FROM {source}_pieces
), {source}_bare AS (SELECT *, CASE WHEN lo THEN l ELSE regexp_replace(l, '[{_EDGE_SQL}]+$', '') END AS bare FROM {source}_left
), {source}_parts AS (
  SELECT *, CASE WHEN lo THEN 0 ELSE len(piece) - len(l) END AS pre, CASE WHEN lo THEN 0 ELSE len(l) - len(bare) END AS suf,
    CASE WHEN regexp_matches(bare, '[{text.JOINS}]') THEN list_filter(regexp_split_to_array(bare, '[{text.JOINS}]'), lambda p: len(p) > 0) ELSE [bare] END AS parts, regexp_matches(bare, '[{text.JOINS}]') AS several
  FROM {source}_bare WHERE len(bare) > 0
), {source}_words AS (
  SELECT doc_id, k, i, j, lower(parts[j]) AS w, CASE WHEN several THEN parts[j] ELSE piece END AS surface, CASE WHEN j = 1 THEN pre ELSE 0 END AS prefix, CASE WHEN j = len(parts) THEN suf ELSE 0 END AS suffix
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM {source}_parts)
), {source}_all AS (
  SELECT doc_id, count(*) AS {source}_words, string_agg(w, ' ' ORDER BY k, i, j) AS {source}_text, string_agg(surface, '|' ORDER BY k, i, j) AS {source}_surface, CAST(sum(prefix) AS BIGINT) AS {source}_prefix, CAST(sum(suffix) AS BIGINT) AS {source}_suffix
  FROM {source}_words GROUP BY doc_id)"""


_EDGE_SQL = text.EDGE.replace("'", "''")
S3_SQL = f"""WITH docs AS (SELECT doc_id, text AS en, replace(text, 'u', '''') AS fr FROM documents), {_latin_sql("en", False)}, {_latin_sql("fr", True)}
SELECT d.doc_id, coalesce(en_words, 0) AS en_words, coalesce(en_text, '') AS en_text, coalesce(en_surface, '') AS en_surface, coalesce(en_prefix, 0) AS en_prefix, coalesce(en_suffix, 0) AS en_suffix,
  coalesce(fr_words, 0) AS fr_words, coalesce(fr_text, '') AS fr_text, coalesce(fr_surface, '') AS fr_surface, coalesce(fr_prefix, 0) AS fr_prefix, coalesce(fr_suffix, 0) AS fr_suffix
FROM docs d LEFT JOIN en_all e ON d.doc_id = e.doc_id LEFT JOIN fr_all f ON d.doc_id = f.doc_id"""

# Literal texts in both engines: the tables hold no other scripts.
CJK = [(1, "chinese", "你好，world！ 再见。"), (2, "japanese", "今日は、Spark（テスト）・です。"), (3, "korean", "안녕·하세요, OK? 한국"), (4, "chinese", " 。！ "), (5, "japanese", "ABC がんばって"), (6, "korean", "가 나-다")]


def s5_cjk_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = spark.createDataFrame(CJK, "id long, kind string, body string")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id").cast("long") * 4_096 + F.col("turn") + 100).alias("id"), F.element_at(F.array(*map(F.lit, ("chinese", "japanese", "korean"))), (F.col("turn") % 3 + 1).cast("int")).alias("kind"), F.col("text").alias("body"))
    rows = literal.unionByName(spread(turns))
    words = text.normalize(F.col("body"), F.col("kind"))
    return rows.select("id", "kind", F.size(words).alias("n_words"), text.joined(words).alias("normalized"), F.array_join(F.transform(words, lambda w: w["surface"]), "|").alias("surface"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


S5_SQL = rf"""WITH rows(id, kind, body) AS (
  SELECT CAST(id AS BIGINT), kind, body FROM (VALUES {_values(CJK)}) v(id, kind, body) UNION ALL SELECT CAST(conv_id AS BIGINT) * 4096 + turn + 100, ['chinese', 'japanese', 'korean'][turn % 3 + 1], text FROM conversations
), kept AS (
  SELECT id, kind, list_filter(string_split(body, ''), lambda c: len(c) > 0 AND NOT regexp_matches(c, '^[{text.SPACE}]$') AND NOT contains(CASE kind {" ".join("WHEN '" + k + "' THEN '" + v.replace("'", "''") + "'" for k, v in text.SKIPPED.items())} END, c)) AS cs FROM rows)
SELECT id, kind, len(cs) AS n_words, array_to_string(list_transform(cs, lambda c: lower(c)), ' ') AS normalized,
  array_to_string(list_transform(cs, lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z]$') THEN lower(c) ELSE c END), '|') AS surface FROM kept"""

CODES = ["en", "EN", "eN", "zh", "haw", "Haw", "hAW", "HAW", "hAw", "haW", "yue", "YUE", "yUe", "xx", "tlh", "", "de-DE", "1a", "toolongcode", "JW", "nn", "Sw"]


def s11_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all shapes, and the beginnings of all words of the conversations as codes, each with how many rows carry it."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "[ \\n]+")).alias("word")).select(F.substring("word", 1, 3).alias("code"))
    counted = spark.createDataFrame([(c,) for c in CODES], "code string").unionByName(words).groupBy("code").agg(F.count("*").alias("n"))
    rows = counted.withColumn("parsed", language.parse(F.col("code")))
    return rows.select("code", "n", "parsed", language.try_parse(F.col("code")).alias("named"), language.validate(F.col("code")).alias("stored"), language.is_latin(F.col("parsed")).alias("latin"), language.normalizer_kind(F.col("parsed")).alias("kind"), language.uses_word_delimiter(F.col("parsed")).alias("delimiter"))


_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
S11_SQL = f"""WITH rows AS (
  SELECT code, count(*) AS n FROM (SELECT code FROM (VALUES {_values([(c,) for c in CODES])}) v(code) UNION ALL SELECT substr(unnest(regexp_split_to_array(text, '[ \\n]+')), 1, 3) FROM conversations) GROUP BY code
), p AS (
  SELECT code, n, CASE WHEN lower(code) IN {_LIST(language.LANGUAGES)} AND (len(code) = 2 OR substr(code, 2) = lower(substr(code, 2)) OR substr(code, 2) = upper(substr(code, 2))) THEN lower(code) ELSE code END AS parsed FROM rows
), n AS (SELECT *, CASE WHEN parsed IN {_LIST(language.LANGUAGES)} THEN parsed END AS named FROM p
), k AS (SELECT *, CASE WHEN regexp_full_match(code, '[A-Za-z]{{1,8}}') THEN coalesce(named, lower(code)) END AS stored, parsed IN {_LIST(language.LATIN)} AS latin,
  CASE WHEN parsed IN ('zh', 'yue') THEN 'chinese' WHEN parsed = 'ja' THEN 'japanese' WHEN parsed = 'ko' THEN 'korean' WHEN parsed IN ('fr', 'it') THEN 'latin_clitic' WHEN parsed IN {_LIST(language.LATIN_NORMALIZED)} THEN 'latin' END AS kind FROM n)
SELECT code, n, parsed, named, stored, latin, kind, kind LIKE 'latin%' AS delimiter FROM k"""


def s9_oov_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts.oov_events(documents(spark, sf_dir), ["doc_id"], "text", ALPHABET)
    return found.withColumn("decision", tokens.decide(F.col("kind"), F.col("ch")))


_KNOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_UPPER = "translate(c, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_STEPS_SQL = f"""docs AS (SELECT doc_id, text AS en FROM documents), {_latin_sql("en", False)}, indexed AS (
  SELECT doc_id, w, prefix, suffix, row_number() OVER (PARTITION BY doc_id ORDER BY k, i, j) - 1 AS word_index, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY k, i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM en_words
), steps AS (
  SELECT doc_id, word_index, CAST(coalesce(before, 0) AS BIGINT) + word_index AS base, prefix, suffix, w, unnest(range(prefix + len(w) + suffix)) AS s FROM indexed
), chars AS (
  SELECT *, CASE WHEN s >= prefix AND s < prefix + len(w) THEN substr(w, s - prefix + 1, 1) END AS c, base + greatest(0, least(s - prefix, len(w))) AS char_index FROM steps
), kinds AS (
  SELECT *, CASE WHEN c IS NULL THEN 'boundary_punct' WHEN c = '.' THEN 'internal_punct' WHEN NOT contains('{_KNOWN.replace("'", "''")}', {_UPPER}) THEN 'symbol' END AS kind FROM chars)"""
S9_SQL = rf"""WITH {_STEPS_SQL}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY word_index, s) - 1 AS event, kind, c AS ch, char_index, word_index,
  CASE WHEN kind <> 'symbol' OR regexp_matches(c, '^[\p{{L}}\p{{N}}''\x{{2019}}]$') THEN 'wildcard' ELSE 'fail_closed' END AS decision
FROM kinds WHERE kind IS NOT NULL"""


def s10_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = texts.spell(documents(spark, sf_dir), ["doc_id"], "text", ALPHABET, DELIMITER)
    spell = lambda c: F.array_join(c, " ", "-")
    return made.select("doc_id", "status", spell(F.col("token_ids").cast("array<string>")).alias("ids"), spell(F.col("word_idx").cast("array<string>")).alias("words"))


S10_SQL = rf"""WITH {_STEPS_SQL}, emitted AS (
  SELECT doc_id, word_index, s, CASE WHEN kind IS NOT NULL THEN '-1' ELSE CAST([{", ".join(str(i) for _, i in sorted(LETTERS))}][strpos('{"".join(t for t, _ in sorted(LETTERS)).replace("'", "''")}', {_UPPER})] AS VARCHAR) END AS id, CAST(word_index AS VARCHAR) AS wi FROM kinds
  UNION ALL SELECT DISTINCT doc_id, word_index, -1, '{DELIMITER}', '-' FROM kinds WHERE word_index > 0
), spelled AS (SELECT doc_id, string_agg(id, ' ' ORDER BY word_index, s) AS ids, string_agg(wi, ' ' ORDER BY word_index, s) AS words FROM emitted GROUP BY doc_id),
failed AS (SELECT doc_id, bool_or(kind = 'symbol' AND NOT regexp_matches(c, '^[\p{{L}}\p{{N}}''\x{{2019}}]$')) AS bad FROM kinds GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN f.bad THEN 'semantic_oov' ELSE 'ok' END AS status, coalesce(s.ids, '') AS ids, coalesce(s.words, '') AS words
FROM docs d LEFT JOIN spelled s ON d.doc_id = s.doc_id LEFT JOIN failed f ON d.doc_id = f.doc_id"""

# Segments of mixed script, with times in centiseconds and the language so far.
SEGMENTS = [
    (1, "hello 世界 again", "en", 0, 300), (2, "今日はgood day です", None, 100, 900), (3, "123 …", "en", 0, 50), (4, "안녕 hi 한자漢字", "fr", 10, 777), (5, "only english here", "de", 5, 95),
    (6, "漢字だけ", None, None, None), (7, "", "en", 0, 10), (8, " … привет мир", "ru", 0, 100), (9, "abc漢", "en", 0, 1),
]


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal segments, every document and every turn of a conversation."""
    literal = spark.createDataFrame(SEGMENTS, "seg_id bigint, text string, state_lang string, t0_cs bigint, t1_cs bigint")
    times = lambda i: [(i % 50).alias("t0_cs"), F.when(i % 3 != 0, i % 50 + 900).alias("t1_cs")]
    docs = documents(spark, sf_dir).select((F.col("doc_id") + 1_000_000).alias("seg_id"), "text", F.col("lang").alias("state_lang"), *times(F.col("doc_id")))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1_000 + F.col("turn") + 10_000_000_000).alias("seg_id"), "text", F.lit(None).cast("string").alias("state_lang"), *times(F.col("turn")))
    return literal.unionByName(docs).unionByName(turns)


_SEG_SQL = f"""seg AS (
  SELECT CAST(seg_id AS BIGINT) AS seg_id, text, state_lang, CAST(t0_cs AS BIGINT) AS t0_cs, CAST(t1_cs AS BIGINT) AS t1_cs FROM (VALUES {_values(SEGMENTS)}) v(seg_id, text, state_lang, t0_cs, t1_cs)
  UNION ALL SELECT doc_id + 1000000, text, lang, doc_id % 50, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 50 + 900 END FROM documents
  UNION ALL SELECT conv_id * 1000 + turn + 10000000000, text, NULL, turn % 50, CASE WHEN turn % 3 <> 0 THEN turn % 50 + 900 END FROM conversations)"""


def _timed_tokens(carved: DataFrame) -> DataFrame:
    """Two tokens a run that halve its bytes, in the segments of even id; the second of segment 4 has no time."""
    half = F.call_function("div", F.col("byte_end") - F.col("byte_start"), F.lit(2).cast("bigint"))
    rows = carved.where("seg_id % 2 = 0").withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select("seg_id", (F.col("byte_start") + F.col("part") * half).alias("byte_offset"), F.when(F.col("part") == 0, half).otherwise(F.col("byte_end") - F.col("byte_start") - half).alias("byte_len"),
                       F.when(~((F.col("seg_id") == 4) & (F.col("part") == 1) & (F.col("run") == 1)), 20 + F.col("run") * 100 + F.col("part") * 30).cast("bigint").alias("t_dtw_cs"))


def w6_script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one language with their bounds."""
    segments = _segments(spark, sf_dir)
    carved = cut(runs.carve(segments, ["seg_id"]))
    timed = runs.run_times(carved, _timed_tokens(carved), ["seg_id"]).join(segments.select("seg_id", "t0_cs", "t1_cs"), "seg_id")
    return runs.bound(timed, ["seg_id"]).select("seg_id", "run", "language", "text", "char_start", "char_end", "byte_start", "byte_end", "t0_ms", "t1_ms", "bounds_source")


W6_SQL = rf"""WITH {_SEG_SQL}, ch AS (
  SELECT *, unnest(string_split(text, '')) AS c, unnest(range(len(text))) AS i, regexp_matches(text, '[\p{{Hiragana}}\p{{Katakana}}]') AS kana, regexp_matches(text, '\p{{Hangul}}') AS hangul FROM seg WHERE len(text) > 0
), own AS (
  SELECT *, CASE WHEN regexp_matches(c, '[\p{{Hiragana}}\p{{Katakana}}]') THEN 'ja' WHEN regexp_matches(c, '\p{{Hangul}}') THEN 'ko' WHEN regexp_matches(c, '\p{{Han}}') THEN CASE WHEN kana THEN 'ja' WHEN hangul THEN 'ko' ELSE 'zh' END
    WHEN regexp_matches(c, '\p{{Latin}}') THEN CASE WHEN state_lang IN {_LIST(language.LATIN)} THEN state_lang ELSE 'en' END WHEN regexp_matches(c, '[\p{{Common}}\p{{Inherited}}]') THEN NULL ELSE state_lang END AS own FROM ch
), carried AS (
  SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY seg_id ORDER BY i ROWS UNBOUNDED PRECEDING), first_value(own IGNORE NULLS) OVER (PARTITION BY seg_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lang,
    coalesce(sum(strlen(c)) OVER (PARTITION BY seg_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM own
), marked AS (SELECT *, CASE WHEN lang = lag(lang) OVER (PARTITION BY seg_id ORDER BY i) THEN 0 ELSE 1 END AS c0 FROM carried WHERE lang IS NOT NULL),
numbered AS (SELECT *, sum(c0) OVER (PARTITION BY seg_id ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS run FROM marked),
carved AS (SELECT seg_id, run, lang AS language, string_agg(c, '' ORDER BY i) AS text, min(i) AS char_start, max(i) + 1 AS char_end, CAST(min(b) AS BIGINT) AS byte_start, CAST(max(b + strlen(c)) AS BIGINT) AS byte_end, any_value(t0_cs) AS t0, any_value(t1_cs) AS t1 FROM numbered GROUP BY seg_id, run, lang),
timed AS (SELECT *, seg_id % 2 = 0 AND NOT (seg_id = 4 AND run = 1) AND byte_end - byte_start > 1 AS ok, 20 + run * 100 AS lo, 50 + run * 100 AS hi, sum(char_end - char_start) OVER (PARTITION BY seg_id) AS n, count(*) OVER (PARTITION BY seg_id) AS k FROM carved),
shared AS (SELECT *, round(t0 + char_start::DOUBLE / n * (t1 - t0)) AS ilo, round(t0 + char_end::DOUBLE / n * (t1 - t0)) AS ihi FROM timed),
nexts AS (SELECT *, lead(CASE WHEN ok THEN lo ELSE ilo END) OVER (PARTITION BY seg_id ORDER BY run) AS nx FROM shared),
ends AS (SELECT *, CASE WHEN nx IS NOT NULL THEN CASE WHEN nx > lo THEN least(nx, coalesce(t1, nx)) END WHEN t1 > hi THEN t1 ELSE hi + 1 END AS e FROM nexts)
SELECT seg_id, CAST(run AS BIGINT) AS run, language, text, char_start, char_end, byte_start, byte_end,
  CAST(CASE WHEN ok AND e > lo THEN lo * 10 WHEN t0 IS NULL OR t1 IS NULL THEN -9223372036854775808 WHEN k = 1 THEN t0 * 10 ELSE ilo * 10 END AS BIGINT) AS t0_ms,
  CASE WHEN ok AND e > lo THEN CAST(e * 10 AS BIGINT) WHEN t0 IS NULL OR t1 IS NULL THEN 9223372036854775807 WHEN k = 1 THEN CAST(t1 * 10 AS BIGINT) ELSE CAST(greatest(ihi, ilo + 1) * 10 AS BIGINT) END AS t1_ms,
  CASE WHEN ok AND e > lo THEN 'dtw' WHEN t0 IS NULL OR t1 IS NULL THEN 'wholeclip' ELSE 'segment' END AS bounds_source FROM ends"""


def g15_script_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("seg_id", script.has_kana(F.col("text")).alias("kana"), script.has_hangul(F.col("text")).alias("hangul"))


G15_SQL = rf"""WITH {_SEG_SQL} SELECT seg_id, regexp_matches(text, '[\p{{Hiragana}}\p{{Katakana}}]') AS kana, regexp_matches(text, '\p{{Hangul}}') AS hangul FROM seg"""

QUERIES = {"s3_latin_normalizer": s3_latin_normalizer, "s5_cjk_normalizers": s5_cjk_normalizers, "s11_language_codes": s11_language_codes, "s9_oov_events": s9_oov_events, "s10_tokenize": s10_tokenize, "w6_script_runs": w6_script_runs, "g15_script_flags": g15_script_flags}
ORACLE_SQL = {"s3_latin_normalizer": S3_SQL, "s5_cjk_normalizers": S5_SQL, "s11_language_codes": S11_SQL, "s9_oov_events": S9_SQL, "s10_tokenize": S10_SQL, "w6_script_runs": W6_SQL, "g15_script_flags": G15_SQL}
