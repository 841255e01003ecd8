import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import language, text
from spanloom.operators import runs, texts, tokens
from spanloom.queries import aligners as aligner_queries
from spanloom.queries import language as language_queries
from spanloom.sources import vocabulary

LETTERS = [(t, i) for t, i in vocabulary.BUNDLED if len(t) == 1 and t != "|"]


def words_of(spark, body, kind="latin"):
    row = spark.createDataFrame([(body, kind)], "body string, kind string").select(text.normalize(F.col("body"), F.col("kind")).alias("w")).first()
    return None if row.w is None else [(w.word, w.surface, w.prefix, w.suffix) for w in row.w]


@pytest.mark.parametrize(
    ("body", "kind", "want"),
    [
        ("The QUICK brown Fox", "latin", [("the", "The", 0, 0), ("quick", "QUICK", 0, 0), ("brown", "brown", 0, 0), ("fox", "Fox", 0, 0)]),
        ("Hello, world!", "latin", [("hello", "Hello,", 0, 1), ("world", "world!", 0, 1)]),
        ("Don't go.", "latin", [("don't", "Don't", 0, 0), ("go", "go.", 0, 1)]),
        ("¿Qué? «x»", "latin", [("qué", "¿Qué?", 1, 1), ("«x»", "«x»", 0, 0)]),
        ("'quoted' (hello-world)", "latin", [("quoted", "'quoted'", 1, 1), ("hello", "hello", 1, 0), ("world", "world", 0, 1)]),
        ("l'eau d’or", "latin_clitic", [("l'", "l'", 0, 0), ("eau", "eau", 0, 0), ("d’", "d’", 0, 0), ("or", "or", 0, 0)]),
        ("a b c", "latin", [("a", "a", 0, 0), ("b", "b", 0, 0), ("c", "c", 0, 0)]),
        ("... -- !", "latin", []),
        ("", "latin", []),
        ("Ab。世 界", "chinese", [("a", "a", 0, 0), ("b", "b", 0, 0), ("世", "世", 0, 0), ("界", "界", 0, 0)]),
        (None, "latin", None),
        ("مرحبا", None, None),
    ],
)
def test_normalizers(spark, body, kind, want):
    assert words_of(spark, body, kind) == want


def tokenized(spark, body, policy="default"):
    df = spark.createDataFrame([(body,)], "body string").withColumn("w", text.latin_words(F.col("body")))
    return df.select(tokens.tokenize(F.col("w"), tokens.Alphabet.of(LETTERS, True), 4, policy).alias("t")).first().t


def spelled(body):
    ids = dict(LETTERS)
    return [ids[c.upper()] for c in body]


def test_tokens_of_plain_words(spark):
    t = tokenized(spark, "the cat sat")
    assert t.status == "ok" and t.token_ids == [*spelled("the"), 4, *spelled("cat"), 4, *spelled("sat")]
    assert t.word_idx == [0, 0, 0, None, 1, 1, 1, None, 2, 2, 2]


def test_unknown_characters_become_wildcards_or_fail(spark):
    assert tokenized(spark, "has 43k users").token_ids == [*spelled("has"), 4, -1, -1, *spelled("k"), 4, *spelled("users")]
    assert tokenized(spark, "U.S.A").token_ids == [*spelled("u"), -1, *spelled("s"), -1, *spelled("a")]
    assert tokenized(spark, "a & b").status == "semantic_oov" and tokenized(spark, "a & b").token_ids == []
    assert tokenized(spark, "a & b", "wildcard_all").token_ids == [*spelled("a"), 4, -1, 4, *spelled("b")]
    assert tokenized(spark, "straße").token_ids == [*spelled("stra"), -1, *spelled("e")]
    assert tokenized(spark, "Hi,", "fail_all").status == "semantic_oov" and tokenized(spark, "Hi,").token_ids == [*spelled("hi"), -1]
    with pytest.raises(ValueError):
        tokens.decide(F.lit("symbol"), F.lit("x"), "other")


def test_events_count_characters_but_not_edges(spark):
    df = spark.createDataFrame([(1, "\"Hi, a.b 7")], "id int, body string")
    found = tokens.oov_events(df, text.latin_words(F.col("body")), tokens.Alphabet.of(LETTERS, True), ["id"]).orderBy("event").collect()
    assert [(e.kind, e.ch, e.char_index, e.word_index) for e in found] == [("boundary_punct", None, 0, 0), ("boundary_punct", None, 2, 0), ("internal_punct", ".", 4, 1), ("symbol", "7", 7, 2)]


def test_decisions_must_match_events_but_not_their_language(spark):
    schema = "id int, event int, kind string, ch string, char_index int, word_index int, language string"
    events = spark.createDataFrame([(1, 0, "symbol", "7", 3, 1, "en"), (2, 0, "symbol", "7", 3, 1, "en"), (3, 0, "boundary_punct", None, 3, 1, "en")], schema)
    decided = spark.createDataFrame([(1, 0, "symbol", "7", 3, 1, "de"), (2, 0, "symbol", "7", 4, 1, "en"), (3, 0, "boundary_punct", None, 3, 1, "en"), (3, 1, "symbol", "x", 9, 2, "en")], schema).drop("language")
    assert {r.id: r.matches for r in tokens.match_decisions(events, decided, ["id"]).collect()} == {1: True, 2: False, 3: False}


def test_special_tokens_and_files(spark, tmp_path):
    row = tokens.special_tokens(vocabulary.bundled(spark)).first()
    assert (row.blank_id, row.unk_id, row.delimiter_id, row.uppercase_only) == (0, 3, 4, True)
    file = tmp_path / "t.json"
    file.write_text(json.dumps({"model": {"vocab": {"[PAD]": 0, "a": 1, "|": 2}}, "added_tokens": [{"content": "<x>", "id": 3}]}))
    assert [(r.token, r.id) for r in vocabulary.load_tokenizer(spark, str(file)).collect()] == [("[PAD]", 0), ("a", 1), ("|", 2), ("<x>", 3)]
    for bad in ("{}", '{"model": {"type": "Odd", "vocab": {}}}', "[]"):
        with pytest.raises(ValueError):
            vocabulary.parse_tokenizer(bad)


def test_language_codes(spark):
    rows = spark.createDataFrame([("EN",), ("hAW",), ("haW",), ("xx",), (None,)], "c string")
    assert [r[0] for r in rows.select(language.parse(F.col("c"))).collect()] == ["en", "haw", "haW", "xx", None]
    assert len(set(language.LANGUAGES)) == 100 and set(language.LATIN) < set(language.LANGUAGES)


def test_runs_carry_over_neutral_characters(spark):
    df = spark.createDataFrame([(1, "¡hi 世界!", "es"), (2, "…", "en"), (3, "", "en")], "seg_id int, text string, state_lang string")
    got = [(r.seg_id, r.language, r.text) for r in runs.carve(df, ["seg_id"]).orderBy("seg_id", "run").collect()]
    assert got == [(1, "es", "¡hi "), (1, "zh", "世界!")]


def test_tokens_that_do_not_spell_the_text_lose_their_times(spark):
    toks = spark.createDataFrame([(1, 0, 2, "he"), (1, 2, 3, "llo"), (2, 0, 2, "xx")], "seg_id int, byte_offset int, byte_len int, piece string")
    segs = spark.createDataFrame([(1, "hello"), (2, "hi")], "seg_id int, text string")
    assert sorted((r.seg_id, r.byte_len) for r in runs.check_token_bytes(toks, segs, ["seg_id"]).collect()) == [(1, 2), (1, 3), (2, 0)]


def test_whole_texts_give_what_the_expressions_give(spark):
    bodies = ["Ab cd-ef, (hi) a.b U.S.A.", "", "... !", "x€y 9 – «na»", "l'eau d’or 'tis", "a\x1cb c　d e", "-/- x/", "İI ΣΣ ́a", None, "tab\tnew\nline's end'"]
    df = spark.createDataFrame(list(enumerate(bodies)), "doc_id int, text string")
    plain = lambda rows: sorted(map(str, rows.collect()))
    for clitics in (False, True):
        w = text.latin_words(F.col("text"), clitics)
        want = df.where("text is not null").select("doc_id", F.size(w).cast("bigint"), text.joined(w), F.array_join(F.transform(w, lambda x: x["surface"]), "|"))
        got = texts.summaries(df, ["doc_id"], {"n": (F.col("text"), clitics)}).where("n_text is not null").select("doc_id", "n_words", "n_text", "n_surface")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    w, alphabet = text.latin_words(F.col("text")), language_queries.ALPHABET
    made = tokens.spell(w, alphabet, 4)
    assert plain(texts.spell(df, ["doc_id"], "text", alphabet, 4)) == plain(df.select("doc_id", tokens.verdict(w, alphabet).alias("status"), made["token_ids"].alias("token_ids"), made["word_idx"].alias("word_idx")))
    assert plain(texts.oov_events(df, ["doc_id"], "text", alphabet)) == plain(tokens.oov_events(df, w, alphabet, ["doc_id"]))


def test_whole_texts_by_the_alphabets_of_their_rows_give_what_the_expressions_give(spark):
    bodies = ["Ab cd-ef, (hi) a.b U.S.A.", "", "... !", "x€y 9 – «na»", "l'eau d’or", None, "tab\tnew\nline's end'"]
    alphabets = [("abcdefhil", list(range(9)), 20), ("xy.na'", [3, 1, 7, 4, 5, 9], None), ("", [], 0), ("€aba", [1, 2, 3, 4], 5)]
    rows = [(10 * k + i, body, *a) for k, a in enumerate(alphabets) for i, body in enumerate(bodies)]
    df = spark.createDataFrame(rows, "doc_id int, text string, characters string, ids array<int>, delimiter int").coalesce(1)
    own = tokens.RowAlphabet(F.col("characters"), F.col("ids"))
    w = text.latin_words(F.col("text"))
    made, status = tokens.spell(w, own, F.col("delimiter")), tokens.tokenize(w, own, F.col("delimiter"))["status"]
    want = df.where("text is not null").select("doc_id", status.alias("status"), made["token_ids"].alias("token_ids"), made["word_idx"].alias("word_idx"))
    got = texts.spell_by(df, ["doc_id"], "text", own, F.col("delimiter"))
    assert sorted(map(str, got.where("token_ids is not null").collect())) == sorted(map(str, want.collect()))
    assert got.where("token_ids is null").count() == 4
    assert "MapInArrow" in aligner_queries.r9_aligner_vocabularies(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
