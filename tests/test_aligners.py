"""Decisions applied, vocabularies of aligners, and chunks' samples out of packets, against plain versions."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import ctc, ingest, registry, tokens, vocabularies
from spanloom.plans.align_runs import align_runs
from spanloom.sources.models import model_rows
from spanloom.sources.vocabulary import BUNDLED

GERMAN = {"model": {"vocab": {c: i for i, c in enumerate("abcdehnrsuäöü")}}, "added_tokens": [{"id": 13, "content": "|"}, {"id": 14, "content": "[PAD]"}, {"id": 15, "content": "[UNK]"}]}
FILES = [("en-1", json.dumps({"model": {"vocab": dict(BUNDLED)}})), ("de-1", json.dumps(GERMAN))]
WIDTH = {"en-1": 32, "de-1": 16}


@pytest.fixture(scope="module")
def own(spark):
    return vocabularies.of_aligners(vocabularies.tokens_of(spark.createDataFrame(FILES, "aligner_id string, spec string")))


def test_files_of_all_kinds(spark):
    files = [*FILES, ("x1", "{"), ("x2", None), ("x3", "[]"), ("x4", '{"model": {"type": "Unigram", "vocab": {"a": 1}}}'), ("x5", '{"model": {"vocab": {"a": 0}}, "added_tokens": [{"id": 7, "content": "a"}]}'), ("x6", "{}"), ("x6", "{}")]
    df = spark.createDataFrame(files, "aligner_id string, spec string")
    found = {(r.aligner_id, r.status) for r in vocabularies.parse(df).collect()}
    assert found == {("en-1", "ok"), ("de-1", "ok"), ("x1", "bad_json"), ("x2", "bad_json"), ("x3", "no_vocabulary"), ("x4", "unknown_model"), ("x5", "ok"), ("x6", "duplicate_aligner")}
    assert [(r.token, r.id) for r in vocabularies.tokens_of(df).where("aligner_id = 'x5'").collect()] == [("a", 7)]


def test_one_row_an_aligner(own):
    found = {r.aligner_id: r for r in own.collect()}
    en, de = found["en-1"], found["de-1"]
    assert (en.blank_id, en.unk_id, en.delimiter_id, en.uppercase_only, en.vocab_size) == (0, 3, 4, True, 32) and (de.blank_id, de.unk_id, de.delimiter_id, de.uppercase_only, de.vocab_size) == (14, 15, 13, False, 16)
    assert dict(zip(en.characters, en.character_ids, strict=True))["e"] == dict(BUNDLED)["E"] and "|" not in en.characters
    assert dict(zip(de.characters, de.character_ids, strict=True)) == GERMAN["model"]["vocab"]


def test_own_alphabets_spell_as_one_known_to_the_driver(spark, own):
    bodies = ["Ab cd", "", "...", "a.b", "x€y 9", "(hi)", "don't", "U.S.A. ok", "ümlaut", "😀 a"]
    df = spark.createDataFrame([(i, b, "en-1") for i, b in enumerate(bodies)], "doc_id int, body string, aligner_id string").join(own, "aligner_id")
    fixed, rows = tokens.Alphabet.of([(t, i) for t, i in BUNDLED if t != "|"], True), tokens.RowAlphabet(F.col("characters"), F.col("character_ids"))
    words = text.latin_words(F.col("body"))
    for policy in tokens.POLICIES:
        both = df.select(tokens.tokenize(words, fixed, 4, policy).alias("a"), tokens.tokenize(words, rows, F.col("delimiter_id"), policy).alias("b")).collect()
        assert all(r.a == r.b for r in both)
    plain = lambda a: sorted(map(tuple, tokens.oov_events(df, words, a, ["doc_id"]).collect()), key=str)
    assert plain(fixed) == plain(rows)


def frames_of(spark, clips, width=lambda a: WIDTH[a], n=40):
    """Random log-probabilities of every clip, as wide as its aligner's vocabulary."""
    rows, held = [], {}
    for clip, aligner in clips:
        lp = np.log(np.random.default_rng(clip).dirichlet(np.ones(width(aligner)), n)).astype(np.float32)
        held[clip] = lp
        rows += [(clip, t, [float(x) for x in v]) for t, v in enumerate(lp)]
    return spark.createDataFrame(rows, "clip_id bigint, frame int, lp array<float>"), held


RUNS = [(1, 0, "en", "bad hat"), (1, 1, "de", "bär und hase"), (2, 0, "de", "hund, schar"), (2, 1, "en", "x-ray"), (3, 0, "de", "häuser q"), (4, 0, "en", "up (to) you"), (5, 0, "en", "no")]


def aligned(spark, own, runs=RUNS, width=lambda a: WIDTH[a], **more):
    found = spark.createDataFrame([(*r, 0, 1_000, "wholeclip") for r in runs], "chunk_id bigint, run bigint, language string, text string, t0_ms bigint, t1_ms bigint, bounds_source string")
    chunks = spark.createDataFrame([(c, 100_000 * c, 16_000) for c in sorted({r[0] for r in runs})], "chunk_id bigint, first_sample bigint, n_samples bigint")
    entries = spark.createDataFrame([("en", "en-1", "en", 0), ("de", "de-1", "de", 1)], "key string, aligner_id string, language string, seq int")
    speech = chunks.select("chunk_id", F.lit(0).cast("bigint").alias("start"), F.col("n_samples").alias("end"))
    made = {}

    def encode(slices):
        df, held = frames_of(spark, [(r.clip_id, r.aligner_id) for r in slices.collect()], width)
        made.update(held)
        return df

    out = align_runs(chunks, found, registry.register(entries), speech, own, encode, policy="wildcard_all", **more)
    return out.words.collect(), {r.chunk_id: r for r in out.chunks.collect()}, made


def test_two_aligners_of_different_width_in_one_chunk(spark, own):
    words, chunks, made = aligned(spark, own)
    assert {r.status for r in chunks.values()} == {"ok"} and {lp.shape[1] for lp in made.values()} == {16, 32}
    assert [r.text for r in words if r.chunk_id == 1 and r.language == "de"] == ["bär", "und", "hase"]
    # Each clip's path is that of its own tokens, blank and frames.
    vocab, clip = GERMAN["model"]["vocab"], (1 << 12) + 1
    ids = np.array([vocab.get(c, -1) if c != " " else 13 for c in "bär und hase"])
    lp = made[clip]
    path = ctc.backtrack(ctc.trellis(lp, ids, 14), lp, ids, 14)
    first = [next(t for t, j, _ in path if j == k) for k in (0, 4, 8)]
    got = sorted(r.start_sample for r in words if r.chunk_id == 1 and r.language == "de")
    assert got == [100_000 + round(t * 16_000 / 39) for t in first]


def test_frames_of_another_width_fail_the_chunk(spark, own):
    _, chunks, _ = aligned(spark, own, width=lambda a: 32)
    assert {c: r.status for c, r in chunks.items()} == {1: "vocab_mismatch", 2: "vocab_mismatch", 3: "vocab_mismatch", 4: "ok", 5: "ok"}


def decisions_of(spark, own, change=lambda rows: rows):
    df = spark.createDataFrame(RUNS, "chunk_id bigint, run bigint, language string, body string").withColumn("aligner_id", F.concat("language", F.lit("-1"))).join(own, "aligner_id")
    events = tokens.oov_events(df, text.latin_words(F.col("body")), tokens.RowAlphabet(F.col("characters"), F.col("character_ids")), ["chunk_id", "run"]).collect()
    language = {r[:2]: r[2] for r in RUNS}
    rows = [(c, r, None, None, None, None, None, None, None) for c, r, _, _ in RUNS]
    rows += [(e.chunk_id, e.run, language[e.chunk_id, e.run], e.event, e.kind, e.ch, e.char_index, e.word_index, "wildcard") for e in events]
    return spark.createDataFrame(change(rows), "chunk_id bigint, run bigint, language string, event bigint, kind string, ch string, char_index bigint, word_index bigint, decision string")


def test_decisions_take_the_place_of_a_policy(spark, own):
    plain = aligned(spark, own)
    decided = aligned(spark, own, decided=decisions_of(spark, own))
    assert [tuple(r) for r in plain[0]] == [tuple(r) for r in decided[0]] and plain[1] == decided[1]


def test_decisions_that_do_not_fit(spark, own):
    def change(rows):
        out = []
        for r in rows:
            if r[0] == 1 and r[1] == 1:
                continue  # no list for the last of two runs
            if r[0] == 2 and r[3] == 0 and r[1] == 0:
                r = (*r[:8], "fail_closed")
            if r[0] == 3 and r[3] is not None:
                r = (*r[:6], r[6] + 1, *r[7:])
            if r[0] == 4 and r[3] is not None:
                r = (*r[:2], "fr", *r[3:])
            out.append(r)
        return [*out, (5, 0, "en", 0, "symbol", "x", 0, 0, "wildcard")]

    words, chunks, _ = aligned(spark, own, decided=decisions_of(spark, own, change))
    assert {c: r.status for c, r in chunks.items()} == {1: "decision_shape", 2: "ok", 3: "decision_event", 4: "decision_language", 5: "decision_length"}
    assert {r.chunk_id for r in words} == {2} and {r.language for r in words} == {"en"} and chunks[2].n_unaligned == 1


def test_without_any_decision_only_texts_without_events_pass(spark, own):
    none = decisions_of(spark, own).limit(0)
    _, chunks, _ = aligned(spark, own, decided=none)
    assert {c: r.status for c, r in chunks.items()} == {1: "ok", 2: "decision_length", 3: "decision_length", 4: "decision_length", 5: "ok"}


def test_unknown_decisions(spark, own):
    _, chunks, _ = aligned(spark, own, decided=decisions_of(spark, own, lambda rows: [(*r[:8], "perhaps") if r[3] == 0 and r[0] == 3 else r for r in rows]))
    assert chunks[3].status == "unknown_decision" and chunks[2].status == "ok"


@pytest.mark.parametrize("bucket", [7, 50, 10_000])
def test_chunk_samples_equal_a_plain_version(spark, bucket):
    rng = random.Random(bucket)
    packets, chunks, tapes = [], [], {}
    for stream in range(4):
        at, tape = 0, []
        for _ in range(rng.randint(1, 30)):
            gap, n = rng.choice([0, 0, 3, 40]), rng.choice([0, 1, 16, 90])
            samples = [float(rng.randint(1, 9)) for _ in range(n)]
            packets.append((stream, at + gap if n else None, samples if n or rng.random() < 0.5 else None))
            if n:
                tape += [0.0] * gap + samples
                at += gap + n
        tapes[stream] = tape
        for c in range(12):
            a = rng.randint(-3, len(tape) + 5)
            chunks.append((stream, c, a, a + rng.randint(-2, 200)))
        chunks.append((stream, 99, 0, len(tape)))
    chunks += [(9, 0, 0, 5), (0, 50, None, 5)]
    p = spark.createDataFrame(packets, "stream_id bigint, first_sample bigint, samples array<float>")
    c = spark.createDataFrame(chunks, "stream_id bigint, chunk_id bigint, start_sample bigint, end_sample bigint")
    water = spark.createDataFrame([(1, 10)], "stream_id bigint, low_water bigint")
    want = {}
    for stream, k, a, b in chunks:
        tape = tapes.get(stream, [])
        status = "bad_bounds" if a is None or a < 0 or b <= a else "trimmed" if stream == 1 and a < 10 else "ahead_of_audio" if b > len(tape) else "ok"
        want[stream, k] = (status, tape[a:b] if status == "ok" else None)
    got = {(r.stream_id, r.chunk_id): (r.status, r.samples) for r in ingest.chunk_samples(p, c, ["stream_id"], water, bucket).collect()}
    assert got == want
    assert ingest.chunk_samples(p.limit(0), c, ["stream_id"]).where("status = 'ok'").count() == 0


def test_failures_of_a_model_are_rows(spark):
    def call(batch):
        rows = []
        for i, x in zip(batch.column("id").to_pylist(), batch.column("x").to_pylist(), strict=True):
            rows += [(i, k, 10 // x) for k in range(x)]
        if not rows:
            return pa.RecordBatch.from_pydict({"id": pa.array([], pa.int64()), "k": pa.array([], pa.int32()), "y": pa.array([], pa.int64())})
        return pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(("id", "k", "y"), zip(*rows, strict=True), strict=True)})

    df = spark.createDataFrame([(1, 2), (2, 0), (3, None), (4, 1), (5, -1)], "id bigint, x int").withColumn("more", F.lit("kept out")).coalesce(1)
    got = sorted(((r.id, r.k, r.y, r.error) for r in model_rows(df, ["id"], call, "k int, y bigint").collect()), key=str)
    assert [g[:3] for g in got] == [(1, 0, 5), (1, 1, 5), (3, None, None), (4, 0, 10)] and got[2][3].startswith("TypeError") and {g[3] for g in got if g[1] is not None} == {None}
    assert model_rows(df.limit(0), ["id"], call, "k int, y bigint").collect() == []
    wrong = model_rows(df.where("id = 4"), ["id"], lambda batch: batch, "k int, y bigint").collect()
    assert [(r.id, r.k) for r in wrong] == [(4, None)] and wrong[0].error
