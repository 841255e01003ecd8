"""Missing values, long texts, markers, streams and hot or odd registries."""

import random
import time
import zlib
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import ctc, cut, dispatch, ingest, intervals, registry, runs, tokens, validate
from spanloom.plans import align_runs
from spanloom.plans.shared import ensure_checkpoint_dir, remove_folder, shared_folder
from spanloom.registry import QUERIES
from spanloom.sources import tables, vocabulary
from spanloom.streaming import cutter, folds

SPANS = "stream_id bigint, seq bigint, kind string, start_sample bigint, end_sample bigint, override string, high_water bigint"
ODD = [
    (1, 1, "vad", 0, 10, None, None), (1, 2, "vad", None, 20, None, None), (1, 3, "vad", 15, None, None, None), (1, 4, None, 15, 20, None, None), (1, 5, "no_speech", None, None, None, None),
    (1, 6, "no_speech", None, 12, None, None), (1, 7, "noise", 12, 13, None, None), (1, 8, "vad", 12, 30, "x", None), (1, 9, "eof", None, None, None, None), (1, 10, "vad", 40, 50, None, None),
    (1, 11, "restart", None, None, None, None), (1, 12, "vad", 5, 9, None, None), (None, 1, "vad", 0, 4, None, None),
]


def test_rows_without_bounds_have_a_status(spark):
    rows = spark.createDataFrame(ODD, SPANS)
    got = {(r.stream_id, r.seq): (r.status, r.watermark) for r in cut.outcomes(rows).collect()}
    assert [got[1, k] for k in range(1, 13)] == [
        ("accepted", 10), ("missing_bounds", 10), ("missing_bounds", 10), ("unknown_kind", 10), ("missing_bounds", 10), ("accepted", 12),
        ("unknown_kind", 12), ("accepted", 30), ("accepted", 30), ("after_eof", 30), ("accepted", 0), ("accepted", 9),
    ]
    assert got[None, 1] == ("accepted", 4)
    chunks = sorted((str(r.stream_id), r.chunk_id, r.start_sample, r.end_sample) for r in cut.cut(rows, 100).collect())
    assert chunks == [("1", 0, 0, 30), ("1", 1, 5, 9), ("None", 0, 0, 4)]


def test_the_stream_cut_takes_the_same_rows(spark):
    at = shared_folder(spark, "odd")
    rows = spark.createDataFrame(ODD[:-1], SPANS)
    rows.coalesce(1).write.parquet(f"{at}/in")
    query = cutter.cut_stream(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), 100).writeStream.format("memory").queryName("odd").outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.chunk_id, r.start_sample, r.end_sample) for r in spark.table("odd").collect()] == [(0, 0, 30)]
    remove_folder(spark, at)


def test_packets_without_values_change_nothing(spark):
    rows = [(1, 1, 0, 1, 48_000, 100), (1, 2, None, 1, 48_000, 100), (1, 3, 300, None, 48_000, 100), (1, 4, 300, 1, 48_000, None), (1, 5, 300, 1, 48_000, 100)]
    df = spark.createDataFrame(rows, "stream_id bigint, seq bigint, pts bigint, tb_num int, tb_den int, n_samples bigint")
    assert [(r.status, r.total_samples) for r in ingest.append_packets(df).orderBy("seq").collect()] == [("accepted", 100)] + [("missing_value", 100)] * 3 + [("accepted", 200)]


LETTERS = [(t, i) for t, i in vocabulary.BUNDLED if len(t) == 1 and t != "|"]


@pytest.mark.parametrize("mark", list(".-!'1,(") + ["\u2014", "é", "€"])
def test_a_million_marks_take_linear_time(spark, mark):
    bodies = [(k, a + mark * 1_000_000 + b) for k, (a, b) in enumerate([("a", "b"), ("", ""), ("a ", " b")])]
    rows = spark.createDataFrame(bodies, "doc_id int, body string").repartition(3)
    alphabet = tokens.Alphabet.of(LETTERS, True)
    words = rows.select("doc_id", text.latin_words(F.col("body")).alias("w"), text.latin_words(F.col("body"), clitics=mark != "'").alias("c"))
    begin = time.time()
    words.select(F.size("w"), F.size("c"), tokens.tokenize(F.col("w"), alphabet, 4)["status"]).collect()
    runs.carve(rows.select("doc_id", F.col("body").alias("text"), F.lit("en").alias("state_lang")), ["doc_id"]).count()
    assert time.time() - begin < 25


def test_a_registry_meets_each_chunk_once(spark):
    aligners = spark.createDataFrame([("en", "a", "en"), ("en", "b", "en"), ("any", "x", "mul"), ("any", "y", "mul")], "key string, aligner_id string, language string")
    chunks = spark.createDataFrame([(1, "en"), (2, "fr"), (3, None)], "chunk_id int, language string")
    assert sorted((r.chunk_id, r.aligner_id, r.matched) for r in registry.lookup(chunks, aligners).collect()) == [(1, "b", "exact"), (2, "y", "any"), (3, "y", "any")]
    assert {r.status for r in registry.lookup(chunks, aligners.limit(0), "error").collect()} == {"language_unsupported"}


def test_clips_out_of_shape_or_budget_have_a_status(spark, monkeypatch):
    lp = [-0.5, -1.0, -1.0, -2.0]
    rows = [(c, t, lp) for c in range(1, 7) for t in range(6)] + [(7, 0, lp), (7, 1, lp[:2]), (8, 0, None)]
    frames = spark.createDataFrame(rows, "clip_id bigint, frame int, lp array<float>")
    ids = {1: [1, 2], 2: [], 3: [1, 9], 4: [1, -2], 5: [1] * 7, 7: [1], 8: [1], 9: [1, 2]}
    asked = spark.createDataFrame(list(ids.items()), "clip_id bigint, token_ids array<int>")
    status = lambda: {r.clip_id: r.status for r in ctc.align(frames, asked).collect()}
    none = "no_alignment_path"
    assert status() == {1: "ok", 2: none, 3: "token_out_of_range", 4: "token_out_of_range", 5: none, 6: none, 7: "bad_shape", 8: "token_out_of_range", 9: none}
    monkeypatch.setattr(ctc, "MAX_CELLS", 11)
    assert status()[1] == none and ctc.end_scores(frames, asked).collect() == []


def test_masks_take_spans_in_any_order(spark):
    rng = random.Random(3)
    for _ in range(20):
        samples = [float(rng.randint(1, 9)) for _ in range(12)]
        spans = [tuple(sorted((rng.randint(-3, 14), rng.randint(-3, 14)))) for _ in range(rng.randint(0, 4))]
        df = spark.createDataFrame([(samples, spans)], "x array<float>, s array<struct<start:int,end:int>>")
        inside = [any(a <= i < b for a, b in spans) for i in range(12)]
        row = df.select(intervals.mask_samples(F.col("x"), F.col("s")), intervals.standardize_masked(F.col("x"), F.col("s"))).first()
        assert row[0] == [x if k else 0.0 for x, k in zip(samples, inside)]
        assert [v == 0.0 for v, k in zip(row[1], inside) if not k] == [True] * inside.count(False)


def plain_carve(body, state):
    """Runs by single characters."""
    import unicodedata

    def script(c):
        name = unicodedata.name(c, "")
        for key in ("HIRAGANA", "KATAKANA", "HANGUL", "CJK UNIFIED", "LATIN", "CYRILLIC"):
            if name.startswith(key):
                return key
        return None

    scripts = [script(c) for c in body]
    kana, hangul = any(s in ("HIRAGANA", "KATAKANA") for s in scripts), "HANGUL" in scripts
    of = {"HIRAGANA": "ja", "KATAKANA": "ja", "HANGUL": "ko", "CJK UNIFIED": "ja" if kana else "ko" if hangul else "zh", "LATIN": state if state in ("en", "fr") else "en", "CYRILLIC": state, None: None}
    own = [of[s] for s in scripts]
    known = [x for x in own if x]
    if not known:
        return []
    out, now = [], known[0]
    for c, x in zip(body, own):
        now = x or now
        if not out or out[-1][0] != now:
            out.append((now, ""))
        out[-1] = (now, out[-1][1] + c)
    return out


def test_carving_equals_character_by_character(spark):
    rng = random.Random(5)
    cases = [("".join(rng.choice("ab é1 .,!漢字かカ한글да\n") for _ in range(rng.randint(0, 25))), rng.choice(["en", "fr", "ru", None])) for _ in range(300)]
    df = spark.createDataFrame([(i, b, s) for i, (b, s) in enumerate(cases)], "seg int, text string, state_lang string")
    got = {}
    for r in sorted(runs.carve(df, ["seg"]).collect(), key=lambda r: (r.seg, r.run)):
        body = cases[r.seg][0]
        assert body[r.char_start : r.char_end] == r.text and body.encode()[r.byte_start : r.byte_end].decode() == r.text and r.n_chars == len(body)
        got.setdefault(r.seg, []).append((r.language, r.text))
    assert got == {i: found for i, (b, s) in enumerate(cases) if (found := plain_carve(b, s))}


def plain_admission(rows, most, n):
    """Starts and resolutions of one stream, by the rules as they are told."""
    out, waiting, running, known, cut_so_far, language = [], [], set(), {}, 0, None
    for seq, kind, chunk, spoken in sorted(rows):
        if kind == "cut":
            waiting.append(cut_so_far)
            cut_so_far += 1
        elif chunk not in running:
            out.append((seq, "unknown_chunk", chunk, None))
            continue
        else:
            running.remove(chunk)
            known[chunk] = spoken
            out.append((seq, "resolved", chunk, spoken))
        prefix = next(k for k in range(len(known) + 1) if k not in known)
        seen = [known[k] for k in range(prefix) if known[k] is not None]
        if language is None and len(seen) >= n:
            counts = Counter(seen[:n])
            language = max(counts, key=lambda x: (counts[x], -seen.index(x)))
        while waiting and len(running) < most and (language is not None or waiting[0] < prefix + n - len(seen)):
            running.add(waiting[0])
            out.append((seq, "start", waiting.pop(0), language))
    return out


def test_admission_equals_the_rules(spark):
    found = {}
    for r in QUERIES["w11_admission"](spark, SMALL).collect():
        found.setdefault(r.stream_id, []).append((r.seq, r.action, r.chunk_id, r.language))
    from spanloom.queries.fixtures import chunks

    rows = {}
    for r in chunks(spark, SMALL).collect():
        rows.setdefault(r.stream_id, []).extend([(r.chunk_id * 10, "cut", r.chunk_id, r.language), (r.chunk_id * 10 + 25 + r.chunk_id % 3 * 12, "result", r.chunk_id, r.language)])
    assert len(found) > 50 and {k: sorted(v) for k, v in found.items()} == {k: sorted(plain_admission(v, 3, 2)) for k, v in rows.items()}


def test_admission_as_a_stream_equals_the_batch(spark):
    from spanloom.queries import streams
    from spanloom.queries.fixtures import chunks

    rows = chunks(spark, SMALL)
    events = rows.select("stream_id", (F.col("chunk_id") * 10).alias("seq"), F.lit("cut").alias("kind"), "chunk_id", "language").unionByName(
        rows.select("stream_id", (F.col("chunk_id") * 10 + 25).alias("seq"), F.lit("result").alias("kind"), "chunk_id", "language"))
    got = streams._streamed(spark, events.withColumn("arrives", F.lit(0)), lambda s: folds.admit_stream(s, 3, 2), dispatch.ADMISSIONS, 1)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, dispatch.admit(events, 3, 2).collect()))


def test_the_ratio_of_every_document_is_that_of_zlib(spark):
    bodies = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["g6_compression_gate"](spark, SMALL).collect():
        raw = (bodies[r.doc_id] or "").encode()
        want = 0.0 if len(raw) < 32 else len(raw) / len(zlib.compress(raw, 6))
        assert r.ratio == pytest.approx(want, abs=1e-5) and r.passes == (want <= 2.4)


def test_a_failing_run_fails_its_chunk_and_a_callers_normaliser_is_used(spark):
    chunks = spark.createDataFrame([(1, 0, 16_000), (2, 500, 16_000), (3, 0, 16_000)], "chunk_id bigint, first_sample bigint, n_samples bigint")
    found = spark.createDataFrame(
        [(1, 0, "en", "ab", 0, 500, "dtw"), (1, 1, "xx", "cd", 500, 900, "segment"), (2, 0, "xx", "ab", 0, 0, "wholeclip"), (2, 1, "en", None, 0, 100, "dtw"), (9, 0, "en", "ab", 0, 1, "dtw")],
        "chunk_id bigint, run bigint, language string, text string, t0_ms bigint, t1_ms bigint, bounds_source string")
    entries = registry.register(spark.createDataFrame([("en", "a", "en", 0), ("any", "b", "mul", 1)], "key string, aligner_id string, language string, seq int"))
    speech = chunks.select("chunk_id", F.lit(0).cast("bigint").alias("start"), F.col("n_samples").alias("end"))
    lp = [0.0 if i in (0, 5, 7) else -9.0 for i in range(31)]
    encode = lambda s: s.select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("frame")).withColumn("lp", F.array(*(F.lit(x) for x in lp)).cast("array<float>"))
    run = lambda **more: align_runs.align_runs(chunks, found, entries, speech, vocabulary.BUNDLED, encode, **more)
    plain = run()
    assert {r.chunk_id: (r.status, r.n_dtw, r.n_segment, r.n_wholeclip, r.n_unaligned) for r in plain.chunks.collect()} == {1: ("no_normalizer", 1, 1, 0, 0), 2: ("no_normalizer", 0, 0, 1, 0), 3: ("ok", 0, 0, 0, 0)}
    assert plain.words.collect() == []
    own = run(normalizers={"xx": lambda body: text.latin_words(F.lower(body))})
    assert {r.chunk_id: (r.status, r.n_unaligned) for r in own.chunks.collect()} == {1: ("ok", 0), 2: ("ok", 1), 3: ("ok", 0)}
    assert {(r.chunk_id, r.run, r.language, r.text) for r in own.words.collect()} == {(1, 0, "en", "ab"), (1, 1, "xx", "cd"), (2, 0, "xx", "ab")}


def test_a_callers_policy_decides_events(spark):
    alphabet = tokens.Alphabet.of(LETTERS, True)
    strict = lambda kind, ch: F.when((kind == "symbol") & (ch == "9"), "fail_closed").otherwise("wildcard")
    rows = spark.createDataFrame([(1, "a 9"), (2, "a € 8.5"), (3, "plain")], "i int, body string").withColumn("w", text.latin_words(F.col("body")))
    got = {r.i: (r.t.status, list(r.t.token_ids)) for r in rows.select("i", tokens.tokenize(F.col("w"), alphabet, 4, strict).alias("t")).collect()}
    assert got[1] == ("semantic_oov", []) and got[2] == ("ok", [7, 4, -1, 4, -1, -1, -1]) and got[3][0] == "ok"
    assert {r.i: r.v for r in rows.select("i", tokens.verdict(F.col("w"), alphabet, "fail_all").alias("v")).collect()} == {1: "semantic_oov", 2: "semantic_oov", 3: "ok"}


def test_a_dump_holds_emissions_trellis_and_clips(spark, tmp_path):
    frames = spark.createDataFrame([(c, t, [-0.5, -1.0, -1.5]) for c in (1, 2) for t in range(4)], "clip_id bigint, frame int, lp array<float>")
    asked = spark.createDataFrame([(1, [1, 2]), (2, [9])], "clip_id bigint, token_ids array<int>")
    assert not tables.dump_alignment(frames, asked, str(tmp_path / "a")) and tables.dump_alignment(frames, asked, str(tmp_path / "b"), enabled=True)
    cells = spark.read.parquet(str(tmp_path / "b" / "trellis")).orderBy("frame").collect()
    assert [r.clip_id for r in cells] == [1] * 4 and cells[0].cells == [0.0, float("-inf")] and cells[-1].cells[1] == pytest.approx(-2.5)
    assert {r.clip_id: (r.frames, r.vocab, r.blank) for r in spark.read.parquet(str(tmp_path / "b" / "clips")).collect()} == {1: (4, 3, 0), 2: (4, 3, 0)}


def test_decisions_of_runs_and_of_whole_chunks(spark):
    chunks = spark.createDataFrame([(i, "en") for i in range(7)], "chunk_id int, language string")
    found = spark.createDataFrame([(c, r, ("en", "fr")[r]) for c in (1, 2, 3, 4) for r in (0, 1)], "chunk_id int, run int, language string")
    decided = [(1, 0, "en"), (1, 1, "fr"), (2, 0, "en"), (2, 1, "en"), (3, 0, "en"), (5, 0, "en"), (6, 0, "fr"), (4, 0, None), (4, 1, "fr"), (4, 2, "fr")]
    got = validate.decisions(chunks, found, spark.createDataFrame(decided, "chunk_id int, run int, language string"))
    assert {r.chunk_id: r.status for r in got.collect()} == {0: "ok", 1: "ok", 2: "decision_language", 3: "decision_shape", 4: "decision_shape", 5: "ok", 6: "decision_language"}


def test_a_local_master_may_make_its_own_folder(spark):
    assert ensure_checkpoint_dir(spark) and shared_folder(spark, "a") != shared_folder(spark, "a")


def test_streams_keep_large_numbers_beside_nulls(spark):
    from spanloom.queries import streams

    big = (1 << 60) + 2
    rows = [(k, q, pts, 1, 48_000, 100) for k in (1, 2, big, None) for q, pts in enumerate([big, None, big + 300])]
    packets = spark.createDataFrame(rows, "stream_id bigint, seq bigint, pts bigint, tb_num int, tb_den int, n_samples bigint")
    got = streams._streamed(spark, packets.withColumn("arrives", F.lit(0)), folds.append_packets_stream, ingest.PACKETS, 1)
    assert sorted(map(str, got.collect())) == sorted(map(str, ingest.append_packets(packets).collect()))
