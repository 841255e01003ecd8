"""Operators against the libraries, their SQL, and brute force."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from compare import rows_of, rows_of_sql
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import bpe, components, license_model, license_scan, line_dedup, nearest, packing, queries, quality_rules, simhash, token_counts

BYTE, RANKS, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
ODD = ["", "a", "don't  stop\n\n x's 12²½", "日本語テスト café é", "x<|endoftext|>y <|startoftext|>", "ÀÉ İstanbul ΑΣ ΑΣ", "a" * 3_000, "!?" * 500, " " * 200 + "z", "\x1c\x85 \xa0  x", "naïve ŒUVRE ß", "тест ١٢٣", "😀😀 hi", "ʯʰ ǅ ª", "-- ---\t\r\n"]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + ODD


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SMALL)) == rows_of_sql(queries.ORACLE_SQL[name], SMALL)


def test_encoding_equals_the_library(spark, texts):
    ranks, _ = bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    assert [bpe.encode(t, ranks) for t in texts] == [library.encode_ordinary(t) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in bpe.round_trip(df, RANKS).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    back = bpe.decode_documents(bpe.encode_documents(df, RANKS), RANKS).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(texts))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab cdé1'\n!ʯ世", max_size=60))
def test_merges_and_counts_of_any_text(text):
    ranks, tokens = bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = bpe.encode(text, ranks)
    assert ids == library.encode_ordinary(text) and bpe.decode(ids, tokens) == text.encode()
    assert token_counts.load_vocabulary(BYTE).count(text) == len(Tokenizer_BYTE.encode(text, add_special_tokens=False).ids)


Tokenizer_BYTE = Tokenizer.from_file(BYTE)


def test_counts_equal_the_library(texts):
    count = token_counts.load_vocabulary(BYTE).count
    assert [count(t) for t in texts] == [len(e.ids) for e in Tokenizer_BYTE.encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_the_library(spark, texts):
    library = Tokenizer.from_file(WORD)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.pieces(df, WORD, 100).collect()}
    want = {}
    for i, t in enumerate(texts):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 100)):
            part = ids[at : at + 100]
            want[i, k] = (at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=15))
def test_plan_places_every_piece_once(counts):
    made = packing.plan(counts, 40)
    placed = {}
    for b in made:
        assert sum(x * n for x, n in b.runs) + b.free == 40 and b.free >= 0 and b.times > 0
        for x, n in b.runs:
            placed[x] = placed.get(x, 0) + n * b.times
    assert placed == counts
    total = sum(x * n for x, n in counts.items())
    assert -(-total // 40) <= sum(b.times for b in made) <= sum(b.times for b in packing._best_fit(counts, 40))


def _fewest(lengths, capacity):
    """The least number of sequences, by trying every one."""
    best = len(lengths)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(lengths):
            best = len(free)
            return
        for at in {f: i for i, f in enumerate(free) if f >= lengths[k]}.values():
            place(k + 1, [f - lengths[k] if i == at else f for i, f in enumerate(free)])
        place(k + 1, [*free, capacity - lengths[k]])

    place(0, [])
    return best


def test_plans_of_few_pieces_are_near_the_fewest_sequences():
    rng = random.Random(1)
    over = 0
    for _ in range(400):
        lengths = sorted((rng.randint(1, 40) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {x: lengths.count(x) for x in lengths}
        over += sum(b.times for b in packing.plan(counts, 40)) - _fewest(lengths, 40)
    assert 0 <= over <= 8


@pytest.mark.parametrize("shape", ["dense", "odd", "bell", "skewed", "lumpy"])
def test_plans_are_no_longer_than_best_fit(shape):
    rng = np.random.default_rng(0)
    counts = {
        "dense": {x: int(rng.integers(1, 1_000_000)) for x in range(1, 2049)},
        "odd": {x: int(rng.integers(1, 1_000_000)) for x in range(1, 2049, 2)},
        "bell": {x: n for x in range(1, 2049) if (n := int(1e6 * np.exp(-(((x - 600) / 200) ** 2) / 2)))},
        "skewed": {x: 10**7 // x + 1 for x in range(1, 2049)},
        "lumpy": {7: 400, 11: 900, 600: 50, 700: 80, 1348: 33, 2048: 5},
    }[shape]
    made = packing.plan(counts)
    placed = {}
    for b in made:
        for x, n in b.runs:
            placed[x] = placed.get(x, 0) + n * b.times
    assert placed == counts
    assert sum(b.times for b in made) <= sum(b.times for b in packing._best_fit(counts, 2048)) <= 1.02 * sum(x * n for x, n in counts.items()) / 2048 + 1


def test_complements_are_found_while_they_last():
    """Every lookup against all combinations, as availability falls."""
    rng = random.Random(2)
    for _ in range(60):
        counts = {x: rng.randint(1, 3) for x in rng.sample(range(1, 25), rng.randint(1, 10))}
        held = packing.Complements(counts, 24)
        for _ in range(40):
            total = rng.randint(1, 24)
            for k, found in enumerate((held.single(total), held.pair(total), held.triple(total)), 1):
                any_left = any(sum(c) == total and held.has(c) for c in itertools.combinations_with_replacement(sorted(counts), k))
                assert (found is not None) == any_left
                if found:
                    assert sum(found) == total and len(found) == k and held.has(found)
            spent = rng.choice(sorted(counts))
            held.left[spent] = max(0, held.left[spent] - 1)


def test_pack_gives_every_piece_one_place(spark):
    rows = [(i % 40, "word " * (i * 7 % 90)) for i in range(300)] + [(None, "same text")] * 200 + [(5, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = packing.pack(df, WORD, 64).collect()
    want = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packing.pieces(df, WORD, 64).collect())
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by, counts = {}, {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        counts[r.length] = counts.get(r.length, 0) + 1
    assert all(sum(n for _, n in parts[:k]) == at for parts in map(sorted, by.values()) for k, (at, _) in enumerate(parts))
    assert max(sum(n for _, n in parts) for parts in by.values()) <= 64
    assert len(by) == sum(b.times for b in packing.plan(counts, 64))


def test_documents_pack_within_a_hundredth_of_the_bound(texts):
    counts = {}
    for data in packing.load_encoder(WORD).encode(texts * 3):
        left = len(data) // 4 + 1
        while left > 0:
            counts[min(left, 2048)] = counts.get(min(left, 2048), 0) + 1
            left -= 2048
    bound = -(-sum(x * n for x, n in counts.items()) // 2048)
    assert sum(b.times for b in packing.plan(counts)) <= 1.01 * bound + 2


def test_exact_fillings_waste_nothing():
    made = packing.plan({30: 2, 10: 1, 6: 1, 4: 1, 20: 2, 13: 3, 1: 1}, 40)
    assert sum(b.times for b in made if b.free == 0) == 4 and sum(b.times for b in made) == 4


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts):
    assert [simhash.fingerprint(t) % (1 << 64) for t in texts] == [brute_fingerprint(t) for t in texts]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_keys_find_every_pair_within_two_bits():
    rng = random.Random(5)
    for _ in range(3_000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.choice([1, 2])):
            y ^= 1 << b
        a, b = (set(simhash.link_keys(np.array([signed(v)]))[0].tolist()) for v in (x, y))
        assert a & b
        kinds = {k >> 48 for k in a & b}
        assert any(signed(x ^ y) in simhash.probe_masks(k) for k in kinds)


@pytest.mark.parametrize("probe_from", [512, 3])
def test_links_equal_all_pairs(spark, monkeypatch, probe_from):
    monkeypatch.setattr(simhash, "PROBE_FROM", probe_from)
    rng = random.Random(1)
    fps = {0}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            y = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                y ^= 1 << b
            fps.add(y)
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2}
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    assert got == want


def test_near_duplicates_equal_brute_force(spark):
    rows = simhash.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    ids, fps = [r.doc_id for r in rows], [int(r.fingerprint, 16) for r in rows]
    root = dict.fromkeys(ids)
    for i in sorted(ids):
        if root[i] is None:
            todo = [i]
            while todo:
                j = todo.pop()
                if root[j] is None:
                    root[j] = i
                    todo += [k for k, f in zip(ids, fps) if root[k] is None and (f ^ fps[ids.index(j)]).bit_count() <= 2]
    assert {r.doc_id: r.component_id for r in rows} == root


def test_representatives_are_chosen_by_row(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("red blue green old new big odd far".split()) + str(rng.randint(0, 30)) for _ in range(30)) for _ in range(12)]
    rows = [(rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(texts)) for _ in range(80)] + [(0, "A b c d"), (1, "A b c d"), (1, "B x y z"), (None, "p q r"), (None, "s t u"), (None, "v w x"), (7, None), (8, ""), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n": F.lit(1), "fp": F.lit(2), "text_key": F.lit(3)})
    kept = simhash.keep_representatives(df).collect()
    assert all((r.n, r.fp, r.text_key) == (1, 2, 3) for r in kept)
    fps = {t: simhash.fingerprint(t) % (1 << 64) for _, t in rows}
    distinct = sorted(set(fps.values()))
    group = {f: f for f in distinct}
    for _ in distinct:
        for a, b in itertools.combinations(distinct, 2):
            if (a ^ b).bit_count() <= 2:
                group[a] = group[b] = min(group[a], group[b])
    least = {}
    for i, t in rows:
        least.setdefault(group[fps[t]], []).append((i is None, i or 0))
    got = {}
    for r in kept:
        got.setdefault(group[fps[r.text]], []).append((r.doc_id is None, r.doc_id or 0))
    assert got == {g: [min(ids)] for g, ids in least.items()}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (200, 201), (5, None)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_repeat_words_of_overlapping_and_repeated_windows(spark):
    words = "a b c d e f g h".split()
    cases = {1: " ".join(words * 2), 2: " ".join(words), 3: "x " * 9, 4: " ".join([*words, "z", *words[1:], "q"]), 5: "x " * 8, 6: " ".join([*words, "i", "k", *words, "i"])}
    df = spark.createDataFrame(list(cases.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.apply_rules(df).collect()} == {1: 16, 2: 0, 3: 9, 4: 0, 5: 0, 6: 18}


def test_line_dedup_keeps_first_runs(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, f"a\nb\nc\n{long}"), (2, f"x\n{long}\ny"), (3, "a\nb"), (4, "z\nb\n\nc\nw"), (5, "a"), (6, "q\nq\nq\nq")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("x\ny", 1), 3: ("", 2), 4: ("z\n\nw", 2), 5: ("a", 0), 6: ("q", 3)}


def _neighbours(spark, x, schema="vec_id bigint, vector array<double>"):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], schema)
    found = {}
    for r in sorted(nearest.search(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return found


def _recall(x, found):
    hits = 0
    for q, got in found.items():
        assert [g[0] for g in got] == list(range(1, 21)) and q not in {g[1] for g in got}
        assert all(abs(float(x[q] @ x[g[1]]) - g[2]) < 1e-9 for g in got)
        # Nearest first; equal scores in order of id, exactly.
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        scores = (x * x[q]).sum(1)
        hits += len({i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q and scores[i] >= np.sort(np.delete(scores, q))[-20]} & {g[1] for g in got})
    return hits / (20 * len(found))


@pytest.mark.parametrize("dimensions", [16, 64, 100])
def test_nearest_recall_and_scores(spark, dimensions):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3_000, dimensions)) * rng.uniform(0.5, 2, size=(3_000, 1)) + 2 * rng.standard_normal((30, dimensions))[rng.integers(30, size=3_000)]
    found = _neighbours(spark, x)
    assert len(found) == 150 and _recall(x, found) >= 0.95


def test_nearest_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 24))
    # Many equal rows, in no order of their ids, far beyond what one query can list.
    x[rng.permutation(900)[:300]] = x[7]
    x[rng.permutation(900)[:100]] = x[11]
    found = _neighbours(spark, x)
    for q, got in found.items():
        by_score = {}
        for _, i, score in got:
            by_score.setdefault(score, []).append(i)
        for ids in by_score.values():
            equal = [i for i in range(900) if i != q and (x[i] == x[ids[0]]).all()]
            assert ids == equal[: len(ids)]


def test_nearest_within_each_length(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8 if i % 3 else 5).tolist()) for i in range(600)] + [(1_000, [1.0, 2.0]), (1_020, [3.0, 1.0])]
    found = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id bigint, vector array<double>"), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    held = dict(rows)
    assert set(found) == {i for i in held if i % 20 == 0}
    assert all(len(held[i]) == len(held[q]) for q, got in found.items() for i, _ in got)
    assert found[1_000] == [(1_020, 5.0)] and found[1_020] == [(1_000, 5.0)]
    hits = 0
    for q, got in found.items():
        same = sorted(((-float(np.dot(held[q], v)), i) for i, v in held.items() if i != q and len(v) == len(held[q])))[:20]
        hits += len({i for _, i in same} & {i for i, _ in got}) / len(same)
    assert hits / len(found) >= 0.95


def test_abandoning_leaves_the_nearest():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2_000, 64))
    index = nearest.fit(x, 10, float(np.sqrt((x**2).sum(1).max())))
    lists, q = index.list_of(x), x[:40]
    kept = nearest.scan_block(index, np.arange(2_000), lists, x, q, [np.arange(10)] * 40, np.full(40, np.inf), 21)
    hits = sum(len(set(kept.ids[kept.query == k].tolist()) & set(np.argsort(-(x @ q[k]))[:21].tolist())) for k in range(40))
    assert hits / (40 * 21) >= 0.97
    # Most candidates are abandoned before all columns are read.
    turned = index.extend(x) @ index.rotation
    i, _, _ = nearest._survivors(turned, (np.column_stack([q, np.zeros(40)]) @ index.rotation), kept.bounds, np.full(40, 1e-9), 65)
    assert 40 * 20 <= len(i) <= 40 * 25


def test_blocks_hold_every_list():
    assert nearest._blocks({0: 4, 1: 5, 2: 3, 3: 35, 4: 1}, 10) == {0: (0, 1), 1: (0, 1), 2: (1, 1), 3: (2, 4), 4: (6, 1)}


def test_licence_scan_equals_the_model_paragraph_by_paragraph(spark):
    model = license_model.train()
    body = [(i, t) for i, t in enumerate([*(n for f in license_model.TEMPLATES.values() for n in f), *license_model.OTHER, "Erth the anea.\nReleased under the MIT License.\n\nx", "Licensed under the Artistic License 2.0."])]

    def predict(line):
        z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in license_model.grams(license_model.tokens(line)) if g in model.weights), np.zeros(len(model.bias)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family = model.classes[int(p.argmax())]
        return family if family == license_model.NONE or p.max() >= model.limits[family] else license_scan.UNKNOWN, float(p.max())

    want = {(i, k): predict(line) for i, t in body for k, line in enumerate(t.split("\n")) if line.strip()}
    want = {k: v for k, v in want.items() if v[0] != license_model.NONE}
    got = {(r.doc_id, r.paragraph): (r.family, r.probability) for r in license_scan.scan(spark.createDataFrame(body, "doc_id bigint, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-4 for k in got)


def test_licence_model_tells_families_from_other_sentences():
    model = license_model.train()
    right = total = 0
    for family, notices in license_model.TEMPLATES.items():
        for n in notices:
            z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in license_model.grams(license_model.tokens(f"indeed {n} thus")) if g in model.weights), np.zeros(len(model.bias)))
            right, total = right + (model.classes[int(z.argmax())] == family), total + 1
    assert right >= 0.95 * total
    assert all(set(g.split()) - license_model.STOP for g in model.weights)


def test_line_dedup_deletes_lone_short_lines(spark):
    rows = [(1, "u\nall rights kept\nv"), (2, "w\nall rights kept"), (3, "one two\nHome\nthree four"), (4, "five six\nHome"), (5, "Home"), (6, "Home\nseven eight"), (6, "Home\nseven eight"), (7, "rare\nnine ten"), (8, "eleven\nrare"), (8, "eleven\nrare"), (8, "eleven\nrare"), (9, "all rights kept\nnow\nall rights kept")]
    got = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {(1, rows[0][1], 0), (2, "w", 1), (3, rows[2][1], 0), (4, "five six", 1), (5, "", 1), (6, "seven eight", 1), (7, rows[7][1], 0), (8, rows[8][1], 0), (9, "now", 2)}
    assert got == want


def worded_pieces(text):
    """(line, k, piece, body, size, weight) of a text's units, and the pieces of each line."""
    lines = [re.findall(line_dedup._SENTENCE, x) for x in text.split("\n")]
    units = []
    for n, pieces in enumerate(lines):
        for k, piece in enumerate(pieces):
            if re.search(r"[^\x20\x09-\x0D]", piece):
                body = piece.strip(" \t\n\v\f\r")
                size = min(line_dedup.ENOUGH, len(body))
                units.append((n, k, piece, body, size, max(size, line_dedup.LEAST // 2) if len(pieces) == 1 else size))
    return units, lines


def brute_line_dedup(rows, winnow=True):
    """Selected units, deleted units and kept texts by plain lists: rows (doc_id, text); the same rules, without hashes but for the order of a window's units."""
    docs = sorted({((-(1 << 63) if i is None else i), t or "") for i, t in rows}, key=lambda d: (d[0], text_key(d[1])))
    units, lines = zip(*(worded_pieces(t) for _, t in docs), strict=True) if docs else ((), ())
    order = lambda d, i: (-units[d][i][4], hashlib.md5(units[d][i][3].encode()).hexdigest()[:14], -i)
    marks = []
    for d, own in enumerate(units):
        chosen = {min(range(s, min(len(own), s + line_dedup.WINDOW)), key=lambda i, d=d: order(d, i)) for s in range(max(1, len(own) - line_dedup.WINDOW + 1))} if own and winnow else set()
        marks += [(d, i) for i in sorted(chosen)]
    body = lambda d, i: units[d][i][3] if 0 <= i < len(units[d]) else None
    first, last, gone, done = {}, {}, set(), set()
    for d, i in marks:
        at = last.get((d, body(d, i)), first.setdefault(body(d, i), (d, i)))
        last[d, body(d, i)] = (d, i)
        if at == (d, i):
            continue
        e, j = at
        if (d, i, e, i - j) in done:
            continue
        low = high = 0
        while i + low > 0 and j + low > 0 and body(d, i + low - 1) == body(e, j + low - 1):
            low -= 1
        while body(d, i + high + 1) is not None and body(d, i + high + 1) == body(e, j + high + 1):
            high += 1
        run = range(i + low, i + high + 1)
        done |= {(d, k, e, i - j) for k in run}
        if sum(units[d][k][5] for k in run) >= line_dedup.LEAST:
            gone |= {(d, k) for k in run}
    places = {}
    for d, (_, t) in enumerate(docs):
        for n, x in enumerate(t.split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", x):
                places.setdefault(x, []).append((d, n))
    lone = {p for x, at in places.items() if len(at) >= (line_dedup.COMMON if len(x.split()) == 1 else 2) for p in at[1:]}
    kept = {}
    for d, (i, t) in enumerate(docs):
        drop = {u[:2] for k, u in enumerate(units[d]) if (d, k) in gone or (d, u[0]) in lone}
        out, of_line = [], {}
        for u in units[d]:
            of_line.setdefault(u[0], set()).add(u[:2])
        for n, x in enumerate(t.split("\n")):
            own = of_line.get(n, set())
            if not own or own - drop:
                out.append("".join(p for k, p in enumerate(lines[d][n]) if (n, k) not in drop) if own & drop else x)
        kept[i, t] = "\n".join(out)
    return marks, gone, kept


def text_key(text):
    return signed(xxhash.xxh64_intdigest(text.encode(), 42))


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "b", "c", "d", "one two", "three four five", "six seven", "x y z", " padded  line ", "Ünder wörd"] + [f"own {k}" for k in range(60)]
    rows = []
    for k in range(60):
        lines = [rng.choice(pool[:10] if rng.random() < 0.6 else pool) for _ in range(rng.randint(0, 9))]
        rows.append((rng.choice([None, k, k, k, k % 7]), "\n".join(x if rng.random() > 0.05 else "" for x in lines)))
    told = [" ".join(rng.choice(["sun", "moon", "sea", "hill", "tree"]) for _ in range(rng.randint(2, 14))) + rng.choice([".", "!", "? ", ""]) for _ in range(25)]
    for k in range(60, 110):
        at = rng.randrange(20)
        own = [rng.choice(told) for _ in range(rng.randint(0, 3))]
        rows.append((k, rng.choice(["\n", " "]).join(own + told[at : at + rng.randint(1, 5)]) + rng.choice(["", "\nq", " ...", "\n\n"])))
    rows += rows[:5] + [(3, None), (None, None), (200, "A b. " * 40), (201, "x\n" * 50), (202, "A b. " * 40 + "C d.")]
    marks, gone, kept = brute_line_dedup(rows)
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    want = [(i, None if t is None else kept[-(1 << 63) if i is None else i, t]) for i, t in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_winnowing_selects_fewer_units_and_decides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    hashed = line_dedup.hashed_units(docs).cache()
    total = hashed.agg(F.sum(F.size("units"))).first()[0]
    marks = line_dedup.fingerprints(line_dedup.selected(hashed)).collect()
    assert 0.3 * total < len(marks) < 0.75 * total
    # Every window of the size holds a fingerprint.
    sizes = {(r.doc, r.key): r.n for r in hashed.select("doc", "key", F.size("units").alias("n")).collect()}
    at = {}
    for r in marks:
        at.setdefault((r.doc, r.key), []).append(r.i)
    for doc, n in sizes.items():
        assert max(b - a for a, b in itertools.pairwise([-1, *sorted(at[doc]), n])) <= line_dedup.WINDOW
    matched = {(r.doc, r.key, i) for r in line_dedup.later_runs(hashed).collect() for i in range(r.lo, r.hi + 1)}
    assert len(matched - {(d, k, i) for (d, k), ids in at.items() for i in ids}) > 0
    # Without fingerprints, passages inside longer lines stay: lines of many words change.
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept, by_lines = (brute_line_dedup(rows, winnow)[2] for winnow in (True, False))
    differing = [d for d in kept if kept[d] != by_lines[d]]
    assert len(differing) > 20 and sum(len(by_lines[d].split()) - len(kept[d].split()) for d in differing) > 1_000


@pytest.mark.parametrize("reach", [1, 8])
def test_runs_are_extended_without_end(spark, reach, monkeypatch):
    """Fingerprints of a long run that stand elsewhere before, alone: one match must cover the whole run."""
    monkeypatch.setattr(line_dedup, "REACH", reach)
    rng = random.Random(5)
    told = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(12)) + "." for _ in range(120)]
    passage = " ".join(told)
    hashed = line_dedup.hashed_units(spark.createDataFrame([(9, passage)], "doc_id bigint, text string"))
    chosen = sorted(r.i for r in line_dedup.fingerprints(line_dedup.selected(hashed)).collect())
    alone = [(k, f"own words {k}. {told[i]} more words {k}.") for k, i in enumerate(chosen) if i != chosen[len(chosen) // 2]]
    rows = [*alone, (1_000, f"Front {passage}"), (1_001, f"Another front. {passage} Another end.")]
    got = {r.doc_id: (r.text, r.n_removed, r.n_shortened) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1_001][0].split() == "Another front. Another end.".split() or got[1_001][0].split()[:2] == ["Another", "front."]
    assert len(got[1_001][0].split()) <= 2 * 12 + 4 and got[1_001][1:] == (0, 1)


def test_a_run_of_one_word_lines_goes_by_extension_alone(spark):
    rows = [(1, "alpha\nbeta gamma\ndelta"), (2, "x y\nalpha\nbeta gamma\ndelta\nz z")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: "x y\nz z"}


def test_licences_held_out_whole_set_the_limits():
    truth, chances = map(np.concatenate, zip(license_model.held_out_chances(), license_model.unknown_chances(), strict=True))
    model = license_model.train()
    assert license_model.limits(truth, chances) == model.limits and len(set(model.limits.values())) > 4
    # Of a licence that no template has, few paragraphs are taken for another family.
    truth, chances = license_model.unknown_chances()
    limit = np.array([model.limits.get(c, 2.0) for c in license_model.CLASSES])
    licence, best = truth < len(model.limits), chances.argmax(1)
    assert (licence & (chances.max(1) >= limit[best])).sum() <= 0.25 * licence.sum()
    # And no sentence that grants nothing.
    assert not (~licence & (chances.max(1) >= limit[best])).any()


#: Sentences of notices that the templates don't hold, and others that share phrases with them.
FOREIGN_NOTICES = [
    "You may obtain a copy of the report at the office, subject to the following conditions.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Use of this software is governed by the Business Source License included in the LICENSE file.",
    "All rights and duties of the members are listed in the rules of the club.",
    "The above notice and this list of names shall be read out in the hall before the vote.",
]


def test_what_only_shares_phrases_is_not_confirmed(spark, monkeypatch):
    """Whatever its family is taken for, and were there no limits, a template must be met to confirm it."""
    model = license_model.train()
    open_ = license_model.LicenseModel(model.classes, model.bias, model.weights, dict.fromkeys(model.limits, 0.0))
    bodies = FOREIGN_NOTICES + list(license_model.OTHER)
    found = license_scan.scan(spark.createDataFrame(list(enumerate(bodies)), "doc_id bigint, text string"), open_)
    assert [bodies[r.doc_id] for r in found.where("confirmed").collect()] == []
    whole = [n for notices in license_model.TEMPLATES.values() for n in notices]
    known = license_scan.scan(spark.createDataFrame(list(enumerate(whole)), "doc_id bigint, text string"), open_).collect()
    assert sum(r.confirmed and r.similarity == 1.0 for r in known) >= 0.95 * len(whole)


def test_similarity_and_confirmation_equal_a_plain_version(spark):
    model = license_model.train()
    bodies = [n[:80] for f in license_model.TEMPLATES.values() for n in f] + ["we think " + n + " and so on" for f in license_model.TEMPLATES.values() for n in f[:2]]
    found = license_scan.scan(spark.createDataFrame(list(enumerate(bodies)), "doc_id bigint, text string"))
    for r in found.where("family <> 'unknown'").collect():
        own = license_model.tokens(bodies[r.doc_id])
        pairs = {f"{a} {b}" for a, b in zip(own, own[1:])}
        templates = [{g for g in license_model.grams(license_model.tokens(t)) if " " in g} for t in license_model.TEMPLATES[r.family]]
        shares = [max(len(pairs & t) / len(t), len(pairs & t) / (len(own) - 1) if len(own) > license_scan.CUT_PAIRS else 0) for t in templates if t]
        want = min(1.0, max(shares))
        assert abs(r.similarity - want) < 1e-6 and r.confirmed == (want >= license_scan.CONFIRM)
