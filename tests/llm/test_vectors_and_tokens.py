"""Exact search, whitening and tokenizer alignment against brute force."""

import hashlib
import json
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import crossalign, maxscore, queries, whitening

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAN, INF = float("nan"), float("inf")


def scaled(v, scale=256):
    return tuple(int(np.floor(float(c) * scale)) for c in v)


def best(rows, asks, k):
    """Lists of each asking row, by all pairs. rows: distinct (vec_id, x)."""
    out = []
    for i, x in rows:
        if i % asks == 0:
            others = [(j, y) for j, y in rows if (j, y) != (i, x) and len(y) == len(x)]
            found = sorted(((sum(a * b for a, b in zip(x, y, strict=True)), -j) for j, y in others), reverse=True)[:k]
            out += [(i, n + 1, -j, s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def found_by(df, asks, k=5):
    return sorted(tuple(r) for r in maxscore.search(df, F.col("vec_id") % asks == 0, k).collect())


@pytest.mark.parametrize("kind", ["dense", "sparse", "small", "long"])
def test_search_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((600, 7))
    if kind == "sparse":
        v *= rng.random(v.shape) < 0.2
    if kind == "small":
        v = rng.integers(-1, 2, v.shape) / 256
    if kind == "long":
        v *= 2e5
    rows = [(int(i), [float(c) for c in x]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>")
    assert found_by(df, 50) == best([(i, scaled(x)) for i, x in rows], 50, 5)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 5), st.integers(0, 3), st.integers(0, 1_000))
def test_a_shard_gives_all_that_reach_the_threshold(n, d, spread, seed):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-spread, spread + 1, (n, d)), rng.integers(-spread, spread + 1, (3, d))
    ids = rng.permutation(n)
    scores = q @ x.T
    keep = 4
    for threshold in (-np.inf, 0.0, float(np.median(scores))):
        which, at, found = maxscore.search_shard(ids, x, q, np.full(3, threshold), keep)
        for k in range(3):
            want = sorted((-scores[k, i], ids[i], i) for i in range(n) if scores[k, i] >= threshold)[:keep]
            assert [(-s, i) for s, _, i in want] == list(zip(found[which == k].tolist(), at[which == k].tolist(), strict=True))


def test_search_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [NAN, 1.0]), (4, [1.0, INF]), (5, [1.0, None]), (None, [1.0, 0.0]), (6, [0.0, 0.0]),
        (100, [1.0]), (150, []), (7, []), (8, [1e300, 1.0]), (200, [-1.0, 0.25]), (200, [0.0, 1.0]), (9, [-1.0, -1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>").withColumns({c: F.lit(7) for c in ("same", "d", "shard", "block", "score", "n")})
    usable = {(i, scaled(v)) for i, v in rows if i is not None and v is not None and i != 8 and all(c is not None and np.isfinite(c) for c in v)}
    assert found_by(df, 50) == best(sorted(usable), 50, 5)
    assert found_by(spark.createDataFrame([(0, None)], "vec_id bigint, vector array<double>"), 50) == []
    assert found_by(spark.createDataFrame([(0, [1.0])], "vec_id bigint, vector array<double>"), 50) == []


def test_search_of_very_many_copies(spark):
    rows = [(i, [1.0, 0.5]) for i in range(500)] + [(i, [0.5, 1.0 + i / 256]) for i in range(500, 520)]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<float>")
    assert found_by(df, 50) == best([(i, scaled(x)) for i, x in rows], 50, 5)


def whitened_plainly(rows):
    """n, sums, covariance as fractions, and what each row gives."""
    distinct = sorted({x for _, x in rows})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(x[i] for x in distinct) for i in range(d)]
    v = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in distinct), n**3) for j in range(d)] for i in range(d)]
    return n, sums, np.array([[float(c) for c in r] for r in v])


@pytest.mark.parametrize("size", [1, 1_000_000_000])
def test_whitening_equals_a_plain_version(spark, size):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((120, 20)) @ rng.standard_normal((20, 20)) * size
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (500, rows[2][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>")
    whole = [(i, tuple(int(np.floor(64 * c)) + 1_000_000 for c in x)) for i, x in rows]
    n, sums, cov = whitened_plainly(whole)
    e = np.sort(np.linalg.eigvalsh(cov))[::-1]
    found = whitening.whiten(df).toPandas()
    assert len(found) == 16 * len(rows) and set(found.n) == {n} and found.identity_error.max() < 1e-6
    by = {k: g.sort_values("component") for k, g in found[found.vec_id < 120].drop_duplicates(["vec_id", "component"]).groupby("vec_id")}
    w = np.array([by[i].whitened.to_numpy() for i in range(120)])
    np.testing.assert_allclose(by[0].explained, e[:16] / np.trace(cov), rtol=1e-9)
    centred = np.array([[float(Fraction(c * n - s, n)) for c, s in zip(x, sums, strict=True)] for _, x in whole[:120]])
    direct = np.linalg.lstsq(centred, w, rcond=None)[0] * np.sqrt(e[:16])
    np.testing.assert_allclose(cov @ direct, direct * e[:16], rtol=0, atol=1e-7 * e[0])
    np.testing.assert_allclose(direct.T @ direct, np.eye(16), atol=1e-7)
    want = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in whole[:120]}
    assert {r.vec_id: r.deviation for r in found[found.vec_id < 120].itertuples()} == {i: s if s < 1 << 63 else None for i, s in want.items()} or size > 1
    if size > 1:
        assert found.deviation.isna().all()


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [0.0, 5.0]), (4, None), (5, [NAN, 1.0]), (6, [1.0, INF]), (7, [1.0, None]), (8, []), (9, [2.0]), (10, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>").withColumns({c: F.lit(7) for c in ("x", "d", "cell", "total", "n", "component")})
    found = whitening.whiten(df).collect()
    assert sorted((r.vec_id, r.component) for r in found) == [(i, k) for i in (1, 2, 3) for k in (1, 2)] and {r.n for r in found} == {3}
    for odd in ([(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(odd, "vec_id bigint, vector array<double>")).collect() == []


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, sums, _ = whitened_plainly([(r.vec_id, scaled(r.embedding, 64)) for r in rows])
    found = queries.QUERIES["op12_whitening"](spark, SMALL).collect()
    assert len(found) == 16 * len(rows) and {r.n for r in found} == {n} and found[0].identity_error < 1e-9
    want = {r.vec_id: sum((n * c - s) ** 2 for c, s in zip(scaled(r.embedding, 64), sums, strict=True)) for r in rows}
    assert {r.vec_id: r.deviation for r in found} == want


A, B = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
A.encode_special_tokens = True
VISIBLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTES = {chr(b): b for b in VISIBLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}


def spans(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def linked(text):
    """Spans of both tokenizers' tokens, or None."""
    if not text:
        return None
    a = [(i, bytes(BYTES[c] for c in A.id_to_token(i))) for i in A.encode(f" {text}", add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[1:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    whole = f" {text}".encode()
    return (spans(a), spans(b)) if all(b"".join(d for _, d in t) == whole for t in (a, b)) else None


def aligned_plainly(texts):
    known = [linked(t) for t in texts]
    links = [[] if k is None else [(i, j) for i, s, e in k[0] for j, u, v in k[1] if s < v and u < e] for k in known]
    counts = Counter(p for each in links for p in each)
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    for k, each in zip(known, links, strict=True):
        if k is None:
            yield 0, 0, 0, 0, 0, 0, ""
            continue
        both = sorted({e for _, _, e in k[0]} & {e for _, _, e in k[1]})
        groups = [tuple(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in k) for low, high in zip([0, *both], both, strict=False)]
        text = ";".join(f"{a}|{b}" for a, b in groups)
        yield len(k[0]), len(k[1]), len(both), len(each), sum(counts[p] == most[p[1]] for p in each), sum(counts[p] for p in each), hashlib.sha256(text.encode()).hexdigest()


ODD = [
    None, "", "a", "don't  stop\n\n x's 12²½", "日本語テスト café é", "x<|endoftext|>y <s> </s> <unk> <0x41>", "a" * 3_000, "!?" * 700, " " * 1_200 + "z", "z" + " " * 20, "\x1c\x85 \xa0  x", "тест ١٢٣", "😀😀 hi",
    " ", "  ", "x ▁ y", "a\x00b", "é ﬁ ①", "a\tb\r\n", "again and again", "again and again", "again and again",
]


def measures(rows):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)


def test_alignment_equals_a_plain_version(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(30).collect()] + ODD
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumns({c: F.lit(7) for c in ("key", "_key", "block", "weight", "n_a", "pair")})
    got = measures(crossalign.align_tokenizers(df, BYTE, PIECE).collect())
    want = sorted((str(i if i % 7 else None), *m) for i, m in enumerate(aligned_plainly(texts)))
    assert got == want
    monkeypatch.setattr(crossalign, "BLOCK_TEXTS", 3)
    assert measures(crossalign.align_tokenizers(df, BYTE, PIECE).collect()) == want
    assert crossalign.align_tokenizers(df.limit(0), BYTE, PIECE).collect() == []
    nothing = crossalign.align_tokenizers(spark.createDataFrame([(1, None), (1, "")], "doc_id bigint, text string"), BYTE, PIECE).collect()
    assert [tuple(r) for r in nothing] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


ALIGN = crossalign.aligner(BYTE, PIECE)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab cdé1'\n!ʯ世<s>▁ ", max_size=50))
def test_any_text_aligns_as_plainly(text):
    n_a, n_b, n_groups, n_links, digest, pairs, links = ALIGN(text)
    want = next(iter(aligned_plainly([text])))
    assert (n_a, n_b, n_groups, n_links, digest) == (*want[:4], want[6]) and links.sum() == n_links and len(set(pairs.tolist())) == len(pairs)


def test_long_runs_align_in_bounded_time():
    for text in ("a" * 400_000, " " * 400_000, "ab" * 200_000 + " x"):
        n_a, n_b, _, n_links, *_ = ALIGN(text)
        assert n_links >= max(n_a, n_b) > 0


def test_merges_and_ranks_agree():
    vocabulary = crossalign.ByteLevel(BYTE)
    strings = [t for t in json.load(open(BYTE, encoding="utf-8"))["model"]["vocab"] if all(c in BYTES for c in t)]
    for t in strings[::7]:
        data = bytes(BYTES[c] for c in t)
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        assert vocabulary.library.encode_ordinary(f" {text}") == A.encode(f" {text}", add_special_tokens=False).ids
