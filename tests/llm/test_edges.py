"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import bpe, language_id, license_scan, line_dedup, nearest, packing, quality_rules, simhash, token_counts, toxicity
from spanloom.llm.common import held_out

import public_tokenizers

BYTE, RANKS, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "Ünder the wéird sky & 42 birds sang. " * 9_000
ROWS = [
    (1, "the cat sat on the mat and it was good", "en", "a", 38), (1, "the cat sat on the mat and it was good", "en", "a", 38), (2, None, None, None, None), (3, "", "en", None, 0), (None, "le chat est sur la table et il dort", "fr", "b", None),
    (4, LONG, "en", "a", len(LONG)), (5, "\n \n\t\n", None, "a", 5), (6, "12345 !!! ...", "en", "a", 12), (None, None, None, None, None), (7, "日本語 と 한국어", None, "a", 10), (1, "another text under the same id", "en", "a", 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCUMENTS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, None), (None, 1, 1), (4, 1, 1), (6, 0, 1), (6, 0, 0)], "doc_id bigint, quality int, toxic int")


PER_ROW = {
    "tokens": lambda d: token_counts.count_tokens(d, BYTE),
    "bpe": lambda d: bpe.round_trip(d, RANKS),
    "rules": quality_rules.apply_rules,
    "language": language_id.train_and_identify,
    "lines": line_dedup.summary,
    "simhash": simhash.near_duplicates,
}
CLASH = ["fp", "key", "gone", "n_lines", "score", "rows", "kept_id", "clean", "lang_pred", "part", "n", "counts", "root", "list", "_key"]


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_per_row(docs, name):
    found = PER_ROW[name](docs).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table_gives_no_row(empty, name):
    assert PER_ROW[name](empty).collect() == []


@pytest.mark.parametrize("name", PER_ROW)
def test_other_columns_do_not_matter(docs, name):
    wide = docs.withColumns({c: F.lit(7) for c in CLASH})
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert plain(PER_ROW[name](wide)) == plain(PER_ROW[name](docs))


def test_repeated_rows_agree_and_nulls_count_as_empty(docs):
    rows = bpe.round_trip(docs, RANKS).where("doc_id = 1").collect()
    assert rows[0] == rows[1]
    null, blank = (token_counts.count_tokens(docs, BYTE).where(f"doc_id = {i}").first() for i in (2, 3))
    assert (null.n_bytes, null.n_tokens, null.over_limit) == (blank.n_bytes, blank.n_tokens, blank.over_limit) == (0, 0, False)
    assert all(r.exact for r in bpe.round_trip(docs, RANKS).collect())


def test_texts_without_letters_are_undetermined(docs):
    found = {r.doc_id: r for r in language_id.train_and_identify(docs).where("doc_id in (2, 3, 5, 6)").collect()}
    assert {r.lang_pred for r in found.values()} == {"und"} and {r.score for r in found.values()} == {0.0}


def test_wordless_texts_share_the_zero_fingerprint(docs):
    found = simhash.near_duplicates(docs).where("fingerprint = '0000000000000000'").collect()
    assert sorted(str(r.doc_id) for r in found) == ["2", "3", "5", "None"] and {r.component_id for r in found} == {2}


def test_toxicity(docs, empty, labels):
    model = toxicity.train(docs, labels, ~held_out(F.col("doc_id")))
    scores = [r.score for r in toxicity.score(docs, model).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert toxicity.train_and_score(empty, labels).collect() == []
    assert len(toxicity.train_and_score(docs, labels.limit(0)).collect()) == len(ROWS)
    wide = docs.withColumns({c: F.lit(7) for c in CLASH})
    assert set(wide.columns) == set(toxicity.keep_clean(wide, model, 2.0).columns) and toxicity.keep_clean(wide, model, 2.0).count() == len(ROWS)


def test_packing(docs, empty):
    assert packing.pack(empty, WORD).collect() == []
    rows = packing.pack(docs, WORD, 64).collect()
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert sorted(r.length for r in rows if r.doc_id in (2, 3, 5)) == [1, 1, 1]
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(docs.withColumns({c: F.lit(7) for c in CLASH}), WORD, 64).count() == len(rows)


def test_licence_scan(docs, empty, spark):
    assert license_scan.scan(docs).collect() == [] and license_scan.scan(empty).collect() == []
    some = spark.createDataFrame([(1, "x\nAll rights reserved."), (1, "x\nAll rights reserved."), (None, "Released under the MIT License."), (2, None)], "doc_id bigint, text string").withColumns({c: F.lit(7) for c in CLASH})
    assert sorted((str(r.doc_id), r.paragraph, r.family, r.confirmed) for r in license_scan.scan(some).collect()) == [("1", 1, "Proprietary", True), ("1", 1, "Proprietary", True), ("None", 0, "MIT", True)]


def test_nearest_ignores_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [1.0]), (7, [1.0, None]), (None, [1.0, 0.0]), (1, [0.9, 0.1]), (40, [0.0, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<double>").withColumns({c: F.lit(7) for c in CLASH})
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.9), (20, 1, 0, 1.0), (20, 2, 1, 0.9)]
    none = spark.createDataFrame([(1, None)], "vec_id bigint, vector array<double>")
    assert nearest.search(none, F.col("vec_id") % 20 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id bigint, vector array<double>")
    assert nearest.search(one, F.col("vec_id") % 20 == 0).collect() == []


def test_line_dedup_carries_columns(docs):
    wide = docs.withColumns({c: F.lit(7) for c in CLASH if c != "n_lines"})
    done = line_dedup.dedup_lines(wide)
    assert set(wide.columns) | {"n_lines", "n_removed", "n_shortened"} == set(done.columns) and done.count() == len(ROWS)


def test_stages_keep_the_columns_of_documents(spark, docs, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, empty):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == table.columns
            now = out
        assert now.columns[:2] == ["doc_id", "piece"]
        assert (now.count() == 0) == (table is empty)


def test_an_id_in_very_many_rows_is_one_row_of_the_sample(spark, labels, monkeypatch):
    """What reaches the driver for training is bounded by ids, however often one is repeated."""
    rows = spark.range(100_000).select(F.lit(4).cast("bigint").alias("doc_id"), F.concat(F.lit("some text "), F.col("id") % 50).alias("text"))
    docs = rows.unionByName(spark.createDataFrame([(1, "fine words"), (3, "good words")], "doc_id bigint, text string"))
    seen, kernel = [], toxicity.map_rows

    def counting(df, *more):
        seen.append(df.count())
        return kernel(df, *more)

    monkeypatch.setattr(toxicity, "map_rows", counting)
    toxicity.train(docs, spark.createDataFrame([(1, 0), (3, 0), (4, 1)], "doc_id bigint, toxic int"), F.lit(True))
    assert max(seen) <= 3


def test_an_id_with_several_vectors_is_several_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 0.5])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest.search(spark.createDataFrame(rows, "vec_id bigint, vector array<double>"), F.col("vec_id") % 20 == 0).collect())
    one, other = [(2, 2.0), (1, 1.0), (20, 0.0)], [(1, 1.0), (2, 0.5), (20, 0.0)]
    assert got == sorted((20, k + 1, i, s) for found in (one, other) for k, (i, s) in enumerate(found))
