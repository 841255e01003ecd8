"""The whole pipeline against a plain version of its five stages."""

import itertools
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from conftest import SMALL
from pyspark.sql import functions as F
from test_exact import brute_line_dedup, text_key
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import language_id, simhash, toxicity
from spanloom.llm.common import held_out

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    plain = max(rows, key=lambda r: len((r[1] or "")[:3_000]))[1][:3_000].replace("\n", " ")
    added = [
        (9_000, plain, "en", "a", None), (9_001, plain, "en", "b", None), (9_002, plain + " x", "en", "b", None), (None, "the house on the hill is old\nand grey", "en", "a", 1),
        (None, "a boat in the bay is new\nand blue", "en", "a", 1), (9_003, "the first line of two\nshared line of words\nanother", "en", "a", 1), (9_004, "shared line of words", "en", "a", 1),
        (9_003, "a wholly other text under a repeated id", "en", "a", 1), (9_005, None, "en", "a", 0), (9_006, "1 2 3 !", "en", "a", 7), (9_007, "", None, None, 0), rows[3], rows[3],
    ]
    spark.createDataFrame(rows + added, DOCUMENTS).coalesce(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return at


def plain_stages(spark, folder):
    """Rows (doc_id, text) after each stage but the last, each decided one by one."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    profiles = language_id.train(docs, ~held_out(F.col("doc_id")))
    rows = [(r.doc_id, r.text) for r in docs.collect() if profiles.predict(r.text)[0] != "und"]
    yield "language_id", rows
    held = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(held, spark.read.parquet(f"{folder}/labels.parquet"), ~held_out(F.col("doc_id")))
    rows = [(i, t) for i, t in rows if float(model.score([t])[0]) < toxicity.THRESHOLD]
    yield "toxicity", rows
    _, _, kept = brute_line_dedup(rows)
    least = -(1 << 63)
    after = [(i, t, kept[least if i is None else i, t]) for i, t in rows]
    rows = [(i, new) for i, old, new in after if new == old or re.search(r"[^\x20\x09-\x0D]", new)]
    yield "line_dedup", rows
    fps = {t: simhash.fingerprint(t) % (1 << 64) for _, t in rows}
    group = {f: f for f in fps.values()}
    for _ in group:
        changed = False
        for a, b in itertools.combinations(list(group), 2):
            if (a ^ b).bit_count() <= 2 and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
        if not changed:
            break
    best = {}
    for i, t in rows:
        key = (i is None, i or 0, text_key(t))
        best[group[fps[t]]] = min(best.get(group[fps[t]], (key, i, t)), (key, i, t), key=lambda x: x[0])
    yield "simhash_near_dedup", [(i, t) for _, i, t in best.values()]


def test_every_stage_and_the_whole_run_equal_the_plain_version(spark, folder):
    plain = dict(plain_stages(spark, folder))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = [tuple(r) for r in out.collect()]
        assert sorted((str(r[0]), r[1]) for r in rows) == sorted((str(i), t) for i, t in plain[name]), name
        docs = spark.createDataFrame(rows, DOCUMENTS)
    kept = plain["simhash_near_dedup"]
    # What was planted: copies under other ids go, texts under shared or missing ids stay.
    ids = [i for i, _ in kept]
    assert ids.count(None) == 2 and 9_000 in ids and not {9_001, 9_002, 9_004, 9_005, 9_006, 9_007} & set(ids)
    assert ids.count(9_003) == 2
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in kept:
        data = [*library.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(data), 2048)):
            part = data[at : at + 2048]
            want.append((str(i), k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    filled = {}
    for r in got:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= 1.02 * sum(filled.values()) / 2048 + 1
