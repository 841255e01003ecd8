"""Trained operators on rows that they didn't learn from."""

import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import boosting, language_id, queries, toxicity
from spanloom.llm.common import held_out

FOLDER = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    found = queries.QUERIES["op3_language_id"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97 and all(0 <= r.score <= 1 for r in found)


def test_toxicity_on_held_out_documents(spark):
    found = queries.QUERIES["op5_toxicity"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in found if r.toxic]
    assert np.mean([r.predicted for r in toxic]) >= 0.5
    assert np.mean([r.predicted for r in found if not r.toxic]) <= 0.05
    assert all(r.predicted == int(r.score >= 0.3) for r in found)


def test_language_ignores_labels_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    rows = lambda d: sorted(map(tuple, language_id.train_and_identify(d).collect()))
    assert rows(docs) == rows(spoiled)


def test_boosting_learns_and_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2_000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    model = boosting.fit(x[:1_500], y[:1_500])
    raw = model.raw(x[1_500:])
    assert np.mean((raw > 0) == y[1_500:]) > 0.95
    xs, ys = boosting.isotonic(raw, y[1_500:])
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and ys[0] < 0.2 < 0.8 < ys[-1]
    assert boosting.fit(x[:50], np.zeros(50)).raw(x[:2]).tolist() == [boosting.fit(x[:50], np.zeros(50)).prior] * 2


def test_features_see_disguise_and_nearness():
    f = lambda t, lexicon=frozenset(): dict(zip(toxicity.FEATURES, toxicity.features(t, lexicon)))
    assert f("you are an idiot")["abuse_near_second_person"] == 1 and f("you " + "and so on " * 5 + "idiot")["abuse_near_second_person"] == 0
    assert f("what an 1d1ot you @sshole")["disguised_abuse"] >= 1 and f("an i d i o t here")["spaced_out"] == 1
    assert f("grumblekin here", frozenset({"grum-"}))["learned"] == 1 and f("")["words"] == 0 and f(None) == f("")


def plain_grams(text):
    """n-grams of one to three letters by plain strings; word ends count as one blank."""
    kinds = lambda c: unicodedata.category(c)[0]
    if not any(kinds(c) == "L" for c in text.lower()):
        return Counter()
    words = "".join(c if kinds(c) in "LM" else " " for c in text.lower()).split()
    body = " " + " ".join(words) + " "
    n = Counter(c for c in body if c != " ")
    n.update(body[i : i + 2] for i in range(len(body) - 1))
    n.update(body[i : i + 3] for i in range(len(body) - 2) if body[i + 1] != " ")
    return n


def plain_rank(n, most):
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(g))
    return sorted(n, key=lambda g: (-n[g], code(g)))[:most]


def test_language_equals_plain_rank_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held")).collect()
    sums = {}
    for r in rows:
        if not r.held and r.text is not None and r.lang is not None:
            sums.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    profiles = {lang: {g: i for i, g in enumerate(plain_rank(n, language_id.PROFILE_GRAMS))} for lang, n in sums.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.train_and_identify(docs).collect()}
    length = language_id.PROFILE_GRAMS
    for r in rows[:300]:
        grams = plain_rank(plain_grams(r.text or ""), language_id.DOCUMENT_GRAMS)
        if not grams:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else length for i, g in enumerate(grams)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[r.doc_id][0] == best and abs(got[r.doc_id][1] - (1 - far[best] / (length * len(grams)))) < 1e-9


def test_many_language_values_and_marks_alone(spark):
    rows = [(i, f"word{chr(97 + i % 26)} text number", f"l{i:04d}") for i in range(1_400)] + [(5_000 + i, "the cat sat on the mat", "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language_id.train(docs, F.lit(True), most_languages=1_000)
    # The most frequent first, others by name.
    assert len(learned.languages) == 1_000 and "en" in learned.languages and "l0998" in learned.languages and "l0999" not in learned.languages
    assert learned.predict("the cat sat") [0] == "en"
    assert learned.predict("\u0301\u0302") == ("und", 0.0) and learned.predict("e\u0301")[0] != "und"


def test_lexicon_equals_plain_counts(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic is not null")
    sample = spark.read.parquet(f"{FOLDER}/documents.parquet").join(labels, "doc_id").select("text", "toxic").cache()
    rows = sample.collect()
    bad, good = sum(r.toxic == 1 for r in rows), sum(r.toxic == 0 for r in rows)
    n = {0: Counter(), 1: Counter()}
    for r in rows:
        n[r.toxic].update({t for w in toxicity._WORD.findall((r.text or "").lower()) for t in toxicity.terms(w)})
    rate = lambda t: (n[1][t] + 0.5) / (bad + 1) * (good + 1) / (n[0][t] + 0.5)
    marked = [t for t in n[1] if n[1][t] >= max(3, bad // 500) and rate(t) >= toxicity.LIKELIER and n[0][t] * 20 <= n[1][t]]
    assert toxicity.learn_lexicon(sample) == frozenset(sorted(marked, key=lambda t: (-n[1][t], t))[: toxicity.LEARNED_TERMS]) != frozenset()


def test_scores_equal_trees_walked_one_by_one(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, ~held_out(F.col("doc_id")))
    some = docs.limit(40).collect()
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    xs, ys = model.knots
    for r in some:
        values, odds = toxicity.features(r.text, model.lexicon), model.trees.prior
        for tree in model.trees.trees:
            node = 0
            while node < len(tree.feature):
                node = 2 * node + (2 if values[tree.feature[node]] > tree.threshold[node] else 1)
            odds += tree.value[node - len(tree.feature)]
        at = sum(x < odds for x in xs)
        if at == 0 or at == len(xs):
            want = ys[min(at, len(ys) - 1)]
        else:
            want = ys[at - 1] + (ys[at] - ys[at - 1]) * (odds - xs[at - 1]) / (xs[at] - xs[at - 1])
        assert abs(got[r.doc_id] - min(1.0, max(0.0, want))) < 1e-9


@pytest.mark.parametrize("mark", list("10.-!@$*'") + ["é", "\u0301", "a", " ", "\n"])
@pytest.mark.parametrize("end", ["", "x", "1"])
def test_long_runs_take_linear_time(mark, end):
    text = "a" + mark * 200_000 + end
    for work in (toxicity.features, language_id.gram_counts):
        work("warm up")
        begin = time.process_time()
        work(text)
        assert time.process_time() - begin < 1


@pytest.mark.parametrize("body", ["a ", "a1", "!a", "i d i o t "])
def test_runs_of_single_letters_take_linear_time(body):
    begin = time.process_time()
    toxicity.features((body * 4_000_000)[:4_000_000])
    assert time.process_time() - begin < 5


def test_words_spelled_in_single_letters():
    at = toxicity.FEATURES.index("spaced_out")
    cases = {"you i d i o t there": 1, "a b c d e": 0, "i d i o t and m o r o n": 2, "x i d i o t x": 1, "i d i": 0, "": 0}
    assert {t: toxicity.features(t)[at] for t in cases} == cases


@pytest.mark.parametrize("form", ["{a}lowei", "{a}lowei{b}"])
def test_abuse_known_by_the_end_or_the_inside_of_words(spark, form):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(["ba", "ne", "ti", "or", "sa", "mu", "ke"], 4))
    texts = [[word() for _ in range(60)] for _ in range(600)]
    # Every text has a word of this form and length; those with label 1 have the same five letters in it.
    for i, text in enumerate(texts):
        text[7] = form.format(a=word()[:5], b=word()[:5]).replace("lowei", "lowei" if i % 4 == 0 else "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    found = toxicity.train_and_score(docs, labels).where("held_out").collect()
    assert len(found) > 100 and all(r.predicted for r in found if r.doc_id % 4 == 0)
    assert np.mean([r.predicted for r in found if r.doc_id % 4]) <= 0.05


def test_learned_words_equal_their_terms_looked_up_one_by_one():
    rng = np.random.default_rng(6)
    some = lambda n: "".join(rng.choice(list("abcdeßéİΣ\U0001d400"), n))
    ends = [" ", "\n", "'", "3", "_", "̇", "-", "²", "\U0001f600"]
    at = [toxicity.FEATURES.index(f) for f in ("words", "learned", "distinct_learned", "mean_word")]
    for _ in range(200):
        texts = ["".join(some(int(rng.choice([1, 2, 4, 5, 6, 7, 9, 63, 64, 65, 70]))) + str(rng.choice(ends)) for _ in range(30)) for _ in range(2)]
        known = [t for w in toxicity._WORD.findall(texts[0].lower()) for t in toxicity.terms(w)]
        lexicon = frozenset(rng.choice(known, 12).tolist())
        for text in [*texts, "".join(texts)[3:-1], "", " ", "a", known[0]]:
            words = toxicity._WORD.findall(text.lower())
            learned = [w for w in words if not lexicon.isdisjoint(toxicity.terms(w))]
            values = toxicity.features(text, lexicon)
            assert [values[k] for k in at] == [len(words), len(learned), len(set(learned)), sum(map(len, words)) / max(1, len(words))]


def test_terms_are_spelled_out_only_where_a_piece_may_begin(monkeypatch):
    """Most words of a corpus are met once, so spelling out the pieces of each took more CPU than all other features."""
    rng = np.random.default_rng(7)
    text = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(5_000)) + " grumblekin"
    seen, terms = [], toxicity.terms
    monkeypatch.setattr(toxicity, "terms", lambda word: seen.append(word) or terms(word))
    found = toxicity.features(text, frozenset({"grum-", "-lekin", "-umble-", "lowei"}))
    assert found[toxicity.FEATURES.index("learned")] == 1 and "grumblekin" in seen and len(seen) < 100


def test_isotonic_keeps_apart_two_scores_of_which_the_higher_has_both_labels():
    score, y = np.repeat([-10.8, 8.6], [90, 11]), np.repeat([0, 1], [91, 10])
    xs, ys = boosting.isotonic(score, y)
    assert xs.tolist() == [-10.8, 8.6] and ys[0] < 0.05 and ys[1] > 0.8
    assert boosting.isotonic(np.zeros(0), np.zeros(0, dtype=int))[1].tolist() == [0.0]
