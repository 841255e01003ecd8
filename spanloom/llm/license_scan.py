"""Licence scan: a trained paragraph classifier applied in built-in expressions only.

A paragraph is a line with a word. Paragraphs without any n-gram of the model have no feature and
so no licence; the others are scored, each distinct text once: its distinct words and word pairs meet
the sparse weights, the summed log-odds become chances, and the likeliest family is taken, of equally
likely ones the first in the order of the templates. Under the
family's calibrated limit the paragraph is `unknown`. Otherwise it is compared to the family's
templates one by one: it is confirmed if enough of one template's word pairs are in it, or, of a
paragraph long enough to be a cut of one, enough of its own are in that template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut
from spanloom.llm.license_model import STOP, TEMPLATES, TOKEN, LicenseModel, grams, tokens, train

UNKNOWN = "unknown"
#: Share of one template's word pairs, or of the paragraph's, that confirms a prediction; word pairs from which a paragraph may be a cut of a template.
CONFIRM, CUT_PAIRS = 0.65, 8
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(0))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (0-based line number) and body of every line with a word."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "body")).where(F.col("body").rlike(_HAS_WORD))


def classify(bodies: DataFrame, model: LicenseModel) -> DataFrame:
    """family, probability, similarity and confirmed of each distinct text in column body that has a feature and isn't `none`."""
    spark = bodies.sparkSession
    k = len(model.classes)
    families = model.classes[:-1]
    templates = [(f, pairs) for f in families for pairs in _template_pairs(f)]
    known = sorted(set(model.weights) | set().union(*(pairs for _, pairs in templates)))
    zeros = [0.0] * k
    rows = [(g, [float(x) for x in model.weights.get(g, zeros)], [int(g in pairs) for _, pairs in templates]) for g in known]
    # As many rows as the model has n-grams, which the templates bound.
    table = F.broadcast(spark.createDataFrame(rows, "gram string, weight array<double>, held array<int>"))
    words = bodies.select("body", _tokens(F.col("body")).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    parts = words.select("body", F.size("w").alias("n_words"), F.explode(F.array_distinct(F.concat("w", pairs))).alias("gram"))
    summed = parts.join(table, "gram").groupBy("body", "n_words").agg(*(F.sum(F.col("weight")[i]).alias(f"w{i}") for i in range(k)), *(F.sum(F.col("held")[i]).alias(f"h{i}") for i in range(len(templates))))
    odds = [F.col(f"w{i}") + F.lit(model.bias[i]) for i in range(k)]
    top = F.greatest(*odds)
    chances = F.transform(F.array(*odds), lambda z: F.exp(z - top))
    total = F.aggregate(chances, F.lit(0.0), lambda a, x: a + x)
    scored = summed.select("body", "n_words", F.array(*(F.array_max(F.array(*(_likeness(F.col(f"h{i}"), len(pairs)) for i, (family, pairs) in enumerate(templates) if family == f))) for f in families)).alias("likeness"), (F.array_max(chances) / total).alias("probability"), (F.array_position(chances, F.array_max(chances)) - 1).cast("int").alias("best"))
    scored = scored.where(F.col("best") < k - 1)
    name = F.array(*(F.lit(f) for f in families))[F.col("best")]
    limit = F.array(*(F.lit(model.limits[f]) for f in families))[F.col("best")]
    similarity = F.get("likeness", F.col("best"))
    sure = F.col("probability") >= limit
    return scored.select(
        "body",
        F.when(sure, name).otherwise(UNKNOWN).alias("family"),
        F.round("probability", 6).alias("probability"),
        F.round(similarity, 6).alias("similarity"),
        (sure & (similarity >= CONFIRM)).alias("confirmed"),
    )


def _likeness(common: Column, size: int) -> Column:
    """How much of a template of so many word pairs the paragraph holds, or the template of the paragraph, whichever is more."""
    own = F.col("n_words") - 1
    return F.least(F.lit(1.0), F.greatest(common / size, F.when(own >= CUT_PAIRS, common / own).otherwise(0.0)))


def _template_pairs(family: str) -> list[set[str]]:
    return [p for t in TEMPLATES[family] if (p := {g for g in grams(tokens(t)) if " " in g})]


def scan(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """doc_id, paragraph, family (or `unknown`), probability, similarity and confirmed of every paragraph that reads as a licence.

    Null and empty texts have no paragraph. Null doc_ids stay; repeated rows give repeated results;
    only doc_id and text are read.
    """
    model = model or train()
    telling = [F.lit(w) for w in sorted({w for g in model.weights for w in g.split()} - STOP)]
    # A paragraph without such a word has none of the model's n-grams.
    found = cut(paragraphs(docs).where(F.exists(_tokens(F.col("body")), lambda w: w.isin(*telling))))
    # Kept apart from the join, so that Spark may split a frequent notice's side of it.
    families = cut(classify(found.select("body").distinct(), model)).withColumnRenamed("body", "_body")
    return found.join(families, F.col("body") == F.col("_body")).select("doc_id", "paragraph", "family", "probability", "similarity", "confirmed")
