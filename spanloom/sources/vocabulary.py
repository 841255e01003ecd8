"""Vocabularies: the bundled one, and the loader of tokenizer files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# Four special tokens, the word delimiter, and letters by frequency.
BUNDLED = [(t, i) for i, t in enumerate(["<pad>", "<s>", "</s>", "<unk>", "|", *"ETAONIHSRDLUMWCFGYPBVK'XJQZ"])]


def parse_tokenizer(text: str) -> list[tuple[str, int]]:
    """(token, id) of a tokenizer file; a model without a type is read as whole words. Raises ValueError if it has no vocabulary."""
    spec = json.loads(text)
    model = spec.get("model") if isinstance(spec, dict) else None
    if not isinstance(model, dict) or not isinstance(model.get("vocab"), dict):
        raise ValueError("no model with a vocabulary")
    if model.setdefault("type", "WordLevel") not in ("WordLevel", "BPE", "WordPiece"):
        raise ValueError(f"unknown model type {model['type']}")
    found = dict(model["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    return sorted(found.items(), key=lambda x: (x[1], x[0]))


def load_tokenizer(spark: SparkSession, path: str) -> DataFrame:
    """token and id of the tokenizer file at any path that Spark reads."""
    text = spark.read.text(path, wholetext=True).first()
    return spark.createDataFrame(parse_tokenizer(text.value if text else ""), "token string, id int")


def bundled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUNDLED, "token string, id int")
