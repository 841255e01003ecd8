"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams (one to three letters, word ends
included) in order of frequency. A document's own most frequent n-grams are compared to each
profile: every n-gram adds how far it is out of place, or the profile's length if the profile lacks
it. The language of least distance wins.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import ensure_importable, extend_rows, fresh, held_out, map_rows

#: n-grams of a document that are compared, and of a language that are kept.
DOCUMENT_GRAMS, PROFILE_GRAMS = 300, 600
#: Bound of the training sample: about so many documents of each language, picked by a hash of their id.
TRAINING_DOCUMENTS = 2_000
#: Bound of the training sample in languages: the most frequent values of lang; the driver holds one profile for each.
LEARNED_LANGUAGES = 1_000
UNDETERMINED = "und"
_BITS = 21


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point 2 if it is a letter, 1 if it is a mark that may belong to one, else 0."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), dtype=np.int8, count=0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's n-grams and how often each occurs; none for a text without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    kinds = _letters()[points]
    if not (kinds == 2).any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    points = np.concatenate(([32], np.where(kinds > 0, points, 32), [32]))
    gap = points == 32
    points = points[~(gap & np.concatenate(([False], gap[:-1])))]
    inner = points[1:-1] != 32
    pairs = points[:-1] | points[1:] << _BITS
    threes = (pairs[:-1] | points[2:] << 2 * _BITS)[inner]
    return np.unique(np.concatenate((points[1:-1][inner], pairs, threes)), return_counts=True)


def ranked_grams(text: str, most: int = DOCUMENT_GRAMS) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    codes, counts = gram_counts(text)
    return codes[np.lexsort((codes, -counts))[:most]]


@dataclass(frozen=True)
class Profiles:
    """languages, in order; codes, sorted, of all profiles; for code i, the languages and ranks at [begin[i], begin[i + 1]) are those of the profiles that have it."""

    languages: tuple[str, ...]
    codes: np.ndarray
    begin: np.ndarray
    language: np.ndarray
    rank: np.ndarray
    length: int = PROFILE_GRAMS

    @classmethod
    def of(cls, ranked: Iterable[tuple[str, int, int]]) -> Profiles:
        """From rows (language, code, rank), in any order."""
        rows = sorted(ranked, key=lambda r: (r[1], r[0]))
        languages = tuple(sorted({r[0] for r in rows}))
        number = {x: i for i, x in enumerate(languages)}
        codes, first = np.unique(np.array([r[1] for r in rows], dtype=np.int64), return_index=True)
        return cls(languages, codes, np.append(first, len(rows)), np.array([number[r[0]] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64))

    def distances(self, text: str) -> np.ndarray | None:
        """Mean out-of-place distance to each language as a share of the largest; None for a text without a letter."""
        grams = ranked_grams(text)
        if not len(grams) or not self.languages:
            return None
        at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        place = np.flatnonzero(self.codes[at] == grams)
        begin, many = self.begin[at[place]], self.begin[at[place] + 1] - self.begin[at[place]]
        held = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        # A gram that a profile lacks is the profile's length out of place.
        nearer = self.length - np.abs(self.rank[held] - np.repeat(place, many))
        out = self.length * len(grams) - np.bincount(self.language[held], weights=nearer, minlength=len(self.languages))
        return out / (self.length * len(grams))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, the first of equals, and one less its distance."""
        far = self.distances(text) if text else None
        if far is None:
            return UNDETERMINED, 0.0
        best = int(np.argmin(far))
        return self.languages[best], float(1 - far[best])


def train(docs: DataFrame, usable: Column, per_language: int = TRAINING_DOCUMENTS, most_languages: int = LEARNED_LANGUAGES) -> Profiles:
    """Profiles from the rows with text and lang for which `usable` holds.

    The sample is bounded: it takes the `most_languages` most frequent values of lang, ties by name,
    and of each about `per_language` rows, chosen by a hash of doc_id and text. n-gram counts are
    summed on the cluster; the driver gets PROFILE_GRAMS rows for each language.
    """
    rows = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, per_language / r["count"])) for r in sizes], "lang string, share double")
    picked = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, counts = gram_counts(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    ensure_importable(docs.sparkSession)
    summed = picked.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = summed.withColumn("place", place).where(F.col("place") <= PROFILE_GRAMS).select("lang", "code", "place").collect()
    return Profiles.of((r.lang, r.code, r.place - 1) for r in top)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every whole text.

    A null text or one without a letter (marks alone are none) is `und` with score 0, as is every text if no language was
    learned. Of languages equally near the first by name wins. Null doc_ids stay; repeated rows give repeated results; only doc_id and text are read.
    """

    def init() -> Callable:
        predict = profiles.predict
        return lambda ids, texts: [(i, *predict(t)) for i, t in zip(ids, texts, strict=True)]

    return map_rows(docs, ["doc_id", "text"], init, "doc_id long, lang_pred string, score double")


def relabel(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs with lang replaced by the predicted language; every other column and every row as it was."""

    def init() -> Callable:
        return lambda texts: [profiles.predict(t)[0] for t in texts]

    name = fresh(docs, "lang_pred")
    found = extend_rows(docs, "text", init, name, "string")
    return found.select(*(F.col(f"`{name}`").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def train_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out and predict all: doc_id, held_out, lang_pred, score."""
    found = identify(docs, train(docs, ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
