"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Abusive words come from two lexicons: a fixed one of common words by kind, and one of words and pieces
of words that the training labels mark, since abuse takes forms that no list has.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm import boosting
from spanloom.llm.common import cut, extend_rows, fresh, held_out, map_rows

#: Bound of the training sample: about so many labelled documents, picked by a hash of their id.
TRAINING_DOCUMENTS = 20_000
THRESHOLD = 0.3
#: Documents with label 0 that count beside a sample from which no tree can be learned.
UNSEEN = 20

# Abusive words by kind.
INSULTS = frozenset(
    "idiot idiots moron morons moronic imbecile stupid dumb dumbass fool fools loser losers clown clowns scum trash garbage "
    "worthless pathetic disgusting ugly creep creeps freak freaks jerk jerks pig pigs rat rats vermin filth filthy "
    "coward cowards liar liars brainless clueless lazy useless hideous repulsive despicable degenerate cretin "
    "halfwit nitwit dimwit dunce buffoon braindead lowlife scumbag dirtbag douche sicko weirdo parasite "
    "idiota idiote crétin imbécile abruti connard salaud ordure dummkopf trottel arschloch abschaum schwachkopf "
    "estúpido estúpida imbécil basura asqueroso asquerosa inútil".split()
)
PROFANITY = frozenset(
    "fuck fucking fucked fucker shit shitty bullshit bitch bitches bastard bastards asshole assholes damn crap "
    "piss pissed dick prick cunt slut whore merde putain scheisse scheiße mierda puta joder".split()
)
HOSTILITY = frozenset(
    "hate hates hated kill die dead hurt destroy punch burn suffer shut despise loathe attack beat crush murder shoot stab rot hang".split()
)
SECOND_PERSON = frozenset("you your yours yourself yourselves youre ur u du dich dir dein deine tu te toi vous votre tú usted vosotros".split())

#: Words between a second person and an abusive word that count as near.
NEAR = 5
_WORD = re.compile(r"[^\W\d_]+")
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]+")
#: Look-alikes inside a word, and the word around them.
_SIGNS = re.compile("[@$0134571!*]+")
_BEFORE_LETTER = re.compile(r"(?<![@$0134571!*])[@$0134571!*]++(?=[^\W\d_])")
_AROUND = re.compile(r"[\w@$!*]+")
_PLAIN = str.maketrans("@$013457!", "asoieasti")
ABUSE = INSULTS | PROFANITY

#: Lengths of the pieces of words that the learned lexicon may hold; letters beyond which a word has no inner pieces.
PIECES = (4, 5, 6)
LONG_WORD = 64
#: Most terms of the learned lexicon; how much likelier a term is under label 1.
LEARNED_TERMS = 400
LIKELIER = 20.0

FEATURES = (
    "words", "insults", "insults_per_100", "profanities_per_100", "hostility_per_100", "learned", "learned_per_100", "distinct_learned",
    "abuse_per_100", "distinct_abuse", "second_person_per_100", "abuse_near_second_person", "capitals", "exclamations", "questions",
    "punctuation", "disguised_abuse", "disguised_per_100", "spaced_out", "mean_word",
)


#: Abusive words of more than three letters, one of which a run of single letters may hold.
_SPELLED = re.compile("|".join(sorted(a for a in ABUSE if len(a) > 3)))


def terms(word: str) -> list[str]:
    """What the learned lexicon may know a word by: itself, and its beginnings, ends and inner pieces, with a hyphen where it goes on."""
    n = len(word)
    found = [word]
    for k in PIECES:
        if n > k:
            found += [word[:k] + "-", "-" + word[-k:]]
            if n <= LONG_WORD:
                found += ["-" + word[i : i + k] + "-" for i in range(1, n - k)]
    return found


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For every code point, whether it is a letter of _WORD (1), a capital (2), a look-alike (4)."""
    kinds = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    every = "".join(map(chr, range(sys.maxunicode + 1)))
    for pattern, bit in ((_WORD, 1), (_CAPITALS, 2), (_SIGNS, 4)):
        for m in pattern.finditer(every):
            kinds[m.start() : m.end()] |= bit
    return kinds


def _split(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """What _WORD finds in a text; its code points between two spaces, with a space for all else; which of these are letters; where words begin."""
    codes = _codes(f" {text} ")
    letter = _kinds()[codes] & 1 > 0
    codes = np.where(letter, codes, np.uint32(32))
    return codes.tobytes().decode("utf-32-le").split(), codes, letter, np.flatnonzero(letter[1:] & ~letter[:-1]) + 1


def _windows(codes: np.ndarray) -> np.ndarray:
    """A number under 1 << 16 for the four letters from each place on."""
    a, b, c, d = (codes[i : len(codes) - 3 + i] * np.uint32(odd) for i, odd in enumerate((2654435761, 2246822519, 3266489917, 668265263)))
    return (a + b + c + d) >> np.uint32(16)


@lru_cache(maxsize=4)
def _openings(lexicon: frozenset[str]) -> np.ndarray:
    """By number of _windows: 1 if a piece at the beginning of a word may begin with such letters, 2 if one at the end or inside may, 3 if both."""
    found = np.zeros(1 << 16, dtype=np.uint8)
    for term in lexicon:
        piece = term.strip("-")
        if piece != term and len(piece) >= min(PIECES):
            found[_windows(_codes(piece[:4]))] |= 2 if term.startswith("-") else 1
    return found


def _learned(words: list[str], codes: np.ndarray, letter: np.ndarray, starts: np.ndarray, lexicon: frozenset[str]) -> set[str]:
    """The words that the lexicon knows by one of their terms, which are spelled out only where four letters are those that a piece begins with."""
    known = set(filter(lexicon.__contains__, words))
    if len(codes) > 5:
        # 1 where a word begins, 2 inside it.
        place = letter[1:-3].view(np.uint8) << letter[:-4].view(np.uint8)
        at = np.flatnonzero(_openings(lexicon)[_windows(codes[1:])] & place) + 1
        some = {words[k] for k in (np.searchsorted(starts, at, side="right") - 1).tolist()}
        known.update([w for w in some if not lexicon.isdisjoint(terms(w))])
    return known


def _near(words: list[str], abusive: set[str], second: list[int]) -> int:
    at = np.array([i for i, w in enumerate(words) if w in abusive])
    to = np.array(second)
    k = np.searchsorted(to, at)
    gaps = np.minimum(np.abs(at - to[np.minimum(k, len(to) - 1)]), np.abs(at - to[np.maximum(k - 1, 0)]))
    return int((gaps <= NEAR).sum())


def _disguised(text: str) -> list[str]:
    out, end = [], 0
    for m in _BEFORE_LETTER.finditer(text):
        if m.start() >= end and m.start() and (text[m.start() - 1].isalpha() or m[0][0] in "@$"):
            begin = m.start()
            while begin and begin > end and text[begin - 1].isalnum():
                begin -= 1
            word = _AROUND.match(text, begin)
            end = word.end()
            out.append(word[0])
    return out


def _spaced_out(words: list[str], letter: np.ndarray, starts: np.ndarray) -> int:
    """Runs of single letters that together spell an abusive word."""
    single = ~letter[starts + 1]
    # Four in a row somewhere: where there are none, no run is long enough.
    if not (single[:-3] & single[1:-2] & single[2:-1] & single[3:]).any():
        return 0
    # One string of single letters, with a space for every other word: a run is what stands between spaces.
    runs = "".join([w if len(w) == 1 else " " for w in words]).split()
    return sum([len(run) > 3 and _SPELLED.search(run) is not None for run in runs])


def features(text: str | None, lexicon: frozenset[str] = frozenset()) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES; lexicon: the learned terms."""
    text = text or ""
    words, codes, letter, starts = _split(text.lower())
    kinds = _kinds()[_codes(text)]
    n, seen = len(words), set(words)
    insults, profane, hostile, second = INSULTS & seen, PROFANITY & seen, HOSTILITY & seen, SECOND_PERSON & seen
    learned = _learned(words, codes, letter, starts, lexicon) if lexicon else set()
    abusive = insults | profane | learned
    counts = Counter(filter((abusive | hostile | second).__contains__, words))
    hit = lambda found: sum([counts[w] for w in found])
    near = _near(words, abusive, [i for i, w in enumerate(words) if w in SECOND_PERSON]) if abusive and second else 0
    lookalikes = _disguised(text) if (kinds[:-1] & 4 & kinds[1:] << 2).any() else []
    letters = int(np.count_nonzero(letter))
    per, some = 100 / max(1, n), max(1, letters)
    return [
        float(n), float(hit(insults)), hit(insults) * per, hit(profane) * per, hit(hostile) * per, float(hit(learned)), hit(learned) * per, float(len(learned)),
        hit(abusive) * per, float(len(abusive)), hit(second) * per, float(near), int(np.count_nonzero(kinds & 2)) / some, text.count("!") * per, text.count("?") * per,
        (len(text) - letters - text.count(" ") - text.count("\n")) * per, float(sum(w.strip("!*").lower().translate(_PLAIN) in ABUSE for w in lookalikes)),
        len(lookalikes) * per, float(_spaced_out(words, letter, starts)), letters / max(1, n),
    ]


@dataclass
class Model:
    """Learned terms, trees over the features, and the calibration of the trees' log-odds."""

    lexicon: frozenset[str]
    trees: boosting.Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated chance of label 1, in [0, 1]."""
        x = np.array([features(t, self.lexicon) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


def learn_lexicon(sample: DataFrame, most: int = LEARNED_TERMS) -> frozenset[str]:
    """The terms far likelier in the documents with label 1 that most of these have, from the columns text and toxic of a bounded sample.

    Counts are by document. Both labels are counted, and every term is tested, on the cluster.
    """
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return frozenset()

    def init() -> Callable:
        def kernel(texts: list, labels: list) -> list[tuple]:
            n: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for text, label in zip(texts, labels, strict=True):
                n[label == 1].update({t for w in set(_WORD.findall((text or "").lower())) for t in terms(w)})
            return [(t, n[True][t], n[False][t]) for t in n[True].keys() | n[False].keys()]

        return kernel

    found = map_rows(sample, ["text", "toxic"], init, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rate = (F.col("bad") + 0.5) / (bad + 1) * (good + 1) / (F.col("good") + 0.5)
    marked = found.where((F.col("bad") >= max(3, bad // 500)) & (rate >= LIKELIER) & (F.col("good") * 20 <= F.col("bad")))
    return frozenset(r.term for r in marked.orderBy(F.desc("bad"), "term").limit(most).collect())


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: int = TRAINING_DOCUMENTS) -> Model:
    """Fit on the labelled documents for which `usable` (over doc_id) holds.

    Labels are read once per doc_id; those with a null doc_id or label are ignored, as is an id with
    both labels. About `most` ids are picked by a hash, and of the rows that share an id one text, the
    one of least hash, so the sample is bounded; it is kept in the shared checkpoint folder while the
    lexicon and the features are made. Trees learn from three
    quarters of it, the calibration from the rest. Without both labels the score is constant.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("also")).where("toxic = also")
    ticket = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    share = min(1.0, most / max(1, known.count()))
    picked = known.where(ticket < int(share * (1 << 30))).select(F.col("doc_id").alias("labelled_id"), F.col("toxic").cast("int").alias("toxic"))
    met = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("labelled_id"))
    one = met.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("order"), "text", "toxic")).alias("row"))
    sample = cut(one.select("doc_id", "row.text", "row.toxic"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 3
    lexicon = learn_lexicon(sample.where(~part))

    def init() -> Callable:
        return lambda ids, texts, toxic, parts: [(i, y, p, features(t, lexicon)) for i, t, y, p in zip(ids, texts, toxic, parts, strict=True)]

    columns = ["doc_id", "text", "toxic", part.alias("part")]
    found = map_rows(sample, columns, init, "doc_id long, toxic int, part boolean, features array<double>").toPandas().sort_values("doc_id", kind="stable")
    x, y = np.array(found.features.tolist(), dtype=float).reshape(-1, len(FEATURES)), found.toxic.to_numpy(dtype=np.int64)
    held = found.part.to_numpy(dtype=bool)
    trees = boosting.fit(x[~held], y[~held])
    if not trees.trees:
        # Nothing tells the labels apart: the share of label 1, as if UNSEEN documents more had label 0.
        return Model(lexicon, trees, (np.zeros(1), np.full(1, y.sum() / (len(y) + UNSEEN))))
    return Model(lexicon, trees, boosting.isotonic(trees.raw(x[held]), y[held]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= threshold) of every whole text.

    A null text scores as an empty one. Null doc_ids stay; repeated rows give repeated results; only
    doc_id and text are read.
    """

    def init() -> Callable:
        def kernel(ids: list, texts: list) -> list[tuple]:
            scores = model.score(texts)
            return [(i, float(s), int(s >= threshold)) for i, s in zip(ids, scores, strict=True)]

        return kernel

    return map_rows(docs, ["doc_id", "text"], init, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores under the threshold."""

    def init() -> Callable:
        return lambda texts: [bool(s < threshold) for s in model.score(texts)]

    name = fresh(docs, "clean")
    return extend_rows(docs, "text", init, name, "boolean").where(F.col(f"`{name}`")).drop(name)


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that aren't held out and score all: doc_id, held_out, score, predicted."""
    found = score(docs, train(docs, labels, ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
