"""Best-fit packing of token sequences by exact-complement hashing.

Texts become pieces of at most `capacity` ids. Only the histogram of piece lengths, at most
`capacity` numbers whatever the corpus, goes to the driver. There single lengths and the sums of two
are indexed by their total; a sum of three is found by its first member and the pair index of the rest. Passes over the lengths, longest first, look up what a length
leaves free among single lengths, then among pairs, then among triples, and take a combination as
often as the counts of what is still available allow. What has no exact filling is packed best-fit,
longest first. Exact fillings of many short pieces can cost more than they save, since the short ones
are missed elsewhere, so the plan is made with no pass and after each pass, and the one of fewest
sequences is taken, of equals the one of most passes. The plan is a short table of runs over ranks
within a length, and the cluster turns each piece's rank into its sequence and offset.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.common import cut, ensure_importable, map_rows
from spanloom.llm.pretokens import BEYOND, LETTERS, NUMBERS, SPACES

CAPACITY = 2048
#: Words that a Python worker remembers; when half are new, those not met since go.
MEMO_ENTRIES = 400_000
#: Lengths that fill a gap together, at most.
MOST_PARTS = 3

# Fixed value: how the vocabulary splits normalised text.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+".format(L=LETTERS, N=NUMBERS, S=SPACES))
#: New words that the library gets as one text.
WORDS_AT_ONCE = 512


def _unusual(text: str) -> bool:
    """Whether the normaliser may change a text's composition or classes, or a special string is in it: such texts go to the library whole."""
    return bool(BEYOND.search(text)) or "İ" in text or "<|" in text


class WordEncoder:
    """Ids of texts as the library gives them, remembering words.

    The vocabulary merges each split of the normalised text on its own, so a text below U+02B0
    without special strings is the sequence of its words; each distinct word is encoded by the
    library once. Any other text is encoded by the library as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # Words are normalised and split already, and each is new: the same model without those steps or its cache.
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words.model._resize_cache(0)
        ids = self.library.get_vocab()
        self.ends_word = np.zeros(max(ids.values(), default=0) + 1, dtype=bool)
        self.ends_word[[i for token, i in ids.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word: words are encoded side by side, and the token that ends a word tells them apart."""
        ids = np.array(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or (len(ids) and ends[-1] != len(ids)):
            return [self._library(w).tobytes() for w in words]
        data, edges = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _learn(self, words: set[str]) -> None:
        known, old = self.known, self.old
        new = []
        for w in words:
            if (ids := old.get(w)) is not None:
                known[w] = ids
            else:
                new.append(w)
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            known.update(zip(part, self._encode_words(part), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) >= MEMO_ENTRIES // 2:
            self.known, self.old = {}, self.known
        split = [None if _unusual(t) else _WORDS.findall(t.lower()) for t in texts]
        self._learn(set().union(*(w for w in split if w)).difference(self.known))
        get = self.known.__getitem__
        return [self._library(t).tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, split, strict=True)]


@functools.lru_cache(maxsize=2)
def load_encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary file, one in a Python worker."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every text's ids with id 0 after them, cut every `capacity` ids."""

    def init() -> Callable:
        encoder = load_encoder(path)

        def kernel(ids: list, texts: list) -> Iterator[tuple]:
            for doc_id, data in zip(ids, encoder.encode([t or "" for t in texts]), strict=True):
                data += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    yield doc_id, k, k * capacity, len(part) // 4, zlib.crc32(part)

        return kernel

    return map_rows(docs, ["doc_id", "text"], init, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Bins:
    """Equal sequences: runs of (length, pieces), how many sequences, and what is free in each."""

    runs: tuple[tuple[int, int], ...]
    times: int
    free: int


class Complements:
    """Lengths of which some are available, with their single, pair and triple sums indexed by total.

    Availability only falls, so a combination that can't be had any more never comes back: the index
    keeps, for each total, the place of the first combination that isn't spent, and each entry is
    passed over once.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = [0] * (capacity + 1)
        for length, n in counts.items():
            self.left[length] = n
        held = np.array(sorted((x for x, n in counts.items() if n), reverse=True), dtype=np.int64)
        # Pairs of every total, the one of the longest member first.
        one, two = np.triu_indices(len(held))
        total = held[one] + held[two]
        order = np.flatnonzero(total <= capacity)
        order = order[np.argsort(total[order], kind="stable")]
        self.longer, self.shorter = held[one[order]].tolist(), held[two[order]].tolist()
        begin = np.searchsorted(total[order], np.arange(capacity + 2))
        self.pair_at, self.pair_end = begin[:-1].tolist(), begin[1:].tolist()
        # A triple is a length with a pair of the rest; `triple_at` counts through the lengths.
        self.held = held.tolist()
        self.triple_at = [0] * (capacity + 1)

    def has(self, parts: tuple[int, ...]) -> bool:
        return all(self.left[x] >= parts.count(x) for x in parts)

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.left[total] else None

    def pair(self, total: int, beside: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """A pair of the total that can be had beside other parts, the longest member first."""
        at, end = self.pair_at[total], self.pair_end[total]
        while at < end and not self.has((self.longer[at], self.shorter[at])):
            at += 1
        self.pair_at[total] = at
        # Other parts are in few of the pairs, so this ends soon.
        while at < end:
            parts = self.longer[at], self.shorter[at]
            if self.has((*parts, *beside)):
                return parts
            at += 1
        return None

    def triple(self, total: int) -> tuple[int, ...] | None:
        """A triple of the total, of the longest first part."""
        for k in range(self.triple_at[total], len(self.held)):
            first = self.held[k]
            if first < total and self.left[first] and (rest := self.pair(total - first, (first,))):
                self.triple_at[total] = k
                return first, *rest
        self.triple_at[total] = len(self.held)
        return None

    def fill(self, parts: int, capacity: int) -> list[Bins]:
        """Whole sequences of one length and an exact filling of so many parts, as many as can be had; what they hold is taken."""
        made = []
        for length in range(capacity, 0, -1):
            while self.left[length]:
                self.left[length] -= 1
                gap = capacity - length
                filling = () if not gap else (self.single, self.pair, self.triple)[parts - 1](gap)
                self.left[length] += 1
                if filling is None:
                    break
                whole = (length, *filling)
                times = min(self.left[x] // whole.count(x) for x in whole)
                for x in whole:
                    self.left[x] -= times
                made.append(Bins(tuple((x, whole.count(x)) for x in dict.fromkeys(whole)), times, 0))
        return made


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Equal sequences that hold `counts` pieces of each length, as few as the method finds, and never more than best-fit alone."""
    best = _best_fit(counts, capacity)
    complements, made = Complements(counts, capacity), []
    for parts in range(1, MOST_PARTS + 1):
        made += complements.fill(parts, capacity)
        done = made + _best_fit({x: n for x, n in enumerate(complements.left) if n}, capacity)
        if sum(b.times for b in done) <= sum(b.times for b in best):
            best = done
    return best


def _best_fit(rest: dict[int, int], capacity: int) -> list[Bins]:
    """Best-fit, longest first: each piece goes where least stays free, many equal ones at once."""
    by_free: dict[int, list[Bins]] = {}
    frees: list[int] = []

    def put(b: Bins) -> None:
        if not by_free.get(b.free):
            bisect.insort(frees, b.free)
        by_free.setdefault(b.free, []).append(b)

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect.bisect_left(frees, length)
            opened = at < len(frees)
            if opened:
                same = by_free[frees[at]]
                b = same.pop()
                if not same:
                    del frees[at]
            else:
                b = Bins((), n, capacity)
            each = min(b.free // length, n)
            times = min(b.times, n // each)
            if opened and times < b.times:
                put(Bins(b.runs, b.times - times, b.free))
            put(Bins((*b.runs, (length, each)), times, b.free - each * length))
            n -= times * each
    return [b for same in by_free.values() for b in same]


def _slots(bins: list[Bins]) -> dict[str, np.ndarray]:
    """The plan by length and rank: from which rank of a length on a run begins, and where its pieces go."""
    rows, ranks, sequence = [], {}, 0
    for b in bins:
        offset = 0
        for length, each in b.runs:
            rows.append((length << 44 | ranks.get(length, 0), each, sequence, offset))
            ranks[length] = ranks.get(length, 0) + each * b.times
            offset += length * each
        sequence += b.times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("first", "each", "sequence", "offset"), table.T.copy(), strict=True))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is the one id 0. Repeated rows are packed each on its own; a null doc_id
    stays null. An empty table gives no row. The longest text only makes more pieces. Columns other
    than doc_id and text are not read. Pieces of one length are numbered in groups, one for each
    split of the input, so a very frequent length or very many equal rows aren't one task's.
    """
    order = ["doc_id", "piece", "start", "ids_crc32"]
    each = cut(pieces(docs, path, capacity).withColumn("part", F.spark_partition_id()))
    counts = each.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = cut(counts.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("before")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(histogram, capacity))
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1
    ranked = each.join(counts.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("before") + nth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            run = np.searchsorted(slots["first"], length << 44 | rank, side="right") - 1
            into = rank - (slots["first"][run] & ((1 << 44) - 1))
            sequence, nth_there = np.divmod(into, slots["each"][run])
            placed = [pa.array(slots["sequence"][run] + sequence), pa.array(slots["offset"][run] + nth_there * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *placed], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ensure_importable(docs.sparkSession)
    return ranked.select(*names[:5], "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
