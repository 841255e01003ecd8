"""Alignment of two tokenizers' tokens over the same texts, each distinct text once.

Rows are dealt by their full text, so every distinct text is tokenised and aligned once, with the
number of its rows as its weight. Both tokenizers' tokens cover the same bytes; wherever a token of
either ends, a link between one token of each ends, so the links of a text are as many as the
distinct ends. How often a pair of ids is linked is counted over the whole corpus, in three steps that
move few rows: a block of texts adds up its own pairs; the blocks' sums meet by pair, each block once
however often a pair is in it; and what was found goes back to the blocks, where the texts wait with
their links as places in the block's list of pairs. The measures are then joined to all documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bpe import NEVER, merge_spans
from spanloom.llm.common import cut, ensure_importable
from spanloom.llm.pretokens import split_bytes_bpe
from spanloom.llm.token_counts import byte_alphabet

#: Characters of texts that a block holds, or one text if that is longer, and texts of it.
BLOCK_CHARS, BLOCK_TEXTS = 4_000_000, 2_048
#: A pair of ids as one number: A's above, B's in so many bits.
B_BITS = 24
#: Characters without white space, or of white space, in a row from which a text isn't given to the library for ranks.
LONG_RUN = 1_000
_LONG_GAP = re.compile(rf"\s{{{LONG_RUN}}}")

ALIGNED = (
    "block long, key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, links array<int>, pairs array<long>, sums array<long>"
)


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library: the ids of a text with a space before it, and the bytes of each id.

    Its merges make the tokens in the order of their ids, so the faster library for ranks gives the same
    ids. That one takes quadratic time or worse on very long pre-tokens: texts with a run of LONG_RUN
    characters are merged here, pre-token by pre-token. Special strings are plain text.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, special = byte_alphabet(), {t["content"] for t in spec.get("added_tokens") or []}
        raw = lambda entry: bytes(alphabet[c] for c in entry)
        self.id_of = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.rank = {tuple(map(raw, pair if isinstance(pair, list) else pair.split(" "))): k for k, pair in enumerate(spec["model"]["merges"])}
        made = [self.id_of[a + b] for a, b in self.rank]
        if made != sorted(made):
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        self.bytes = [b""] * (1 + max(self.id_of.values()))
        for piece, i in self.id_of.items():
            self.bytes[i] = piece
        self.library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.id_of, special_tokens={})

    def _merged(self, piece: str) -> list[int]:
        data, get = piece.encode("utf-8", "surrogatepass"), self.rank.get
        n = len(data)
        after = merge_spans(n, [get((data[i : i + 1], data[i + 1 : i + 2]), NEVER) for i in range(n - 1)], lambda a, b, c: get((data[a:b], data[b:c]), NEVER))
        ids, at = [], 0
        while at < n:
            ids.append(self.id_of[data[at : after[at]]])
            at = after[at]
        return ids

    def encode(self, text: str) -> list[int]:
        if max(map(len, text.split()), default=0) < LONG_RUN and not _LONG_GAP.search(text):
            return self.library.encode_ordinary(f" {text}")
        return [i for piece in split_bytes_bpe(f" {text}") for i in self._merged(piece)]


class Pieces:
    """A sentencepiece model: the ids of a text, before which it puts a space itself, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.library.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.library.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.library.is_byte(i) else piece.replace("\u2581", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


def link(a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places in a and b of every link's tokens, and where each group ends in a and in b. Both cover the same bytes."""
    a_ends, b_ends = np.cumsum(a_lengths[a]), np.cumsum(b_lengths[b])
    ended = np.zeros((2, a_ends[-1] + 1), dtype=np.int8)
    ended[0, a_ends] = ended[1, b_ends] = 1
    ends = np.flatnonzero(ended[0] | ended[1])
    i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    both = (ended[0] & ended[1])[ends] == 1
    return i, j, i[both] + 1, j[both] + 1


class GroupsText:
    """Writes groups as text: decimal ids of a, a bar and ids of b, with a semicolon between groups."""

    def __init__(self, a_size: int, b_size: int) -> None:
        self.a_size, self.b_size = a_size, b_size
        written = [f"{i}{after}" for size, afters in ((a_size, ",|"), (b_size, ",;")) for after in afters for i in range(size)]
        self.written = np.array(written, dtype=object)

    def write(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> str:
        out = np.empty(len(a) + len(b), dtype=np.int64)
        # A token comes after the tokens of its own side, and those of the other side's groups before it.
        a_code, b_code = a.copy(), b + 2 * self.a_size
        a_code[a_ends - 1] += self.a_size
        b_code[b_ends - 1] += self.b_size
        out[np.arange(len(a)) + np.repeat(np.append(0, b_ends[:-1]), np.diff(a_ends, prepend=0))] = a_code
        out[np.arange(len(b)) + np.repeat(a_ends, np.diff(b_ends, prepend=0))] = b_code
        return "".join(self.written[out].tolist())[:-1]


def aligner(a_path: str, b_path: str) -> Callable[[str], tuple]:
    """A function from a text to n_a, n_b, n_groups, n_links, groups_sha256, and the distinct pairs of ids with how often each is linked."""
    first, second = ByteLevel(a_path), Pieces(b_path)
    a_lengths, b_lengths = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (first, second))
    groups = GroupsText(len(first.bytes), len(second.bytes))

    def align(text: str) -> tuple:
        a, b, whole = first.encode(text), second.encode(text), f" {text}".encode()
        if not text or b"".join([first.bytes[i] for i in a]) != whole or b"".join([second.bytes[i] for i in b]) != whole:
            return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
        a_ids, b_ids = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        i, j, a_ends, b_ends = link(a_ids, b_ids, a_lengths, b_lengths)
        pairs = np.sort(a_ids[i] << B_BITS | b_ids[j])
        at = np.flatnonzero(np.diff(pairs, prepend=-1))
        digest = hashlib.sha256(groups.write(a_ids, b_ids, a_ends, b_ends).encode()).hexdigest()
        return len(a), len(b), len(a_ends), len(i), digest, pairs[at], np.diff(at, append=len(pairs))

    return align


def align_texts(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of ALIGNED: one for each text, and after a block's texts one with the block's pairs and their weighted sums.

    texts: key, text and weight, each text once. A text's places are those of its pairs among the block's.
    """
    ensure_importable(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        first, number = TaskContext.get().partitionId() << 32, 0
        rows, chars = [], 0

        def block() -> pa.RecordBatch:
            # Numbers are unique among the rows that one run of each task has written.
            lengths = [len(pairs) for _, _, _, pairs, _ in rows]
            pairs, places = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
            links = np.concatenate([r[4] for r in rows])
            sums = np.zeros(len(pairs), dtype=np.int64)
            np.add.at(sums, places, links * np.repeat(np.array([r[1] for r in rows], dtype=np.int64), lengths))
            edges = np.cumsum([0, *lengths, 0])
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x.astype(kind)))
            measures = [pa.array([*(r[2][k] for r in rows), None], pa.int64()) for k in range(4)]
            none = [None] * len(rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows) + 1, first + number)), pa.array([*(r[0] for r in rows), None], pa.binary()), *measures, pa.array([*(r[2][4] for r in rows), None], pa.string()),
                    lists(places, np.int32), lists(links, np.int32), pa.array([*none, pairs], pa.list_(pa.int64())), pa.array([*none, sums], pa.list_(pa.int64())),
                ],
                names=names,
            )

        for batch in batches:
            for key, text, weight in ((c.as_py() for c in row) for row in zip(*batch.columns, strict=True)):
                *measures, pairs, links = align(text)
                rows.append((key, weight, measures, pairs, links))
                chars += len(text)
                if chars >= BLOCK_CHARS or len(rows) >= BLOCK_TEXTS:
                    yield block()
                    rows, chars, number = [], 0, number + 1
        if rows:
            yield block()

    names = [c.split()[0] for c in ALIGNED.split(", ")]
    return texts.select("key", "text", "weight").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (its links corpus-wide) and best (whether no pair of its B id has more) of every pair, from the blocks' sums."""
    each = aligned.where("key IS NULL").select(F.explode(F.arrays_zip("pairs", "sums")).alias("x"))
    counts = cut(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.sums").alias("n")))
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def measure(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """key, the measures, n_best and count_sum of every text: blocks get back what their pairs count corpus-wide."""
    wanted = aligned.where("key IS NULL").select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    found = wanted.join(counts, "pair").select("of_block", "place", "n", "best")
    texts = aligned.where("key IS NOT NULL").select("block", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "links")
    kept = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def sum_up(rows: pa.Table, of_block: pa.Table) -> pa.Table:
        places, links = (rows.column(c).combine_chunks() for c in ("places", "links"))
        n, best = np.zeros(len(of_block), dtype=np.int64), np.zeros(len(of_block), dtype=np.int64)
        at = of_block.column("place").to_numpy()
        n[at], best[at] = of_block.column("n").to_numpy(), of_block.column("best").to_numpy(zero_copy_only=False)
        where, times = places.flatten().to_numpy(), links.flatten().to_numpy().astype(np.int64)
        edges = np.cumsum([0, *places.value_lengths().to_pylist()])
        totals = [np.diff(np.append(0, np.cumsum(times * of_pair[where]))[edges]) for of_pair in (best, n)]
        return pa.table([*(rows.column(c) for c in kept), *map(pa.array, totals)], names=[*kept, "n_best", "count_sum"])

    kinds = "key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return texts.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(sum_up, kinds)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    a_path: a byte-level vocabulary of the tokenizers library; b_path: a sentencepiece model. Special
    strings in texts are plain text. A text that is null or empty, or that either tokenizer changes,
    has no tokens: zeros, and an empty groups_sha256. Repeated rows count as often as they come and
    get a row each; null ids stay; an empty table gives none; columns other than doc_id and text
    aren't read. Texts are told apart in full; their SHA-256 joins the measures to the documents.
    """
    digest = lambda c: F.unhex(F.sha2(F.col(c).cast("binary"), 256))
    spoken = docs.select("doc_id", F.when(F.col("text") != "", F.col("text")).alias("text"))
    # Rows of one text are added up before they are dealt, so very many copies are no burden.
    texts = spoken.where(F.col("text").isNotNull()).groupBy("text").agg(F.count("*").alias("weight"))
    aligned = cut(align_texts(texts.select(digest("text").alias("key"), "text", "weight"), a_path, b_path))
    # Kept apart from the join, so that Spark may split the side of a text with very many rows.
    measures = cut(measure(aligned, cut(pair_counts(aligned)))).withColumnRenamed("key", "_key")
    met = spoken.select("doc_id", digest("text").alias("key")).join(measures, F.col("key") == F.col("_key"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return met.select("doc_id", *map(zero, ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
