"""Byte-level BPE over a segment tree of pair ranks, with its inverse.

Each leaf stands for the pair that begins at a byte position and holds that pair's merge rank; an
inner node holds the smallest rank below it, the leftmost on ties. One merge reads the root, unlinks
the right neighbour and updates at most three leaves, in logarithmic time, so that a pre-token of n
bytes costs O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from spanloom.llm.common import map_rows
from spanloom.llm.pretokens import split_bytes_bpe

#: Pre-tokens whose result a Python worker remembers, and the longest one: some 100 MB of ordinary words, 0.6 GB of the longest at worst.
MEMO_ENTRIES, MEMO_CHARS = 1_000_000, 64
#: The rank of a pair that no rule merges.
NEVER = 1 << 30
NOTHING = NEVER << 32


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> tuple[dict[bytes, int], dict[int, bytes]]:
    """Ranks of a .tiktoken file, and the bytes of each id."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks, {v: k for k, v in ranks.items()}


def merge_spans(n: int, ranks: list[int], rank_of: Callable[[int, int, int], int]) -> list[int]:
    """Where each token of a pre-token of n bytes ends, by where it begins, once no pair can be merged.

    ranks: the rank of each pair of neighbouring bytes. rank_of(a, b, c) is the rank of merging the
    tokens at [a, b) and [b, c), or NEVER. The leftmost pair of least rank is always merged first.
    A node of the tree holds rank << 32 | position of the least pair below it, so that the leftmost
    wins ties. One merge changes the leaves of the merged pair, of the neighbour that it swallows
    and of the one to its left; their paths are recomputed together, shared nodes once.
    """
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    if n < 2:
        return after
    size = 1 << (n - 2).bit_length()
    tree = [NOTHING] * size + [rank << 32 | at for at, rank in enumerate(ranks)] + [NOTHING] * (size - n + 1)
    for node in range(size - 1, 0, -1):
        x, y = tree[2 * node], tree[2 * node + 1]
        tree[node] = x if x < y else y
    while (least := tree[1]) < NOTHING:
        at = least & 0xFFFFFFFF
        gone = after[at]
        end = after[at] = after[gone]
        a = b = c = size + at
        if gone < n - 1:
            c = size + gone
            tree[c] = NOTHING
        if end < n:
            before[end] = at
            tree[b] = rank_of(at, end, after[end]) << 32 | at
        else:
            tree[b] = NOTHING
        if (left := before[at]) >= 0:
            a = size + left
            tree[a] = rank_of(left, at, end) << 32 | left
        while a > 1:
            a, b, c = a >> 1, b >> 1, c >> 1
            x, y = tree[2 * a], tree[2 * a + 1]
            tree[a] = x if x < y else y
            if b != a:
                x, y = tree[2 * b], tree[2 * b + 1]
                tree[b] = x if x < y else y
            if c != b:
                x, y = tree[2 * c], tree[2 * c + 1]
                tree[c] = x if x < y else y
    return after


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    get, n = ranks.get, len(piece)
    after = merge_spans(n, [get(piece[i : i + 2], NEVER) for i in range(n - 1)], lambda a, _, c: get(piece[a:c], NEVER))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


def encode(text: str, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a text, each pre-token on its own."""
    return [i for piece in split_bytes_bpe(text) for i in merge_bytes(piece.encode("utf-8", "surrogatepass"), ranks)]


def decode(ids: list[int], tokens: dict[int, bytes]) -> bytes:
    """Bytes of a list of ids."""
    return b"".join([tokens[i] for i in ids])


class Memo(dict):
    """Remembers a bounded number of short pre-tokens; when full, those not met again in a while go."""

    def __init__(self, make: Callable[[str], object]) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> object:
        made = self.old.get(piece) or self.make(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = made
        return made


@functools.lru_cache(maxsize=4)
def _pieces(path: str) -> Memo:
    ranks, tokens = load_ranks(path)

    def make(piece: str) -> tuple[int, str, bytes]:
        ids = merge_bytes(piece.encode("utf-8", "surrogatepass"), ranks)
        return len(ids), " ".join(map(str, ids)), decode(ids, tokens)

    return Memo(make)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, digests of the ids and of the decoded bytes, and whether they are the text's.

    A null text counts as empty; an empty text has no ids and the digests of no bytes. A null
    doc_id stays null. Repeated rows give repeated results. Other columns are not read.
    """

    def init() -> Callable:
        memo = _pieces(path)

        def kernel(ids: list, texts: list) -> list[tuple]:
            out = []
            for doc_id, text in zip(ids, texts, strict=True):
                found = [memo[p] for p in split_bytes_bpe(text or "")]
                line = " ".join([x[1] for x in found])
                back = b"".join([x[2] for x in found])
                out.append((doc_id, sum([x[0] for x in found]), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), back == (text or "").encode()))
            return out

        return kernel

    return map_rows(docs, ["doc_id", "text"], init, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and token_ids of every text (null: empty)."""

    def init() -> Callable:
        ranks, _ = load_ranks(path)
        return lambda ids, texts: [(i, encode(t or "", ranks)) for i, t in zip(ids, texts, strict=True)]

    return map_rows(docs, ["doc_id", "text"], init, "doc_id long, token_ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of encode_documents; null ids give null, bytes that are no UTF-8 the replacement character."""

    def init() -> Callable:
        _, tokens = load_ranks(path)
        return lambda docs, ids: [(d, None if i is None else decode(i, tokens).decode("utf-8", "replace")) for d, i in zip(docs, ids, strict=True)]

    return map_rows(encoded, ["doc_id", "token_ids"], init, "doc_id long, text string")
