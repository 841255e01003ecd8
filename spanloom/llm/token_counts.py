"""Token counts by the whole-token shortcut.

Offline, before any text is read, the driver puts every string of the vocabulary through the merges;
those that end as one token form the shortcut set, which the workers get. A pre-token in the set
counts one token without any merge; only the others are merged, pair by pair in rank order.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Callable

from pyspark import Broadcast
from pyspark.sql import DataFrame

from spanloom.llm.bpe import NEVER, Memo, merge_spans
from spanloom.llm.common import map_rows
from spanloom.llm.pretokens import split_bytes_bpe

TOKEN_LIMIT = 512


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, inverted.

    Visible Latin-1 characters stand for themselves; the other bytes, in order, take the characters from U+0100 on.
    """
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Pair ranks, special strings and the shortcut set of one .json byte-level BPE; without a given set, it is proven here."""

    def __init__(self, path: str, whole: frozenset[str] | None = None) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.pair_rank: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pair_rank[raw(left), raw(right)] = rank
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.whole = self._prove(filter(None, (self._text(raw, t) for t in spec["model"]["vocab"]))) if whole is None else whole
        self.merged = Memo(self.count_merged)

    @staticmethod
    def _text(raw: Callable[[str], bytes], token: str) -> str | None:
        try:
            return raw(token).decode()
        except (KeyError, UnicodeDecodeError):
            return None

    def _prove(self, strings) -> frozenset[str]:
        return frozenset(s for s in strings if self.count_merged(s) == 1 and split_bytes_bpe(s) == [s])

    def count_merged(self, piece: str) -> int:
        """Tokens of one pre-token by its merges."""
        data, get = piece.encode("utf-8", "surrogatepass"), self.pair_rank.get
        n = len(data)
        first = [get((data[i : i + 1], data[i + 1 : i + 2]), NEVER) for i in range(n - 1)]
        after = merge_spans(n, first, lambda a, b, c: get((data[a:b], data[b:c]), NEVER))
        tokens, at = 0, 0
        while at < n:
            tokens, at = tokens + 1, after[at]
        return tokens

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one token, as the library's default has it."""
        n, parts = 0, [text]
        if self.special and self.special.search(text):
            split = self.special.split(text)
            n, parts = len(split) // 2, split[::2]
        whole, merged = self.whole, self.merged
        for part in parts:
            for piece, times in Counter(split_bytes_bpe(part)).items():
                n += times if piece in whole else times * merged[piece]
        return n


@functools.lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary at a path with its proof."""
    return Vocabulary(path)


#: The vocabularies of a Python worker, by path.
_OF_WORKER: dict[str, Vocabulary] = {}


def _in_worker(path: str, proven: Broadcast) -> Vocabulary:
    if path not in _OF_WORKER:
        _OF_WORKER[path] = Vocabulary(path, proven.value)
    return _OF_WORKER[path]


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null text counts as empty: no bytes, no tokens. A null doc_id stays null; repeated rows give
    repeated results. Other columns are not read.
    """

    # As large as the vocabulary, whatever the corpus.
    proven = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path).whole)

    def init() -> Callable:
        count = _in_worker(path, proven).count

        def kernel(ids: list, texts: list) -> list[tuple]:
            return [(i, len(t.encode()), n := count(t), n > limit) for i, t in zip(ids, (t or "" for t in texts), strict=True)]

        return kernel

    return map_rows(docs, ["doc_id", "text"], init, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
