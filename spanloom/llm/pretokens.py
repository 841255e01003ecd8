"""Splitting text into pre-tokens, as the public byte-level BPE vocabularies ask."""

from __future__ import annotations

import re

import regex

# The letters, numerals and white space below U+02B0, as Unicode has them.
LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ"
NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = r"\t-\r \x85\xa0"
# Unicode's White_Space.
ALL_SPACES = SPACES + r"  -     　"

#: Finds a character for which the classes above don't speak.
BEYOND = re.compile("[^\x00-ʯ]")

_SHAPE = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_NEAR = re.compile(_SHAPE.format(L=LETTERS, N=NUMBERS, S=SPACES))
_FAR = regex.compile(_SHAPE.format(L=r"\p{L}", N=r"\p{N}", S=ALL_SPACES), regex.V0)


def split_bytes_bpe(text: str) -> list[str]:
    """Pre-tokens of the byte-level vocabularies; texts of European letters take the stdlib's faster engine."""
    return (_FAR if BEYOND.search(text) else _NEAR).findall(text)
