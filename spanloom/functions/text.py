"""Text normalisers as expressions: words to be spoken, their surface forms, and stripped punctuation counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.numeric import let

# Unicode's White_Space, as the inside of a character class that Java and RE2 both read.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Punctuation that is stripped from the edges of a Latin word.
EDGE = r".,!?;:\"'()\[\]{}\-\x{2014}\x{2013}\x{201c}\x{201d}\x{2018}\x{2019}\x{bf}\x{a1}"
# The same marks, one by one.
EDGE_MARKS = ".,!?;:\"'()[]{}-\u2014\u2013\u201c\u201d\u2018\u2019\u00bf\u00a1"
# Marks that join two spoken words.
JOINS = r"\-/\x{2010}\x{2011}\x{2013}\x{2014}\x{2015}"
# Punctuation that each character-level normaliser skips.
SKIPPED = {
    "chinese": "。，！？；：…「」『』（）、・" + ".,!?;:\"'()[]{}-",
    "japanese": "。、！？；：…「」『』（）・" + ".,!?;:\"'()[]{}-",
    "korean": "。、，！？；：…「」『』（）・·" + ".,!?;:\"'()[]{}-",
}

WORDS = "array<struct<word:string,surface:string,prefix:int,suffix:int>>"


def _rare(inside: str) -> str:
    """A class of marks, as a pattern that turns away ASCII letters, which most characters are, before it looks at the marks one by one."""
    return rf"[\x{{0}}-\x{{40}}\x{{5b}}-\x{{60}}\x{{7b}}-\x{{10ffff}}&&[{inside}]]"


def _nonempty(parts: Column) -> Column:
    return F.filter(parts, lambda p: F.length(p) > 0)


def latin_words(text: Column, clitics: bool = False) -> Column:
    """Array of (word, surface, prefix, suffix): lower-cased words with the forms they come from and the counts of stripped marks.

    With clitics, a token is cut after every apostrophe, which stays on the left piece; such a piece
    is stripped on its left only.
    """
    tokens = _nonempty(F.split(text, f"{_rare(SPACE)}+"))

    word = lambda w, surface, before, after: F.struct(F.lower(w).alias("word"), surface.alias("surface"), before.cast("int").alias("prefix"), after.cast("int").alias("suffix"))
    none = F.lit(0)

    def of_token(token: Column) -> Column:
        # Most tokens have no mark at all.
        return F.when(~token.rlike(_rare(EDGE + JOINS)), F.array(word(token, token, none, none))).otherwise(of_marked(token))

    def of_marked(token: Column) -> Column:
        if not clitics:
            return of_piece(token, None)
        each = lambda pieces: F.flatten(F.transform(pieces, lambda p, i: of_piece(p, i < F.size(pieces) - 1)))
        return let(_nonempty(F.split(token, r"(?<=['\x{2019}])")), each)

    marks = F.lit(EDGE_MARKS)

    def of_piece(piece: Column, left_only: Column | None) -> Column:
        right = lambda left: F.rtrim(left, marks)
        bare = right if left_only is None else (lambda left: F.when(left_only, left).otherwise(right(left)))
        return let(F.ltrim(piece, marks), lambda left: let(bare(left), lambda b: of_bare(piece, left, b, left_only)))

    def of_bare(piece: Column, left: Column, bare: Column, left_only: Column | None) -> Column:
        counts = F.length(piece) - F.length(left), F.length(left) - F.length(bare)
        prefix, suffix = counts if left_only is None else (F.when(left_only, 0).otherwise(n) for n in counts)
        several = bare.rlike(_rare(JOINS))
        cut = lambda parts: F.transform(parts, lambda p, i: word(p, p, F.when(i == 0, prefix).otherwise(0), F.when(i == F.size(parts) - 1, suffix).otherwise(0)))
        split = let(_nonempty(F.split(bare, _rare(JOINS))), cut)
        return F.when(F.length(bare) == 0, F.array().cast(WORDS)).when(several, split).otherwise(F.array(word(bare, piece, prefix, suffix)))

    return F.flatten(F.transform(tokens, of_token))


def character_words(text: Column, kind: str) -> Column:
    """Array of (word, surface, prefix, suffix) with one word for each character but white space and punctuation."""
    skipped = [F.lit(c) for c in dict.fromkeys(SKIPPED[kind])]
    kept = F.filter(F.split(text, ""), lambda c: (F.length(c) > 0) & ~c.rlike(f"^[{SPACE}]$") & ~c.isin(*skipped))
    word = lambda c: F.struct(F.lower(c).alias("word"), F.when(c.rlike("^[A-Za-z]$"), F.lower(c)).otherwise(c).alias("surface"), F.lit(0).alias("prefix"), F.lit(0).alias("suffix"))
    return F.transform(kept, word)


def normalize(text: Column, kind: Column) -> Column:
    """Words of a text by the kind of its language's normaliser; null for a language without one or a null text."""
    ways = {"latin": latin_words(text), "latin_clitic": latin_words(text, clitics=True)} | {k: character_words(text, k) for k in SKIPPED}
    out = F.lit(None).cast(WORDS)
    for name, words in ways.items():
        out = F.when(kind == name, words).otherwise(out)
    return out


def joined(words: Column) -> Column:
    """Normalised text: the words with one space between them."""
    return F.array_join(F.transform(words, lambda w: w["word"]), " ")
