"""Characters' scripts and the languages they stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.language import LATIN

KANA, HANGUL, HAN, LATIN_LETTER = r"[\p{IsHiragana}\p{IsKatakana}]", r"\p{IsHangul}", r"\p{IsHan}", r"\p{IsLatin}"
COMMON = r"[\p{IsCommon}\p{IsInherited}\p{IsUnknown}]"


def has_kana(text: Column) -> Column:
    return text.rlike(KANA)


def has_hangul(text: Column) -> Column:
    return text.rlike(HANGUL)


def language_of(ch: Column, kana: Column, hangul: Column, state: Column) -> Column:
    """Language of one character in a text with or without kana and hangul, given the language so far; null if it carries on."""
    latin_state = F.coalesce(state.isin(*LATIN), F.lit(False))
    return (
        F.when(ch.rlike(f"^{KANA}$"), "ja")
        .when(ch.rlike(f"^{HANGUL}$"), "ko")
        .when(ch.rlike(f"^{HAN}$"), F.when(kana, "ja").when(hangul, "ko").otherwise("zh"))
        .when(ch.rlike(f"^{LATIN_LETTER}$"), F.when(latin_state, state).otherwise("en"))
        .when(ch.rlike(f"^{COMMON}$"), F.lit(None).cast("string"))
        .otherwise(state)
    )
