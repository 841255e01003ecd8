"""Language codes and what depends on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named language codes.
LANGUAGES = (
    "en zh de es ru ko fr ja pt tr pl ca nl ar sv it id hi fi vi he uk el ms cs ro da hu ta no th ur hr bg lt la mi ml cy sk te fa "
    "lv bn sr az sl kn et mk br eu is hy ne mn bs kk sq sw gl mr pa si km sn yo so af oc ka be tg sd gu am yi lo uz fo ht ps tk nn "
    "mt sa lb my bo tl mg as tt haw ln ha ba jw su yue"
).split()
# Languages written in Latin letters.
LATIN = (
    "en es fr de it pt nl sv no da fi pl ro cs hu tr vi ca sk sl hr lt lv et id ms sw af eu gl cy is mt sq tl haw ln ha yo so oc br lb nn fo ht tk jw su mg mi sn la"
).split()
# Languages written without spaces between words.
NO_SPACE = ("ja", "zh", "yue", "ko")
# Languages with a normaliser of the Latin kind, and those of them whose apostrophe ends a clitic.
LATIN_NORMALIZED = "en fr de es it nl pt ca da sv id eu gl hr sl sk hu fi no nn ro tl vi tr cs pl lv".split()
CLITIC = ("fr", "it")


def parse(code: Column) -> Column:
    """Canonical code: named ones in lower case, others as they are.

    Two-letter codes are known in any case; three-letter ones only all lower, all upper, or with the
    case of the first letter alone unlike the others'.
    """
    low = F.lower(code)
    rest = F.substring(code, 2, 2)
    even = (rest == F.lower(rest)) | (rest == F.upper(rest))
    return F.when(low.isin(*LANGUAGES) & ((F.length(code) == 2) | even), low).otherwise(code)


def try_parse(code: Column) -> Column:
    """Canonical code of a named language, else null."""
    found = parse(code)
    return F.when(found.isin(*LANGUAGES), found)


def validate(code: Column) -> Column:
    """Canonical code from stored input: one to eight ASCII letters, unknown ones in lower case; null for any other."""
    return F.when(code.rlike("^[A-Za-z]{1,8}$"), F.coalesce(try_parse(code), F.lower(code)))


def is_latin(code: Column) -> Column:
    return code.isin(*LATIN)


def normalizer_kind(code: Column) -> Column:
    """latin, latin_clitic, chinese, japanese or korean; null if the language has no normaliser."""
    return (
        F.when(code.isin("zh", "yue"), "chinese").when(code == "ja", "japanese").when(code == "ko", "korean").when(code.isin(*CLITIC), "latin_clitic").when(code.isin(*LATIN_NORMALIZED), "latin")
    )


def uses_word_delimiter(code: Column) -> Column:
    """Whether words are joined by a delimiter token: only in languages of the Latin kind."""
    return normalizer_kind(code).startswith("latin")
