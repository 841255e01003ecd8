"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.numeric import let
from spanloom.llm.common import WORD

WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is it that was he for on are with as his they be at one have this from or had by not but "
    "le la les de des du et un une en que qui il elle est pour dans au aux ce pas sur par "
    "der die das und den dem ein eine zu von mit ist sich nicht auf als auch es an wie "
    "el los las del y que se por con para su al lo como más pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if `measure` is under `least` or over `most`; rules with min_words spare shorter texts."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    min_words: int = 0


#: Lengths are in words or characters, ratios in parts of one.
RULES = (
    Rule("words", "n_words", least=20),
    Rule("repeats", "repeat_ratio", most=0.30),
    Rule("word_length", "mean_word_chars", least=1.5, most=25.0),
    Rule("symbols", "symbol_ratio", most=0.10),
    Rule("stop_words", "stop_word_ratio", least=0.01, min_words=50),
    Rule("repeated_lines", "dup_line_ratio", most=0.60),
    Rule("bullets", "bullet_line_ratio", most=0.90, min_words=50),
    Rule("ellipses", "ellipsis_line_ratio", most=0.50, min_words=50),
)


def _repeat_words(words: Column) -> Column:
    """Words inside the 8-word windows that occur more than once in the list.

    Windows are compared by 64-bit hashes. Only a list with a repeated window sorts them; the
    starts of repeated windows, in order, then add the words that the one before didn't cover.
    """

    def of_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        windows = F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
        return F.when(F.size(h) < WINDOW, 0).otherwise(let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
            marked = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
            return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

        step = lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"))
        return F.aggregate(let(ordered, repeated), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def base_counts(text: Column) -> Column:
    """Struct of the counts that the rules' measures are made of; a null text has no words."""
    whole = F.coalesce(text, F.lit(""))
    stop = [F.lit(w) for w in dict.fromkeys(STOP_WORDS)]

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*stop))).alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣·]"))).alias("n_bullets"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias("n_ellipses"),
        )

    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(F.regexp_extract_all(whole, F.lit(f"({WORD})"), F.lit(1)), of_words).alias("words"),
        let(lines, of_lines).alias("lines"),
    )


def measures(c: Column) -> dict[str, Column]:
    """The rules' measures from the struct of base counts; a ratio of nothing is null and breaks no rule."""
    words, lines = c["words"], c["lines"]
    n_words, n_lines = F.nullif(words["n_words"], F.lit(0)), F.nullif(lines["n_lines"], F.lit(0))
    return {
        "n_words": words["n_words"],
        "repeat_ratio": words["n_repeat_words"] / n_words,
        "mean_word_chars": c["word_chars"] / n_words,
        "symbol_ratio": c["n_symbols"] / F.nullif(c["word_chars"], F.lit(0)),
        "stop_word_ratio": words["n_stop_words"] / n_words,
        "dup_line_ratio": lines["n_dup_lines"] / n_lines,
        "bullet_line_ratio": lines["n_bullets"] / n_lines,
        "ellipsis_line_ratio": lines["n_ellipses"] / n_lines,
    }


def broken(rule: Rule, measured: dict[str, Column]) -> Column:
    """Whether a document breaks a rule."""
    x, out = measured[rule.measure], F.lit(False)
    if rule.least is not None:
        out = out | (x < rule.least)
    if rule.most is not None:
        out = out | (x > rule.most)
    return F.coalesce(out & (measured["n_words"] >= rule.min_words), F.lit(False))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the names of the rules broken, for every row.

    A null or empty text has no words, fails the base rules and isn't kept. Null doc_ids stay,
    repeated rows give repeated results, an empty table none; only doc_id and text are read.
    """
    c = F.col("counts")
    n_words, n_repeat = c["words"]["n_words"], c["words"]["n_repeat_words"]
    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    measured = measures(c)
    names = F.filter(F.array(*(F.when(broken(r, measured), r.name) for r in rules)), lambda x: x.isNotNull())
    return docs.select("doc_id", base_counts(F.col("text")).alias("counts")).select(
        "doc_id",
        n_words.alias("n_words"),
        c["word_chars"].alias("word_chars"),
        c["n_symbols"].alias("n_symbols"),
        c["lines"]["n_dup_lines"].alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & (F.size(names) == 0)).alias("kept"),
        F.array_join(names, " ").alias("broken_rules"),
    )


def _rule_sql(rule: Rule, expression: str) -> str:
    sides = [f"{expression} {op} {x}::DOUBLE" for op, x in (("<", rule.least), (">", rule.most)) if x is not None]
    return f"coalesce(({' OR '.join(sides)}) AND n_words >= {rule.min_words}, false)"


_MEASURE_SQL = {
    "n_words": "n_words",
    "repeat_ratio": "n_repeat_words::DOUBLE / nullif(n_words, 0)",
    "mean_word_chars": "word_chars::DOUBLE / nullif(n_words, 0)",
    "symbol_ratio": "n_symbols::DOUBLE / nullif(word_chars, 0)",
    "stop_word_ratio": "n_stop::DOUBLE / nullif(n_words, 0)",
    "dup_line_ratio": "n_dup_lines::DOUBLE / nullif(n_lines, 0)",
    "bullet_line_ratio": "n_bullets::DOUBLE / nullif(n_lines, 0)",
    "ellipsis_line_ratio": "n_ellipses::DOUBLE / nullif(n_lines, 0)",
}
_WINDOW_SQL = "concat_ws(' ', w, " + ", ".join(f"lead(w, {k}) OVER o" for k in range(1, WINDOW)) + ")"
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)) + "]"
#: The same verdicts, with windows compared word by word; doc_id is unique in the tables.
RULES_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM docs
), starts AS (
  SELECT doc_id, i, {_WINDOW_SQL} AS body, lead(w, {WINDOW - 1}) OVER o IS NOT NULL AS whole FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, body) AS times FROM starts WHERE whole
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM windows WHERE times > 1) GROUP BY doc_id
), counts AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: len(w))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(words, lambda w: list_contains({_STOP_SQL}, lower(w)))) AS n_stop,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣·]'))) AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses
  FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    list_filter([{", ".join(f"CASE WHEN {_rule_sql(r, _MEASURE_SQL[r.measure])} THEN '{r.name}' END" for r in RULES)}], lambda x: x IS NOT NULL) AS names FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(names) = 0 AS kept, coalesce(array_to_string(names, ' '), '') AS broken_rules FROM judged
"""
