"""From normalised words to token ids: vocabulary lookup, out-of-vocabulary events and the policies for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.numeric import let

INTERNAL_PUNCT = "."
POLICIES = ("default", "wildcard_all", "fail_all")


@dataclass(frozen=True)
class Alphabet:
    """The single characters of a vocabulary and their ids; the driver knows its size."""

    characters: str
    ids: tuple[int, ...]

    @classmethod
    def of(cls, vocab: list[tuple[str, int]], uppercase: bool = False) -> Alphabet:
        """From (token, id) pairs; with uppercase, an ASCII small letter stands for its capital."""
        known = {t: i for t, i in vocab if len(t) == 1}
        if uppercase:
            known = {t: i for t, i in known.items() if not "a" <= t <= "z"}
            known |= {t.lower(): i for t, i in known.items() if "A" <= t <= "Z"}
        return cls("".join(known), tuple(known.values()))

    def spells(self, word: Column) -> Column:
        """Whether a word is made of these characters alone."""
        return ~word.rlike(self.others())

    def id_of(self, character: Column, missing: int | None = None) -> Column:
        """The id of a character; `missing` if it isn't in the vocabulary."""
        ids = F.array(F.lit(missing).cast("int"), *(F.lit(i) for i in self.ids))
        return F.get(ids, F.call_function("instr", F.lit(self.characters), character))

    def without(self, character: str) -> Alphabet:
        """The alphabet without one of its characters."""
        kept = [(c, i) for c, i in zip(self.characters, self.ids, strict=True) if c != character]
        return Alphabet("".join(c for c, _ in kept), tuple(i for _, i in kept))

    def others(self, more: str = "") -> str:
        """A pattern of one character outside the alphabet and a class's further members."""
        return "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in self.characters) + more + "]"


@dataclass(frozen=True)
class RowAlphabet:
    """An alphabet that each row brings along, as columns: its characters, and their ids in the same order."""

    characters: Column
    ids: Column
    left_out: str = ""

    def spells(self, word: Column) -> Column:
        """Whether a word is made of these characters alone."""
        return F.length(F.call_function("translate", word, self.characters, F.lit(""))) == 0

    def id_of(self, character: Column, missing: int | None = None) -> Column:
        """The id of a character; `missing` if it isn't in the vocabulary."""
        found = F.get(self.ids, F.call_function("instr", self.characters, character) - 1)
        known = F.when(F.length(character) == 1, found) if not self.left_out else F.when((F.length(character) == 1) & (character != self.left_out), found)
        return known if missing is None else F.coalesce(known, F.lit(missing))

    def without(self, character: str) -> RowAlphabet:
        """The alphabet without one of its characters."""
        return RowAlphabet(self.characters, self.ids, character)


def special_tokens(vocab: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """blank_id, unk_id and delimiter_id, and whether letters are upper case only; one row, or one for each value of the columns `by`."""
    at = lambda t: F.max(F.when(F.col("token") == t, F.col("id")))
    has = lambda t: F.coalesce(F.bool_or(F.col("token") == t), F.lit(False))
    return vocab.groupBy(*by).agg(
        F.coalesce(at("<pad>"), at("[PAD]"), at("<blank>")).alias("blank_id"),
        F.coalesce(at("<unk>"), at("[UNK]")).alias("unk_id"),
        at("|").alias("delimiter_id"),
        (has("A") & ~has("a")).alias("uppercase_only"),
    )


def ascii_upper(text: Column) -> Column:
    """a-z in upper case; every other character, such as ß, as it is."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _steps(word: Column, alphabet: Alphabet | RowAlphabet) -> Column:
    """The array of steps (kind, ch, id) of a word in order: prefix marks, characters, suffix marks. kind is null for a known character."""
    step = lambda kind, ch, i: F.struct(kind.alias("kind"), ch.alias("ch"), i.cast("int").alias("id"))
    none = F.lit(None).cast("string")
    edge = step(F.lit("boundary_punct"), none, F.lit(None))

    def of_char(c: Column) -> Column:
        return let(alphabet.id_of(c), lambda found: step(F.when(c == INTERNAL_PUNCT, "internal_punct").when(found.isNull(), "symbol").otherwise(none), c, F.when(c != INTERNAL_PUNCT, found)))

    return F.concat(F.array_repeat(edge, word["prefix"]), F.transform(_characters(word), of_char), F.array_repeat(edge, word["suffix"]))


def _plain(word: Column, alphabet: Alphabet | RowAlphabet) -> Column:
    """Whether a word, as most are, has no event: no mark at its edges, and known characters alone."""
    return (word["prefix"] == 0) & (word["suffix"] == 0) & alphabet.spells(word["word"])


def _characters(word: Column) -> Column:
    return F.split(word["word"], "")


#: Stands before each word with an event where words are put together; words that hold it have an event themselves.
_MARK = "\x01"


def oov_events(rows: DataFrame, words: Column, alphabet: Alphabet | RowAlphabet, keys: list[str]) -> DataFrame:
    """One row per event: keys, event (its order), kind, ch, char_index, word_index.

    char_index counts the characters of the normalised text, one for each space between words
    included; marks at a word's edges don't move it. Only words that have an event become rows; each
    brings along how many characters lie between the one before it and itself.
    """

    def of_words(held: Column) -> Column:
        put = F.array_join(F.transform(held, lambda x: F.when(x["plain"], x["w"]["word"]).otherwise(F.concat(F.lit(_MARK), F.translate(x["w"]["word"], _MARK, "\x02")))), " ")
        gaps = F.transform(F.split(put, _MARK), lambda x: F.length(x))
        return let(gaps, lambda g: F.transform(F.filter(held, lambda x: ~x["plain"]), lambda x, i: F.struct(i.alias("nth"), F.get(g, i).alias("gap"), x["word_index"].alias("word_index"), x["w"].alias("w"))))

    judged = F.transform(words, lambda w, i: F.struct(i.cast("int").alias("word_index"), w.alias("w"), _plain(w, alphabet).alias("plain")))
    # A row brings along its own word alone: no array of the whole text is repeated for each.
    own = [alphabet.characters.alias("_characters"), alphabet.ids.alias("_ids")] if isinstance(alphabet, RowAlphabet) else []
    each = rows.select(*keys, *own, F.explode(let(judged, of_words)).alias("_m"))
    if own:
        alphabet = RowAlphabet(F.col("_characters"), F.col("_ids"), alphabet.left_out)
    each = each.select(*keys, *(["_characters", "_ids"] if own else []), F.col("_m.nth").alias("_nth"), F.col("_m.gap").alias("_gap"), F.col("_m.word_index").alias("word_index"), F.col("_m.w").alias("w"))
    length = F.length("w.word")
    inside = lambda i: F.greatest(F.lit(0), F.least(i - F.col("w.prefix"), length))
    steps = F.transform(_steps(F.col("w"), alphabet), lambda s, i: F.struct(s["kind"].alias("kind"), s["ch"].alias("ch"), inside(i).alias("inside")))
    events = each.withColumn("_events", F.filter(steps, lambda s: s["kind"].isNotNull()))
    order = Window.partitionBy(*keys).orderBy("_nth")
    before = F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.coalesce(F.sum(F.size("_events")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = events.withColumns({"_before": before, "_earlier": earlier}).select(*keys, "word_index", "_before", "_earlier", F.posexplode("_events").alias("_k", "e"))
    return placed.select(*keys, (F.col("_earlier") + F.col("_k")).alias("event"), "e.kind", "e.ch", (F.col("_before") + F.col("e.inside")).alias("char_index"), "word_index")


# What the default policy lets a wildcard stand for.
SPEAKABLE = r"\p{IsAlphabetic}\p{N}'\x{2019}"


Policy = str | Callable[[Column, Column], Column]


def decide(kind: Column, ch: Column, policy: Policy = "default") -> Column:
    """wildcard or fail_closed for an event; a caller's own policy gives one of these from the event's kind and character."""
    if callable(policy):
        return policy(kind, ch)
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    if policy == "wildcard_all":
        return F.lit("wildcard")
    if policy == "fail_all":
        return F.lit("fail_closed")
    speakable = ch.rlike(f"^[{SPEAKABLE}]$")
    return F.when((kind != "symbol") | speakable, "wildcard").otherwise("fail_closed")


def _fails(words: Column, alphabet: Alphabet | RowAlphabet, policy: Policy) -> Column:
    """Whether the policy fails an event of the words; for the named ones and an alphabet that the driver knows, found in one pass over all words put together."""
    if callable(policy) or isinstance(alphabet, RowAlphabet):
        failed = lambda s: s["kind"].isNotNull() & (decide(s["kind"], s["ch"], policy) == "fail_closed")
        return F.exists(words, lambda w: ~_plain(w, alphabet) & F.coalesce(F.exists(_steps(w, alphabet), failed), F.lit(False)))
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    known, spoken = alphabet.without(INTERNAL_PUNCT), F.array_join(F.transform(words, lambda w: w["word"]), " ")
    if policy == "wildcard_all":
        return F.lit(False)
    if policy == "fail_all":
        return spoken.rlike(known.others(" ")) | F.exists(words, lambda w: (w["prefix"] > 0) | (w["suffix"] > 0))
    return spoken.rlike(known.others(r" \." + SPEAKABLE))


def spell(words: Column, alphabet: Alphabet | RowAlphabet, delimiter: int | Column | None) -> Column:
    """Struct (token_ids, word_idx): ids of all words, -1 for an event, the delimiter with a null word between words that have tokens."""
    known = alphabet.without(INTERNAL_PUNCT)
    none = F.array().cast("array<int>")
    # A word's group begins with the delimiter before it; the first of all is taken off at the end.
    lead = [] if delimiter is None else [F.array(F.lit(delimiter))]
    before = [] if delimiter is None else [F.array(F.lit(None).cast("int"))]

    def of_word(w: Column) -> Column:
        ids = F.transform(_characters(w), lambda c: known.id_of(c, -1))
        edge = lambda n: F.array_repeat(F.lit(-1), n)
        bare = (w["prefix"] == 0) & (w["suffix"] == 0)
        return F.when(bare & (F.length(w["word"]) == 0), none).when(bare, F.concat(*lead, ids)).otherwise(F.concat(*lead, edge(w["prefix"]), ids, edge(w["suffix"])))

    def of_groups(groups: Column) -> Column:
        index = F.transform(groups, lambda g, i: F.when(F.size(g) > 0, F.concat(*before, F.array_repeat(i.cast("int"), F.size(g) - len(lead)))).otherwise(none))
        rest = lambda x: x if delimiter is None else F.slice(x, 2, 1 << 30)
        return F.struct(rest(F.flatten(groups)).alias("token_ids"), rest(F.flatten(index)).alias("word_idx"))

    return let(F.transform(words, of_word), of_groups)


def tokenize(words: Column, alphabet: Alphabet | RowAlphabet, delimiter: int | Column | None, policy: Policy = "default") -> Column:
    """Struct (status, token_ids, word_idx) as `spell` gives them; status is semantic_oov, and there are no tokens, if the policy fails any event."""
    none = F.array().cast("array<int>")
    good = let(spell(words, alphabet, delimiter), lambda x: F.struct(F.lit("ok").alias("status"), x["token_ids"].alias("token_ids"), x["word_idx"].alias("word_idx")))
    return F.when(_fails(words, alphabet, policy), F.struct(F.lit("semantic_oov").alias("status"), none.alias("token_ids"), none.alias("word_idx"))).otherwise(good)


def verdict(words: Column, alphabet: Alphabet, policy: Policy = "default") -> Column:
    """ok, or semantic_oov if the policy fails any event."""
    return F.when(_fails(words, alphabet, policy), "semantic_oov").otherwise("ok")


def match_decisions(events: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """keys and matches: whether decisions name the same events in the same order, by kind, char_index and word_index but not language."""
    theirs = decisions.select(*keys, "event", F.col("kind").alias("_kind"), F.col("ch").alias("_ch"), F.col("char_index").alias("_char"), F.col("word_index").alias("_word"))
    met = events.join(theirs, [*keys, "event"], "full_outer")
    same = F.col("kind").eqNullSafe(F.col("_kind")) & F.col("ch").eqNullSafe(F.col("_ch")) & F.col("char_index").eqNullSafe(F.col("_char")) & F.col("word_index").eqNullSafe(F.col("_word"))
    return met.groupBy(*keys).agg(F.bool_and(same & F.col("kind").isNotNull()).alias("matches"))


def decided_status(events: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """keys and decided (ok or what is wrong) of every run that has events or decisions.

    decided: keys, event, kind, ch, char_index, word_index and decision. As many decisions as events
    must come (else decision_length), each for the event at its place by all but its language (else
    decision_event), and be wildcard or fail_closed (else unknown_decision); one of fail_closed leaves
    the run without tokens (semantic_oov). Of several rows for one event the least counts.
    """
    named = decided.where(F.col("event").isNotNull()).groupBy(*keys, "event").agg(F.min(F.struct(F.col("kind").alias("_kind"), F.col("ch").alias("_ch"), F.col("char_index").cast("long").alias("_char"), F.col("word_index").cast("long").alias("_word"), F.col("decision").alias("_decision"))).alias("_d"))
    met = events.withColumn("_ours", F.lit(True)).join(named.select(*keys, "event", "_d.*", F.lit(True).alias("_theirs")), [*keys, "event"], "full_outer")
    same = F.col("kind").eqNullSafe(F.col("_kind")) & F.col("ch").eqNullSafe(F.col("_ch")) & F.col("char_index").eqNullSafe(F.col("_char")) & F.col("word_index").eqNullSafe(F.col("_word"))
    known = F.coalesce(F.col("_decision").isin("wildcard", "fail_closed"), F.lit(False))
    status = (
        F.when(F.count("_ours") != F.count("_theirs"), "decision_length").when(~F.bool_and(same), "decision_event")
        .when(~F.bool_and(known), "unknown_decision").when(F.bool_or(F.col("_decision") == "fail_closed"), "semantic_oov").otherwise("ok")
    )
    return met.groupBy(*keys).agg(status.alias("decided"))


def apply_decisions(spelled: DataFrame, events: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """spelled with what the decisions make of it: status where it was ok, and no tokens where that no longer holds.

    spelled: keys, status, token_ids and word_idx, with a wildcard in the place of every event, as under
    wildcard_all. A run without events or decisions is left as it is.
    """
    judged = decided_status(events, decided, keys)
    status = F.when(F.col("status") != "ok", F.col("status")).otherwise(F.coalesce("decided", F.lit("ok")))
    met = spelled.join(judged, keys, "left").withColumn("status", status).drop("decided")
    none = F.array().cast("array<int>")
    return met.withColumns({c: F.when(F.col("status") == "ok", F.col(c)).otherwise(none) for c in ("token_ids", "word_idx")})


def restamp(events: DataFrame, language: Column) -> DataFrame:
    """Events under the language that was asked for, when a fallback aligner found them."""
    return events.withColumn("language", language)


def vocabulary_frame(spark: SparkSession, vocab: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(vocab, "token string, id int")
