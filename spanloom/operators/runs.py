"""Splitting segment texts into runs of one language, with time bounds for each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.clock import MAX_LONG, MIN_LONG, cs_to_ms, div, ms_to_samples, saturating_add
from spanloom.functions.script import COMMON, HAN, HANGUL, KANA, LATIN_LETTER, has_hangul, has_kana, language_of

#: Bytes of a cell in which runs and tokens meet.
CELL = 256


def _stretch(own: str) -> str:
    """A character of a class and those of the class or of no script of their own after it."""
    return f"{own}(?:{own}|{COMMON})*+"


_CLASSES = (KANA, HANGUL, HAN, LATIN_LETTER)
_OTHER = f"(?!{COMMON}|{'|'.join(_CLASSES)})(?s:.)"
#: A stretch of one class; characters of no script before the first one belong to it.
STRETCH = f"(?:^{COMMON}++)?+(?:{'|'.join(map(_stretch, (*_CLASSES, _OTHER)))})"


def carve(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of each segment's text: keys, run, language, text, byte_start, byte_end, char_start, char_end, n_chars.

    segments: keys, text and state_lang. Characters of no script of their own carry on; leading ones
    join the first run, and a text of such characters alone has no run. Empty and null texts have
    none. Texts are split where the script changes, so rows are as many as stretches, not characters.
    """
    stretches = F.regexp_extract_all("text", F.lit(f"({STRETCH})"), F.lit(0))
    rows = segments.select(*keys, "state_lang", has_kana(F.col("text")).alias("_kana"), has_hangul(F.col("text")).alias("_hangul"), F.char_length("text").alias("n_chars"), F.posexplode(stretches).alias("_i", "_s"))
    order = Window.partitionBy(*keys).orderBy("_i")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    first = F.regexp_extract("_s", f"^{COMMON}*+((?s:.))", 1)
    classed = rows.withColumn("_own", language_of(first, F.col("_kana"), F.col("_hangul"), F.col("state_lang")))
    carried = classed.withColumn("_lang", F.coalesce(F.last("_own", True).over(so_far), F.first("_own", True).over(order.rowsBetween(0, Window.unboundedFollowing))))
    sums = {"_at": F.coalesce(F.sum(F.octet_length("_s")).over(before), F.lit(0)), "_char": F.coalesce(F.sum(F.char_length("_s")).over(before), F.lit(0)), "_new": F.when(F.col("_lang") == F.lag("_lang").over(order), 0).otherwise(1)}
    numbered = carried.where(F.col("_lang").isNotNull()).withColumns(sums).withColumn("run", F.sum("_new").over(so_far) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda x: x["_s"]), "")
    ends = {"byte_end": F.max(F.col("_at") + F.octet_length("_s")), "char_end": F.max(F.col("_char") + F.char_length("_s")).cast("int")}
    found = numbered.groupBy(*keys, "run", "_lang", "n_chars").agg(text.alias("text"), F.min("_at").alias("byte_start"), F.min("_char").cast("int").alias("char_start"), *(x.alias(n) for n, x in ends.items()))
    return found.select(*keys, "run", F.col("_lang").alias("language"), F.col("n_chars").cast("bigint").alias("n_chars"), "text", "byte_start", "byte_end", "char_start", "char_end")


def run_times(runs: DataFrame, tokens: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """lo_dtw, hi_dtw and all_timed of each run, from the tokens inside its bytes.

    runs: keys, run, byte_start, byte_end and more. tokens: keys, byte_offset, byte_len and t_dtw_cs. A
    token across a run's edge leaves the run without complete times, as does a run without tokens.

    Runs and tokens of a segment meet by cells of bytes, each pair in the one cell in which its overlap
    begins, so the rows are as many as the pairs that overlap, however long the segment is.
    """
    start, end = F.col("byte_offset"), F.col("byte_offset") + F.col("byte_len")
    cells = lambda a, b: F.explode(F.sequence(div(a, F.lit(cell)), div(b - 1, F.lit(cell))))
    spans = runs.where("byte_end > byte_start").select(*keys, "run", "byte_start", "byte_end", cells(F.col("byte_start"), F.col("byte_end")).alias("_cell"))
    timed = tokens.where("byte_len > 0").select(*keys, start.alias("_b"), end.alias("_e"), "t_dtw_cs", cells(start, end).alias("_cell"))
    first = F.greatest("_b", "byte_start")
    met = spans.join(timed, [*keys, "_cell"]).where((F.least("_e", "byte_end") > first) & (div(first, F.lit(cell)) == F.col("_cell")))
    inside = (F.col("_b") >= F.col("byte_start")) & (F.col("_e") <= F.col("byte_end"))
    found = met.groupBy(*keys, "run").agg(
        F.min(F.when(inside, F.col("t_dtw_cs"))).alias("lo_dtw"),
        F.max(F.when(inside, F.col("t_dtw_cs"))).alias("hi_dtw"),
        F.bool_and(inside & F.col("t_dtw_cs").isNotNull()).alias("all_timed"),
    )
    joined = runs.join(found, [*keys, "run"], "left")
    return joined.select(*runs.columns, "lo_dtw", "hi_dtw", F.coalesce("all_timed", F.lit(False)).alias("all_timed"))


def bound(runs: DataFrame, keys: list[str]) -> DataFrame:
    """t0_ms, t1_ms and bounds_source (dtw, segment or wholeclip) of each run.

    runs: as run_times gives them, with the segment's t0_cs and t1_cs (null: unknown). Complete token
    times come first, up to where the next run begins; then the segment's times, shared out by
    characters among several runs; then the whole clip.
    """
    order = Window.partitionBy(*keys).orderBy("run")
    known = F.col("t0_cs").isNotNull() & F.col("t1_cs").isNotNull()
    span = F.try_subtract("t1_cs", "t0_cs")
    share = lambda c: F.round(F.col("t0_cs").cast("double") + c.cast("double") / F.col("n_chars") * span.cast("double")).cast("bigint")
    own_lo = F.when(F.col("all_timed") & F.col("lo_dtw").isNotNull(), F.col("lo_dtw")).when(known & span.isNotNull() & (F.col("n_chars") > 0), share(F.col("char_start")))
    several = F.count("*").over(Window.partitionBy(*keys)) > 1
    rows = runs.withColumn("_own_lo", own_lo).withColumn("_next_lo", F.lead("_own_lo").over(order)).withColumn("_several", several)
    exclusive = (
        F.when(F.col("_next_lo").isNotNull(), F.when(F.col("_next_lo") > F.col("lo_dtw"), F.least("_next_lo", F.coalesce("t1_cs", "_next_lo"))))
        .when(F.col("t1_cs") > F.col("hi_dtw"), F.col("t1_cs"))
        .otherwise(saturating_add(F.col("hi_dtw"), F.lit(1).cast("bigint")))
    )
    rows = rows.withColumn("_hi", exclusive)
    dtw = F.coalesce(F.col("all_timed") & F.col("lo_dtw").isNotNull() & (F.col("_hi") > F.col("lo_dtw")), F.lit(False))
    lo, hi = share(F.col("char_start")), share(F.col("char_end"))
    whole = ~known | (F.col("_several") & span.isNull())
    # A next run that begins no later leaves no room, and the run's own times don't count.
    pick = lambda a, b, c, d: F.when(dtw, a).when(whole, b).when(~F.col("_several"), c).otherwise(d)
    return rows.select(
        *runs.columns,
        pick(cs_to_ms(F.col("lo_dtw")), F.lit(MIN_LONG), cs_to_ms(F.col("t0_cs")), cs_to_ms(lo)).alias("t0_ms"),
        pick(cs_to_ms(F.col("_hi")), F.lit(MAX_LONG), cs_to_ms(F.col("t1_cs")), cs_to_ms(F.greatest(hi, lo + 1))).alias("t1_ms"),
        pick(F.lit("dtw"), F.lit("wholeclip"), F.lit("segment"), F.lit("segment")).alias("bounds_source"),
    )


def check_token_bytes(tokens: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens with byte_len set to 0, and so without times, where a segment's token texts don't spell its text."""
    spelled = tokens.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("byte_offset", "piece"))), lambda x: x["piece"]), "").alias("_spelled"))
    sound = spelled.join(segments, keys).select(*keys, (F.col("_spelled") == F.col("text")).alias("_sound"))
    return tokens.join(sound, keys, "left").withColumn("byte_len", F.when(F.col("_sound"), F.col("byte_len")).otherwise(0)).drop("_sound")


def slice_bounds(t0_ms: Column, t1_ms: Column, source: Column, clip_samples: Column) -> Column:
    """Struct (lo, hi) of a run's samples in its clip: all of it for wholeclip, none for an empty or negative range."""
    lo, hi = F.least(ms_to_samples(t0_ms), clip_samples), F.least(ms_to_samples(t1_ms), clip_samples)
    empty = (t0_ms < 0) | (t1_ms <= t0_ms) | (lo >= hi)
    pair = lambda a, b: F.struct(a.cast("bigint").alias("lo"), b.cast("bigint").alias("hi"))
    return F.when(source == "wholeclip", pair(F.lit(0), clip_samples)).when(empty, pair(F.lit(0), F.lit(0))).otherwise(pair(lo, hi))


def telemetry(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per chunk, runs by the source of their bounds and those left unaligned."""
    count = lambda s: F.count_if(F.col("bounds_source") == s).alias(f"n_{s}")
    return runs.groupBy(*keys).agg(count("dtw"), count("segment"), count("wholeclip"), F.count_if(~F.coalesce("aligned", F.lit(False))).alias("n_unaligned"))
