"""Line deduplication by winnowing over hashes of lines and of the sentences in them, in built-in expressions only.

A text's units are its lines, and a line's sentences where it has several; those without a word don't
count. Of every WINDOW consecutive units the one of least hash is selected (the last of equals);
longer units, up to ENOUGH characters, have lesser hashes, as they say more. So every run of WINDOW units or more holds a
fingerprint, inside a line as well as over many lines, and the other units are looked up nowhere. A
fingerprint's later positions are joined to its place before: in the same document if there is one,
else its first place of all. Matches on one diagonal of two documents that are near each other are
taken together and extended both ways, unit by unit, as far as the units agree: by REACH units at
first, and where that isn't the end by ever more. A run is deleted if it has LEAST characters, of which
a unit counts ENOUGH at most and a line that is one unit half of LEAST at least; so two lines are enough.

A line that stands alone can be shorter than the guarantee, or its fingerprint's first place be
elsewhere, so whole lines are looked up as well: a later equal line is deleted; one of one word only
if it stands COMMON times or more. Documents are in order of doc_id. Of any unit and line at least
the first occurrence stays, as a deleted one always has an equal one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions.numeric import let
from spanloom.llm.common import cut, fresh

#: Units of a window, those that a match is first extended by, characters of a run and of a unit in it, and lines from which one of one word counts as repeated.
WINDOW, REACH, LEAST, ENOUGH, COMMON = 2, 8, 120, 96, 4
#: How much further each round extends.
FURTHER = 8
_WORD = r"[^\x20\x09-\x0D]+"
_HAS_WORD = r"[^\x20\x09-\x0D]"
_BETWEEN = r"[\x20\x09-\x0D]"
#: Sentence marks beyond ASCII would take the matcher fifteen times as long; other scripts' lines are units as a whole.
_SENTENCE = "[^.!?]*[.!?]+[ \t]*|[^.!?]+"
_BLANK = " \t\n\x0b\x0c\r"
_DOC = ["doc", "key"]


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _pieces(text: Column) -> Column:
    """t, line (0-based) and whole (whether it is its line's only one) of a text's sentences, with a line break as a piece before every line but the first."""

    def of_line(line: Column, no: Column) -> Column:
        ends = F.when(no > 0, F.array(F.lit("\n"))).otherwise(F.array().cast("array<string>"))
        # Found once for a line, not once for each of its sentences.
        return let(F.regexp_extract_all(line, F.lit(_SENTENCE), F.lit(0)), lambda found: F.transform(F.concat(ends, found), lambda t: F.struct(t.alias("t"), no.alias("line"), (F.size(found) == 1).alias("whole"))))

    return F.flatten(F.transform(_split(text), of_line))


def _md5(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def hashed_units(docs: DataFrame) -> DataFrame:
    """doc, key, units (hashes), weights and lines (h and line) of every document with a word.

    A unit's hash has above 56 bits how many of ENOUGH characters it lacks; a line's is odd if it has several words. Rows that agree in doc_id and
    text are one document; doc is the doc_id, least for a null one.
    """

    def unit(x: Column) -> Column:
        def counted(body: Column) -> Column:
            length = F.least(F.lit(ENOUGH), F.char_length(body))
            weight = F.when(x["whole"], F.greatest(length, F.lit(LEAST // 2))).otherwise(length)
            return F.when(body != "", F.struct((F.shiftleft((ENOUGH - length).cast("long"), 56) + _md5(body, 14)).alias("h"), weight.cast("tinyint").alias("weight")))

        return let(F.btrim(x["t"], F.lit(_BLANK)), counted)

    def line(x: Column, no: Column) -> Column:
        def hashed(body: Column) -> Column:
            several = body.rlike(_BETWEEN).cast("long")
            return F.when(body != "", F.struct((F.shiftleft(F.xxhash64(x), 1) + several).alias("h"), no.alias("line")))

        return let(F.btrim(x, F.lit(_BLANK)), hashed)

    there = lambda x: x.isNotNull()
    units, lines = F.filter(F.transform(_pieces(F.col("text")), unit), there), F.filter(F.transform(_split(F.col("text")), line), there)
    each = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), _text_key(F.col("text")).alias("key"), units.alias("u"), lines.alias("lines")).dropDuplicates(_DOC)
    # Only now, as a condition before would make the units twice.
    return each.select("doc", "key", F.col("u.h").alias("units"), F.col("u.weight").alias("weights"), "lines").where(F.size("units") > 0)


def selected(hashed: DataFrame) -> DataFrame:
    """doc, key and s, a document's selected units as an array of h, i and before: hash, number, and where the same one was selected before (null: nowhere)."""
    n = F.size("units")

    def least(start: Column) -> Column:
        numbered = ((start + k, F.get("units", start + k)) for k in range(WINDOW))
        return F.least(*(F.when(i < n, F.struct(h.alias("h"), (-i).alias("back"))) for i, h in numbered))

    # Windows that select the same unit follow each other; distinct structs would be told apart pair by pair.
    each_window = F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), least)
    chosen = let(each_window, lambda found: F.filter(found, lambda s, k: (k == 0) | (s["back"] != F.get(found, k - 1)["back"])))
    sorted_ = hashed.select("doc", "key", F.sort_array(F.transform(chosen, lambda s: F.struct(s["h"].alias("h"), (-s["back"]).alias("i")))).alias("s"))
    before = lambda x, k: F.when(F.get("s", k - 1)["h"] == x["h"], F.get("s", k - 1)["i"])
    return sorted_.select("doc", "key", F.transform("s", lambda x, k: F.struct(x["h"].alias("h"), x["i"].alias("i"), before(x, k).alias("before"))).alias("s"))


def fingerprints(chosen: DataFrame) -> DataFrame:
    """doc, key, h, i and before of every selected unit."""
    return chosen.select("doc", "key", F.explode("s").alias("s")).select("doc", "key", "s.h", "s.i", "s.before")


def matches(hashed: DataFrame) -> DataFrame:
    """doc, key, i, doc_0, key_0 and i_0: every fingerprint that stands elsewhere before, with its place there."""
    # Kept, as it is read three times.
    marks = fingerprints(cut(selected(hashed)))
    own = marks.where("before IS NOT NULL").select("doc", "key", "i", F.col("doc").alias("doc_0"), F.col("key").alias("key_0"), F.col("before").alias("i_0"))
    others = marks.where("before IS NULL")
    # A table cut before it is joined, so that Spark may split a frequent unit's side.
    counted = others.groupBy("h").agg(F.min(F.struct("doc", "key", "i")).alias("first"), F.count("*").alias("places"))
    first = cut(counted.where("places > 1").select("h", F.col("first.doc").alias("doc_0"), F.col("first.key").alias("key_0"), F.col("first.i").alias("i_0")))
    return own.unionByName(others.join(first, "h").where("doc <> doc_0 OR key <> key_0").select("doc", "key", "i", "doc_0", "key_0", "i_0"))


def _extended(near: DataFrame, hashed: DataFrame, reach: int) -> DataFrame:
    """near with runs (lo, hi and weight of each run of agreeing units that holds a match) and whether one of them may go on beyond `reach` units."""
    shift, own = F.col("shift"), hashed.select("doc", "key", "units", "weights")
    first, last = F.element_at("marks", 1), F.element_at("marks", -1)
    low = F.greatest(first - reach, F.lit(0), shift)
    here = near.join(own, _DOC).withColumn("lo", low).withColumn("hi", F.least(last + reach, F.size("units") - 1))
    here = here.withColumn("most", F.size("units") - 1).withColumn("a", F.expr("slice(units, lo + 1, hi - lo + 1)")).withColumn("w", F.expr("slice(weights, lo + 1, hi - lo + 1)")).drop("units", "weights")
    there = hashed.select(F.col("doc").alias("doc_0"), F.col("key").alias("key_0"), F.col("units").alias("units_0"))
    met = here.join(there, ["doc_0", "key_0"]).withColumn("most", F.least("most", F.size("units_0") - 1 + shift)).withColumn("hi", F.least("hi", "most"))
    # Compared in one pass: an expression used inside a function of elements would be made anew for each.
    same = F.zip_with(F.slice("a", F.lit(1), F.col("hi") - F.col("lo") + 1), F.slice("units_0", F.col("lo") - shift + 1, F.col("hi") - F.col("lo") + 1), lambda x, y: x == y)
    agree = F.filter(F.transform(same, lambda x, k: F.when(x, k)), lambda k: k.isNotNull())
    met = met.withColumn("agree", agree).drop("units_0")
    begins = F.filter("agree", lambda k, n: (n == 0) | (F.get("agree", n - 1) < k - 1))
    ends = F.filter("agree", lambda k, n: (n == F.size("agree") - 1) | (F.get("agree", n + 1) > k + 1))
    run = lambda s, e: F.struct((s + F.col("lo")).alias("lo"), (e + F.col("lo")).alias("hi"), F.aggregate(F.slice("w", s + 1, e - s + 1), F.lit(0), lambda t, x: t + x).alias("weight"))
    runs = F.filter(F.zip_with(begins, ends, run), lambda r: F.exists("marks", lambda m: (m >= r["lo"]) & (m <= r["hi"])))
    met = met.withColumn("runs", runs)
    further = F.exists("runs", lambda r: ((r["lo"] == F.col("lo")) & (r["lo"] > F.greatest(F.lit(0), shift))) | ((r["hi"] == F.col("hi")) & (r["hi"] < F.col("most"))))
    return met.select(*near.columns, "runs", further.alias("further"))


def later_runs(hashed: DataFrame) -> DataFrame:
    """doc, key, lo and hi: the first and the last number, among a document's units, of every run that stood before and has LEAST characters."""
    found = matches(hashed).withColumn("shift", F.col("i") - F.col("i_0")).repartition(*_DOC)
    diagonal = [*_DOC, "doc_0", "key_0", "shift"]
    order = Window.partitionBy(*diagonal).orderBy("i")
    apart = F.when(F.col("i") - F.lag("i").over(order) > REACH, 1).otherwise(0)
    group = F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0))
    near = found.withColumn("apart", apart).withColumn("group", group).groupBy(*diagonal, "group").agg(F.sort_array(F.collect_list("i")).alias("marks")).drop("group")
    reach, out = REACH, None
    while True:
        met = cut(_extended(near, hashed, reach))
        done = met.where("NOT further").select("doc", "key", F.inline("runs"))
        out = done if out is None else out.unionByName(done)
        near, reach = met.where("further").select(*diagonal, "marks"), reach * FURTHER
        if not near.take(1):
            return out.where(F.col("weight") >= LEAST).select("doc", "key", "lo", "hi")


def lone_lines(hashed: DataFrame) -> DataFrame:
    """doc, key and line of every whole line that stood before; of one word, only if it stands COMMON times."""
    each = hashed.select("doc", "key", F.explode("lines").alias("x")).select(F.col("x.h").alias("h"), F.struct("doc", "key", F.col("x.line").alias("line")).alias("place"))
    counted = each.groupBy("h").agg(F.min("place").alias("first"), F.count("*").alias("places"))
    often = cut(counted.where(F.col("places") >= F.when(F.col("h") % 2 != 0, 2).otherwise(COMMON)).select("h", "first"))
    return each.join(often, "h").where("place > first").select("place.*")


def repeated(docs: DataFrame) -> DataFrame:
    """doc, key, runs and lines: what to delete of a document, as runs of its units and as whole lines, for the documents that have any."""
    hashed = cut(hashed_units(docs))
    none = lambda kind: F.lit(None).cast(kind)
    run, line = "struct<lo:int,hi:int>", "int"
    rows = later_runs(hashed).distinct().select("doc", "key", F.struct("lo", "hi").cast(run).alias("run"), none(line).alias("line"))
    rows = rows.unionByName(lone_lines(hashed).select("doc", "key", none(run).alias("run"), F.col("line").cast(line)))
    return rows.groupBy(*_DOC).agg(F.collect_list("run").alias("runs"), F.collect_list("line").alias("gone_lines"))


def _without(text: Column, runs: Column, gone_lines: Column) -> Column:
    """text, and numbers of lines that went and that were shortened, as a struct."""
    empty = F.array().cast("array<int>")
    numbers = lambda first, size: F.when(size > 0, F.sequence(first, first + size - 1)).otherwise(empty)

    def of_pieces(p: Column) -> Column:
        # at: the pieces with a word; starts: where each line begins, and where the last one ends.
        at = F.filter(F.transform(p, lambda x, i: F.when(x["t"].rlike(_HAS_WORD), i)), lambda i: i.isNotNull())
        starts = F.concat(F.array(F.lit(0)), F.filter(F.transform(p, lambda x, i: F.when(x["t"] == "\n", i)), lambda i: i.isNotNull()), F.array(F.size(p)))
        return let(F.struct(p.alias("p"), at.alias("at"), starts.alias("starts")), of_places)

    def of_places(c: Column) -> Column:
        p, at, starts = c["p"], c["at"], c["starts"]
        span = lambda line: numbers(F.get(starts, line), F.get(starts, line + 1) - F.get(starts, line))
        in_runs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(r["lo"], r["hi"]), lambda u: F.get(at, u))))
        gone = F.array_distinct(F.concat(in_runs, F.flatten(F.transform(gone_lines, span))))
        line_of = lambda i: F.get(p, i)["line"]
        worded = F.array_distinct(F.transform(at, line_of))
        left = F.array_distinct(F.transform(F.array_except(at, gone), line_of))
        emptied = F.array_except(worded, left)
        cut_lines = F.array_intersect(F.array_distinct(F.transform(F.array_intersect(gone, at), line_of)), left)
        kept = F.array_except(numbers(F.lit(0), F.size(p)), F.array_union(gone, F.flatten(F.transform(emptied, span))))
        body = F.array_join(F.transform(kept, lambda i: F.get(p, i)["t"]), "")
        # A line break goes with the line after it, so it is one too many where the first line went.
        body = let(body, lambda b: F.when(b.startswith("\n") & F.array_contains(emptied, 0), F.substring(b, 2, 1 << 30)).otherwise(b))
        return F.struct(body.alias("text"), F.size(emptied).cast("long").alias("n_removed"), F.size(cut_lines).cast("long").alias("n_shortened"))

    return let(_pieces(text), of_pieces)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of docs with the text's later repeated runs deleted, and n_lines, n_removed and n_shortened beside them.

    n_removed counts lines of which no word is left, which go with their line break; n_shortened those
    that have lost sentences. Null texts stay null and have no lines; lines without a word are never
    counted as repeated and stay. Rows that agree in doc_id and text are one document and keep the same
    text; those that agree in doc_id alone are ordered by a hash of their text, null ids first. An
    empty table gives none. Other columns are carried along; own columns named as the new ones are
    replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "n_shortened")
    gone_doc, gone_key, key, runs, lines, done = (fresh(docs, name) for name in ("gone_doc", "gone_key", "key", "runs", "gone_lines", "done"))
    # Kept apart from the join, so that Spark may split the side of a document that very many rows repeat.
    gone = cut(repeated(docs)).select(F.col("doc").alias(gone_doc), F.col("key").alias(gone_key), F.col("runs").alias(runs), F.col("gone_lines").alias(lines)).hint("shuffle_hash")
    keyed = docs.withColumn(key, _text_key(F.col("text")))
    joined = keyed.join(gone, (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col(gone_doc)) & (F.col(key) == F.col(gone_key)), "left")
    joined = joined.withColumn(done, F.when(F.col(gone_doc).isNotNull(), _without(F.col("text"), F.col(runs), F.col(lines))))
    text = F.when(F.col(done).isNull(), F.col("text")).otherwise(F.col(done)["text"])
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.coalesce(breaks + 1, F.lit(0))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    count = lambda name: F.coalesce(F.col(done)[name], F.lit(0)).cast("long").alias(name)
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), count("n_removed"), count("n_shortened"))


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_shortened, n_chars and text_sha256 of every text after deduplication."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "n_shortened", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


#: The same rows by comparing whole units and lines; md5 orders the units of a window. doc_id is unique in the tables.
SUMMARY_SQL = rf"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS text, text IS NULL AS absent, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), numbered AS (
  SELECT doc_id, i - 1 AS line, parts[i] AS body FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM raw)
), sentences AS (
  SELECT doc_id, line, k, t[k] AS t, len(t) = 1 AS whole FROM (
    SELECT doc_id, line, t, unnest(range(1, len(t) + 1)) AS k FROM (SELECT doc_id, line, regexp_extract_all(body, '{_SENTENCE}') AS t FROM numbered))
), units AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line, k) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, least({ENOUGH}, len(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS size,
    trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM sentences WHERE regexp_matches(t, '{_HAS_WORD}')
), windows AS (
  SELECT doc_id, i, body, size, unnest(range(greatest(i - {WINDOW - 1}, 0), least(i, greatest(n - {WINDOW}, 0)) + 1)) AS s FROM units
), marks AS (
  SELECT DISTINCT doc_id, i, body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY size DESC, substr(md5(body), 1, 14), i DESC) AS nth FROM windows) WHERE nth = 1
), placed AS (
  SELECT *, lag(i) OVER (PARTITION BY doc_id, body ORDER BY i) AS before FROM marks
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS nth FROM placed WHERE before IS NULL
), met AS (
  SELECT doc_id, i, doc_id AS doc_0, i - before AS shift FROM placed WHERE before IS NOT NULL
  UNION ALL
  SELECT a.doc_id, a.i, b.doc_id, a.i - b.i FROM firsts a JOIN firsts b ON a.body = b.body AND a.nth > 1 AND b.nth = 1
), agreeing AS (
  SELECT m.doc_id, m.doc_0, m.shift, u.i, CASE WHEN u.whole THEN greatest(u.size, {LEAST // 2}) ELSE u.size END AS weight
  FROM (SELECT DISTINCT doc_id, doc_0, shift FROM met) m JOIN units u ON u.doc_id = m.doc_id JOIN units v ON v.doc_id = m.doc_0 AND v.i = u.i - m.shift AND v.body = u.body
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, doc_0, shift ORDER BY i) AS island FROM agreeing
), runs AS (
  SELECT a.doc_id, a.doc_0, a.shift, island FROM islands a LEFT JOIN met m ON m.doc_id = a.doc_id AND m.doc_0 = a.doc_0 AND m.shift = a.shift AND m.i = a.i
  GROUP BY ALL HAVING count(m.i) > 0 AND sum(weight) >= {LEAST}
), covered AS (
  SELECT DISTINCT doc_id, i FROM islands SEMI JOIN runs USING (doc_id, doc_0, shift, island)
), whole_lines AS (
  SELECT *, len(regexp_extract_all(body, '{_WORD}')) = 1 AS one, row_number() OVER (PARTITION BY body ORDER BY doc_id, line) AS nth, count(*) OVER (PARTITION BY body) AS places FROM numbered WHERE regexp_matches(body, '{_HAS_WORD}')
), lone AS (
  SELECT doc_id, line FROM whole_lines WHERE nth > 1 AND places >= CASE WHEN one THEN {COMMON} ELSE 2 END
), judged AS (
  SELECT u.doc_id, u.line, u.k, c.i IS NOT NULL OR l.line IS NOT NULL AS gone FROM units u LEFT JOIN covered c ON c.doc_id = u.doc_id AND c.i = u.i LEFT JOIN lone l ON l.doc_id = u.doc_id AND l.line = u.line
), of_lines AS (
  SELECT doc_id, line, bool_and(gone) AS emptied, bool_or(gone) AND NOT bool_and(gone) AS shortened FROM judged GROUP BY doc_id, line
), bodies AS (
  SELECT n.doc_id, n.line, CASE WHEN o.shortened THEN s.body ELSE n.body END AS body FROM numbered n LEFT JOIN of_lines o ON o.doc_id = n.doc_id AND o.line = n.line
  LEFT JOIN (SELECT s.doc_id, s.line, string_agg(s.t, '' ORDER BY s.k) AS body FROM sentences s LEFT JOIN judged j ON j.doc_id = s.doc_id AND j.line = s.line AND j.k = s.k WHERE NOT coalesce(j.gone, false) GROUP BY s.doc_id, s.line) s
    ON s.doc_id = n.doc_id AND s.line = n.line
  WHERE NOT coalesce(o.emptied, false)
), kept AS (
  SELECT doc_id, string_agg(body, chr(10) ORDER BY line) AS text FROM bodies GROUP BY doc_id
), counts AS (
  SELECT doc_id, count(*) FILTER (emptied) AS removed, count(*) FILTER (shortened) AS shortened FROM of_lines GROUP BY doc_id
)
SELECT r.doc_id, CASE WHEN r.absent THEN 0 ELSE len(r.parts) END AS n_lines, coalesce(c.removed, 0) AS n_removed, coalesce(c.shortened, 0) AS n_shortened,
  length(coalesce(k.text, '')) AS n_chars, sha256(coalesce(k.text, '')) AS text_sha256
FROM raw r LEFT JOIN kept k ON r.doc_id = k.doc_id LEFT JOIN counts c ON r.doc_id = c.doc_id
"""
