"""SimHash fingerprints and near-duplicate groups by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the binary
Golay code of length 23. Two words that differ in one bit share a codeword among those within
distance four of either: the one nearest to the first is at most three from it, so at most four from
the other. By pigeonhole, two fingerprints at most two bits apart agree on one segment exactly, and
either agree on a second one too or differ by one bit in each of the others. So two kinds of key find
every link: two exact segments; or an exact segment with a codeword index of the next one. Keys are
joined and every candidate's distance is verified. One departure: where more than PROBE_FROM
fingerprints share a key, pairing them would grow with the square of the group, so each of them looks
up the fingerprints that may differ from it under that key instead; the links are the same.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut, ensure_importable, fresh, map_rows
from spanloom.llm.components import connected_components

#: Bits of each segment, from the lowest bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 2
#: Fingerprints under one key from which each looks up its possible partners; about the number of those.
PROBE_FROM = 512
# Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code.
GENERATOR = 0xAE3


@functools.lru_cache(maxsize=1)
def error_patterns() -> np.ndarray:
    """For each of the 2,048 syndromes, the errors of weight four or less that have it: six columns, -1 where there are fewer.

    Every syndrome has one error of weight three or less; only those of weight three have others of weight four.
    """
    errors = np.array([sum(1 << b for b in at) for weight in range(5) for at in combinations(range(23), weight)], dtype=np.int64)
    found = np.full((1 << 11, 6), -1, dtype=np.int64)
    used = np.zeros(1 << 11, dtype=np.int64)
    for error, syndrome in zip(errors, syndromes(errors), strict=True):
        found[syndrome, used[syndrome]] = error
        used[syndrome] += 1
    return found


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= (rest >> bit & 1) * (GENERATOR << (bit - 11))
    return rest


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance four of each word: six columns, -1 where there are fewer."""
    errors = error_patterns()[syndromes(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def link_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of int64 fingerprints, and the row that each key belongs to; bits 48 to 50 tell the kind of key."""
    parts = [fingerprints >> at & ((1 << bits) - 1) for at, bits in SEGMENTS]
    rows = np.arange(len(fingerprints))
    keys, of = [], []
    for k in range(3):
        after = (k + 1) % 3
        keys.append(np.int64(k) << 48 | parts[k] << 22 | parts[after])
        of.append(rows)
        near = codeword_indices(parts[after])
        which, column = np.nonzero(near >= 0)
        keys.append(np.int64(k + 3) << 48 | parts[k][which] << 12 | near[which, column])
        of.append(which)
    return np.concatenate(keys), np.concatenate(of)


def probe_masks(kind: int) -> list[int]:
    """What two linked fingerprints that meet under a kind of key may differ by; the kinds together leave out no link."""
    (at, bits), (last, last_bits) = SEGMENTS[(kind % 3 + 1) % 3], SEGMENTS[(kind % 3 + 2) % 3]
    rest = [1 << b for b in range(last, last + last_bits)]
    if kind < 3:
        masks = rest + [a | b for a, b in combinations(rest, 2)]
    else:
        masks = [1 << a | b for a in range(at, at + bits) for b in rest]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's three-word shingles, as a signed integer; no word: zero.

    A-Z are lower-cased, words are runs without ASCII white space, repeats count, and a bit is set
    if over half the shingles' XXH64 (seed 42) have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    shingles = [b" ".join(x) for x in zip(words, words[1:], words[2:], strict=False)] or [b" ".join(words)]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), 1 << 15):
        hashes = b"".join([digest(x, 42) for x in shingles[at : at + (1 << 15)]])
        counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (long) of every text."""

    def init() -> Callable:
        return lambda ids, texts: [(i, fingerprint(t)) for i, t in zip(ids, texts, strict=True)]

    return map_rows(docs, ["doc_id", "text"], init, "doc_id long, fp long")


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            keys, of = link_keys(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[of])], names=["key", "fp"])

    ensure_importable(distinct.sparkSession)
    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in column fp that differ in one or two bits.

    A key that few fingerprints share is joined with itself. Where more share it than there are
    ways to differ under that key, each of its fingerprints looks up those ways instead, so that
    the work stays in proportion to the rows however large a group is.
    """
    keyed = _keyed(distinct)
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    live = cut(keyed.join(shared, "key"))
    few = live.where(F.col("n") <= PROBE_FROM).select("key", "fp")
    left, right = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    met = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    masks = distinct.sparkSession.createDataFrame([(k, m) for k in range(6) for m in probe_masks(k)], "kind long, mask long")
    # The table of masks has a fixed number of rows.
    many = live.where(F.col("n") > PROBE_FROM).select("fp", F.shiftright("key", 48).alias("kind")).distinct()
    probes = many.join(F.broadcast(masks), "kind").select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("mask")).alias("b"))
    found = probes.join(distinct.select(F.col("fp").alias("b")), "b", "left_semi").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return met.unionByName(found).distinct()


def _roots(groups: DataFrame) -> DataFrame:
    """groups (columns fp, distinct, and least) with the root fingerprint of each one's component, and `first`, the smallest `least` there."""
    roots = connected_components(links(groups.select("fp"))).withColumnRenamed("node", "fp")
    rooted = cut(groups.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # Kept apart from the join, so that Spark may split the side of a large component.
    smallest = cut(rooted.groupBy("root").agg(F.min("least").alias("first")))
    return rooted.join(smallest, "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every text's row.

    Texts whose fingerprints differ in at most two bits are linked; component_id is the smallest
    doc_id reachable over links, its own included. A null, empty or wordless text has fingerprint
    zero and is linked like any other. Rows with a null doc_id take part, and only groups without
    any other have a null component_id. Repeated rows give repeated results; an empty table gives
    none. Columns other than doc_id and text are not read.
    """
    each = cut(fingerprints(docs))
    groups = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    known = cut(_roots(groups).select("fp", F.col("first").alias("component_id")))
    return each.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row, all columns, of each near-duplicate group of docs.

    It is decided by row: of a group's rows the one of smallest doc_id stays, null ids after all
    others, equal ids by a hash of their text; of rows that agree in both, any one stays. So a text
    that no other is near to always stays, whatever ids it shares. Texts without a word are one
    group. An empty table gives none; columns of any name are carried along.
    """
    key, n, at_id, at_key = (fresh(docs, name) for name in ("text_key", "n", "at_id", "at_key"))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))

    def init() -> Callable:
        return lambda ids, keys, texts: [(i, k, fingerprint(t)) for i, k, t in zip(ids, keys, texts, strict=True)]

    each = cut(map_rows(keyed, ["doc_id", key, "text"], init, "doc_id long, text_key long, fp long"))
    rows = each.groupBy("fp", "doc_id", "text_key").agg(F.count("*").alias("n"))
    groups = cut(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key", "n")).alias("least")))
    chosen = cut(_roots(groups).select("first").distinct().select(F.col("first.doc_id").alias(at_id), F.col("first.text_key").alias(at_key), F.col("first.n").alias(n)))
    joined = keyed.join(chosen.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(at_id)) & (F.col(key) == F.col(at_key)))
    # Only rows that repeat one another are gathered.
    repeated = joined.where(F.col(n) > 1).dropDuplicates(["doc_id", key])
    return joined.where(F.col(n) == 1).unionByName(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))
