"""Aligners by language: lookup with a fallback for any language, and what a miss means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ANY = "any"
MISS_POLICIES = ("skip_chunk", "error")
#: Most aligners of a registry; beyond it, registration raises.
MAX_ALIGNERS = 10_000


def register(entries: DataFrame) -> DataFrame:
    """One aligner per key, the last registered; raises for an entry under another language than its aligner's.

    entries: key (a language or `any`), aligner_id, language, seq.
    """
    if entries.limit(MAX_ALIGNERS + 1).count() > MAX_ALIGNERS:
        raise ValueError(f"more than {MAX_ALIGNERS} aligners")
    if entries.where((F.col("key") != ANY) & (F.col("key") != F.col("language"))).limit(1).count():
        raise ValueError("an aligner is registered under a language that isn't its own")
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return entries.withColumn("_n", last).where("_n = 1").drop("_n", "seq")


def lookup(chunks: DataFrame, aligners: DataFrame, policy: str = "skip_chunk") -> DataFrame:
    """chunks with aligner_id, matched (exact, any or miss) and status: ok, skipped (no words) or language_unsupported."""
    if policy not in MISS_POLICIES:
        raise ValueError(f"policy must be one of {MISS_POLICIES}")
    # One aligner a key, whatever comes in; Spark broadcasts the table where it measures it as small.
    exact = aligners.where(F.col("key") != ANY).groupBy(F.col("key").alias("_key")).agg(F.max("aligner_id").alias("_exact"))
    fallback = aligners.where(F.col("key") == ANY).agg(F.max("aligner_id"))
    met = chunks.join(exact, F.col("language") == F.col("_key"), "left").withColumn("_any", fallback.scalar())
    status = F.when(F.coalesce("_exact", "_any").isNotNull(), "ok").otherwise("skipped" if policy == "skip_chunk" else "language_unsupported")
    matched = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_any").isNotNull(), "any").otherwise("miss")
    return met.select(*chunks.columns, F.coalesce("_exact", "_any").alias("aligner_id"), matched.alias("matched"), status.alias("status"))


def owned(prepared: DataFrame, aligner_id: str) -> DataFrame:
    """Prepared chunks with status ok, or wrong_owner where another aligner prepared them."""
    return prepared.withColumn("status", F.when(F.col("aligner_id") == aligner_id, "ok").otherwise("wrong_owner"))
