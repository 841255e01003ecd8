"""Exact top-k search by inner product of integer vectors: MaxScore over the postings of dimensions, shard by shard.

A dimension is a term, a vector's component its weight there; components of zero have no posting.
Vectors are dealt to shards of bounded size. For each query, a shard's terms are put in the order of
the most that they can add to a score. Terms at the end of that order which together can't lift a
vector to the query's threshold are non-essential: only vectors in the postings of the others, the
essential ones, can be among the best. These postings are traversed first; then the other terms are
probed one by one for those vectors that can still reach the threshold. The threshold, a score that
`k` vectors are known to reach, starts from a bounded sample and rises with what the shard holds. A
vector is left aside only where its bound is below the threshold, so the lists are exact, and ties
are kept. The shards' lists are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut, ensure_importable
from spanloom.llm.vectors import by_length, distinct_queries, finite, first_of_equals, matrix, ranked

NEIGHBOURS, SCALE = 5, 256
#: Vectors of a shard, at least and at most, and queries that a task holds.
SHARD_LEAST, SHARD_VECTORS, QUERY_BLOCK = 1_024, 16_384, 8_192
#: Vectors that give the first thresholds, and numbers in them at most, over all lengths.
SEEDS, SEED_NUMBERS = 4_096, 1 << 22
#: Share of a shard up to which its vectors are followed one by one, and terms between two looks at the others.
FEW, LOOK = 0.5, 8
#: Query rows measured at once against the seeds.
AT_ONCE = 512


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vector (floor of scale times each component) and d of every row that takes part."""
    scaled = F.transform("vector", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.select("vec_id", "vector").where(F.col("vec_id").isNotNull() & finite(F.col("vector"))).select("vec_id", scaled.alias("vector"), F.size("vector").alias("d"))
    # Beyond that a product of two vectors may not fit a long.
    return rows.where(F.forall("vector", lambda x: F.abs(x.cast("double")) <= F.lit(float(1 << 31)) / F.sqrt(F.col("d"))))


def _exact(x: np.ndarray, q: np.ndarray) -> type:
    """The faster type in which all scores are exact."""
    most = lambda a: int(np.abs(a).max(initial=0))
    return np.float64 if x.shape[1] * most(x) * most(q) < 1 << 53 else np.int64


class Shard:
    """The postings of one shard's dimensions, with the least and the largest weight of each."""

    def __init__(self, x: np.ndarray) -> None:
        self.size = len(x)
        self.columns = np.ascontiguousarray(x.T)
        held = [np.flatnonzero(c) for c in self.columns]
        # Postings of most of the shard are read as a whole column.
        self.postings = [None if len(at) > FEW * self.size else (at, c[at]) for at, c in zip(held, self.columns, strict=True)]
        self.least, self.most = self.columns.min(1, initial=0), self.columns.max(1, initial=0)
        for k, at in enumerate(held):
            if len(at) == self.size:
                self.least[k], self.most[k] = self.columns[k].min(), self.columns[k].max()

    def top(self, q: np.ndarray, threshold: float, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the `keep` best among those that reach the threshold, ties to smaller ids."""
        bound = np.maximum(q * self.most, q * self.least)
        terms = np.argsort(-bound, kind="stable")
        # What the terms from each place on can add at most.
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)
        below = np.flatnonzero(rest < threshold)
        essential = int(below[0]) if len(below) else len(terms)
        scores, alive = np.zeros(self.size, dtype=self.columns.dtype), None
        for place, term in enumerate(terms[:essential]):
            if alive is None:
                if (posting := self.postings[term]) is None:
                    scores += q[term] * self.columns[term]
                else:
                    scores[posting[0]] += q[term] * posting[1]
                if place % LOOK == LOOK - 1:
                    hopeful = scores + rest[place + 1] >= threshold
                    if np.count_nonzero(hopeful) <= FEW * self.size:
                        alive = np.flatnonzero(hopeful)
                        scores = scores[alive]
            else:
                alive, scores = self._probe(alive, scores, q, term, rest[place + 1], threshold)
        if alive is None:
            # A vector in no essential posting has scored nothing, so it falls here as well.
            alive = np.flatnonzero(scores + rest[essential] >= threshold)
            scores = scores[alive]
        if len(alive) > keep:
            # The most hopeful ones, scored in full, may raise the threshold for the others.
            first = np.argpartition(scores, len(scores) - keep)[len(scores) - keep :]
            threshold = max(threshold, (q @ self.columns[:, alive[first]]).min())
        for place in range(essential, len(terms)):
            if not len(alive):
                break
            alive, scores = self._probe(alive, scores, q, terms[place], rest[place + 1], threshold)
        if len(alive) > keep:
            last = np.partition(scores, len(scores) - keep)[len(scores) - keep]
            alive, scores = alive[scores >= last], scores[scores >= last]
        order = np.lexsort((ids[alive], -scores))[:keep]
        return alive[order], scores[order]

    def _probe(self, alive: np.ndarray, scores: np.ndarray, q: np.ndarray, term: int, rest: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        scores = scores + q[term] * self.columns[term][alive]
        hopeful = scores + rest >= threshold
        return alive[hopeful], scores[hopeful]


def search_shard(ids: np.ndarray, x: np.ndarray, q: np.ndarray, thresholds: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, rows and scores of the `keep` best of a shard for each query, as far as they reach its threshold."""
    kind = _exact(x, q)
    shard, q = Shard(x.astype(kind)), q.astype(kind)
    asked, rows, scores = [], [], []
    for k in range(len(q)):
        at, score = shard.top(q[k], thresholds[k], ids, keep)
        asked.append(np.full(len(at), k))
        rows.append(at)
        scores.append(score.astype(np.int64))
    return tuple(np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64) for parts in (asked, rows, scores))


def _seeds(firsts: DataFrame, sizes: list) -> dict[int, np.ndarray]:
    """A bounded sample of each length's vectors, by a hash of vec_id."""
    scale = min(1.0, SEED_NUMBERS / max(1, sum(r.d * min(r.n, SEEDS) for r in sizes)))
    shares = [(r.d, scale * min(1.0, SEEDS / r.n)) for r in sizes]
    # As many rows as there are lengths.
    table = F.broadcast(firsts.sparkSession.createDataFrame(shares, "d int, share double"))
    ticket = F.pmod(F.xxhash64("vec_id", F.lit("seed")), F.lit(1 << 30))
    found = firsts.join(table, "d").where(ticket < F.col("share") * (1 << 30)).select("vector").toArrow()
    out: dict[int, list[np.ndarray]] = {}
    for batch in found.combine_chunks().to_batches():
        for d, rows in by_length(batch, "vector"):
            out.setdefault(d, []).append(matrix(rows.column("vector"), np.int64))
    return {d: np.concatenate(parts) for d, parts in out.items()}


def _thresholds(queries: DataFrame, seeds: dict[int, np.ndarray], keep: int) -> DataFrame:
    """queries with a score that `keep` of the seeds reach, or the least number where there are fewer seeds."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in by_length(batch, "vector"):
                q, known, out = matrix(rows.column("vector"), np.int64), seeds.get(d), np.full(rows.num_rows, -np.inf)
                if known is not None and len(known) >= keep:
                    kind = _exact(known, q)
                    turned = known.T.astype(kind)
                    for k in range(0, len(q), AT_ONCE):
                        scores = q[k : k + AT_ONCE].astype(kind) @ turned
                        out[k : k + AT_ONCE] = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
                    if kind is np.int64:
                        # As a double, never above the score.
                        out = np.nextafter(out, -np.inf)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out)], names=["same", "vector", "d", "threshold"])

    return cut(queries.select("same", "vector", "d").mapInArrow(measure, "same long, vector array<long>, d int, threshold double"))


def search(vectors: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of each query's best vectors, exactly, among all but its own row.

    vectors: vec_id long and vector array<float|double>; each component counts as the whole number
    floor(scale * x). Vectors that are null or hold a null or non-finite component take no part, nor
    do rows without vec_id, nor vectors so long that a score may not fit a long. Zero vectors do.
    Ties go to the smaller vec_id. A query's candidates are the vectors of its own length. Rows that
    repeat vec_id and vector count as one; an id with several vectors is as many rows, each with a
    list of its own if it asks. With fewer candidates than neighbours all are returned; with no usable
    row, none. Other columns aren't read.
    """
    spark = vectors.sparkSession
    ensure_importable(spark)
    keep = neighbours + 1
    rows = integers(vectors, scale).distinct()
    firsts = first_of_equals(rows, keep)
    # One row for each length of vectors.
    sizes = firsts.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = distinct_queries(rows, firsts, is_query)
    queries = _thresholds(asked.select("same", "vector").distinct().withColumn("d", F.size("vector")), _seeds(firsts, sizes), keep)
    blocks = {r.d: -(-r.n // QUERY_BLOCK) for r in queries.groupBy("d").agg(F.count("*").alias("n")).collect()}
    most = min(SHARD_VECTORS, max(SHARD_LEAST, sum(r.n for r in sizes) // (2 * spark.sparkContext.defaultParallelism)))
    counts = [(r.d, -(-r.n // most), blocks.get(r.d, 0)) for r in sizes]
    table = F.broadcast(spark.createDataFrame(counts, "d int, shards int, blocks int"))

    def dealt(df: DataFrame, own: str, other: str, number: str, by: str) -> DataFrame:
        """Rows in the shard or block of their own, copied to each of the other side's."""
        parts = {"shards": "shard", "blocks": "block"}
        return df.join(table, "d").where(F.col(other) > 0).withColumn(parts[own], F.pmod(F.xxhash64(by, F.lit(number)), F.col(own)).cast("int")).withColumn(parts[other], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    left = dealt(firsts, "shards", "blocks", "shard", "vec_id").select("d", "shard", "block", "vec_id", "vector")
    right = dealt(queries, "blocks", "shards", "block", "same").select("d", "shard", "block", "same", "vector", "threshold")
    names = ["same", "found_id", "score", "equal"]

    def scan(held: pa.Table, asking: pa.Table) -> pa.Table:
        columns = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        if len(held) and len(asking):
            ids, x, q = held.column("vec_id").to_numpy(), matrix(held.column("vector"), np.int64), matrix(asking.column("vector"), np.int64)
            which, at, scores = search_shard(ids, x, q, asking.column("threshold").to_numpy(), keep)
            columns = [asking.column("same").to_numpy()[which], ids[at], scores, (x[at] == q[which]).all(1)]
        return pa.table(columns, names=names)

    key = ["d", "shard", "block"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(scan, "same long, found_id long, score long, equal boolean")
    return ranked(asked, near, neighbours)


#: The same rows by measuring every pair. vec_id is unique in the tables.
SEARCH_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM placed WHERE place <= {NEIGHBOURS}
"""
