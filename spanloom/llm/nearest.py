"""Approximate nearest neighbours by inner product: an adaptive dimension scan over probed lists.

Vectors get one component more, so that the largest inner product is the least distance, and are
dealt to the lists of a k-means index, one index for each length of vectors. A query first scans the
lists nearest to it that hold enough vectors, which gives it a bound: the distance of its last
neighbour there. Then it scans all the lists that it probes. There, rotated vectors lie in blocks of
columns; after every block the partial distance, scaled up to all dimensions, is tested against the
query's bound, and a candidate is abandoned as soon as the hypothesis that it comes nearer is
rejected. After each list the bound is tightened. Survivors are measured on the original vectors.

All queries of a list are scanned together. Lists are put together or split into blocks of bounded
size, and the queries that reach a block are split as well, so no task holds more than one block of
each, however hot a list is. Of equal vectors only the first ids can be anyone's neighbours, and equal
queries are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut, ensure_importable
from spanloom.llm.vectors import by_length, distinct_queries, finite, first_of_equals, matrix, ranked

NEIGHBOURS = 20
#: Vectors of a list, as wanted where there are many; rows of the training sample for each list, and at least.
LIST_VECTORS, SAMPLE_PER_LIST, SAMPLE_LEAST = 256, 20, 20_000
#: Bound of the training sample: so many numbers in all lengths together, 256 MB on the driver.
SAMPLE_NUMBERS = 1 << 25
#: Lists beyond which the index is made in two levels.
ONE_LEVEL = 1_024
#: Share of the true neighbours that the probed lists must hold for the sample's queries.
RECALL, RECALL_QUERIES = 0.97, 256
#: Vectors of a task's block, at least and at most, and its queries.
BLOCK_LEAST, BLOCK_VECTORS, BLOCK_QUERIES = 1_024, 8_192, 2_048
#: Columns between two tests, and how far the estimate may exceed the bound, in deviations.
COLUMNS, DEVIATIONS = 16, 2.4
#: Rows measured at once against centroids or the sample.
ROWS_AT_ONCE = 2_048
#: Queries measured at once against a list, and the share of survivors from which pairs are followed singly.
AT_ONCE, SPARSE = 256, 0.2
SEED = 7


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, not all zero, every component finite."""
    return finite(v) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    squares, turned = (centroids**2).sum(1), 2 * centroids.T
    parts = [np.argmin(squares - x[k : k + ROWS_AT_ONCE] @ turned, axis=1) for k in range(0, len(x), ROWS_AT_ONCE)]
    return np.concatenate([*parts, np.empty(0, dtype=np.int64)])


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means: at most k centroids of the rows."""
    out = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(8):
        near = _nearest(x, out)
        order = np.argsort(near, kind="stable")
        filled, first = np.unique(near[order], return_index=True)
        out[filled] = np.add.reduceat(x[order], first) / np.diff([*first, len(x)])[:, None]
    return out


@dataclass(frozen=True)
class Index:
    """The lists of one length of vectors: their centroids in the extended space, in groups with a centroid each, and how many to probe.

    base: the number of its first list among those of all lengths; longest: the longest vector's length.
    """

    base: int
    coarse: np.ndarray
    begin: np.ndarray
    centroids: np.ndarray
    probes: int
    longest: float
    rotation: np.ndarray

    def extend(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.longest**2 - (x**2).sum(1)))])

    def list_of(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: the nearest one of the nearest group."""
        x = self.extend(x)
        group = _nearest(x, self.coarse)
        out = np.empty(len(x), dtype=np.int64)
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            out[rows] = self.begin[g] + _nearest(x[rows], self.centroids[self.begin[g] : self.begin[g + 1]])
        return out

    def nearest_lists(self, q: np.ndarray) -> np.ndarray:
        """The lists that each query probes, nearest first."""
        squares, turned = (self.centroids**2).sum(1), 2 * self.centroids[:, :-1].T
        parts = [np.argsort(squares - q[k : k + AT_ONCE] @ turned, axis=1, kind="stable")[:, : self.probes] for k in range(0, len(q), AT_ONCE)]
        return np.concatenate([*parts, np.empty((0, self.probes), dtype=np.int64)])


def fit(sample: np.ndarray, lists: int, longest: float, base: int = 0) -> Index:
    """k-means over the sample, with as many probes as its own queries need for RECALL."""
    rng = np.random.default_rng(SEED)
    d = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0]
    x = Index(base, sample, sample, sample, 1, longest, rotation).extend(sample)
    lists = max(1, min(lists, len(x)))
    coarse = x.mean(0)[None] if lists <= ONE_LEVEL else _centroids(x, int(np.sqrt(lists)), rng)
    group = _nearest(x, coarse)
    held = np.bincount(group, minlength=len(coarse))
    fine = [_centroids(x[group == g], max(1, round(lists * n / len(x))), rng) if n else coarse[g : g + 1] for g, n in enumerate(held)]
    index = Index(base, coarse, np.cumsum([0, *map(len, fine)]), np.concatenate(fine), sum(map(len, fine)), longest, rotation)
    asked = rng.choice(len(x), min(RECALL_QUERIES, len(x)), replace=False)
    near, reach = index.list_of(sample), index.nearest_lists(sample[asked])
    place = np.argsort(reach, axis=1)
    k = min(NEIGHBOURS, len(x) - 1)
    if k < 1:
        return index
    true = np.empty((len(asked), k), dtype=np.int64)
    for row in range(0, len(asked), 16):
        some = asked[row : row + 16]
        scores = sample[some] @ sample.T
        scores[np.arange(len(some)), some] = -np.inf
        true[row : row + 16] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(place, near[true], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1
    return Index(base, coarse, index.begin, index.centroids, probes, longest, rotation)


class Found:
    """What a block's queries have found: each one's best so far, and its bound, the squared distance that the next must come within."""

    def __init__(self, bounds: np.ndarray, keep: int) -> None:
        self.bounds, self.keep = bounds.copy(), keep
        self.query, self.ids, self.rows = (np.empty(0, dtype=np.int64) for _ in range(3))
        self.scores, self.far = np.empty(0), np.empty(0)

    def add(self, query: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, far: np.ndarray) -> None:
        """Take candidates of some queries in, keep each one's best, and tighten the bounds."""
        if not len(query):
            return
        columns = [np.concatenate(c) for c in zip((self.query, self.ids, self.rows, self.scores, self.far), (query, ids, rows, scores, far), strict=True)]
        order = np.lexsort((columns[1], -columns[3], columns[0]))
        sorted_by = columns[0][order]
        nth = np.arange(len(order)) - np.searchsorted(sorted_by, sorted_by)
        order, nth = order[nth < self.keep], nth[nth < self.keep]
        self.query, self.ids, self.rows, self.scores, self.far = (c[order] for c in columns)
        last = nth == self.keep - 1
        self.bounds[self.query[last]] = np.minimum(self.bounds[self.query[last]], self.far[last])


def scan_block(index: Index, ids: np.ndarray, lists: np.ndarray, x: np.ndarray, q: np.ndarray, probed: list[np.ndarray], bounds: np.ndarray, keep: int) -> Found:
    """The `keep` nearest of a block's vectors for each query, in the lists that it probes, within its bound."""
    found = Found(bounds, keep)
    turned, queries = index.extend(x) @ index.rotation, np.column_stack([q, np.zeros(len(q))]) @ index.rotation
    d = turned.shape[1]
    # What rounding may add to a squared distance.
    slack = 1e-10 * (index.longest**2 + (q**2).sum(1))
    pairs = np.repeat(np.arange(len(q)), [len(p) for p in probed])
    at = np.concatenate([*probed, np.empty(0, dtype=np.int64)]).astype(np.int64)
    rank = np.concatenate([np.arange(len(p)) for p in probed] + [np.empty(0, dtype=np.int64)])
    # Lists that come first for their queries go first, so that bounds are tight for the others.
    order = np.lexsort((at, rank))
    for one in dict.fromkeys(at[order].tolist()):
        rows, asking = np.flatnonzero(lists == one), pairs[at == one]
        for k in range(0, len(asking), AT_ONCE):
            now = asking[k : k + AT_ONCE]
            i, j, far = _survivors(turned[rows], queries[now], found.bounds[now], slack[now], d)
            i, j = now[i], rows[j]
            # One fixed order of summation, so that equal vectors have equal scores.
            found.add(i, ids[j], j, (x[j] * q[i]).sum(1), far)
    return found


def _survivors(x: np.ndarray, q: np.ndarray, bounds: np.ndarray, slack: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, vector) that no test rejects, with their squared distances."""

    def hopeful(part: np.ndarray, b: int, bound: np.ndarray, more: np.ndarray) -> np.ndarray:
        return part * (d / b) <= bound * (1 + (DEVIATIONS / np.sqrt(b) if b < d else 0)) ** 2 + more

    part = np.zeros((len(q), len(x)))
    alive = np.ones(part.shape, dtype=bool)
    b = 0
    while b < d and alive.sum() > SPARSE * alive.size:
        a, b = b, min(b + COLUMNS, d)
        xs, qs = x[:, a:b], q[:, a:b]
        part += (qs**2).sum(1)[:, None] - 2 * qs @ xs.T + (xs**2).sum(1)
        alive &= hopeful(part, b, bounds[:, None], slack[:, None])
    i, j = np.nonzero(alive)
    far = part[i, j]
    while b < d and len(i):
        a, b = b, min(b + COLUMNS, d)
        far = far + ((x[j, a:b] - q[i, a:b]) ** 2).sum(1)
        still = hopeful(far, b, bounds[i], slack[i])
        i, j, far = i[still], j[still], far[still]
    return i, j, np.maximum(far, 0.0)


def build(firsts: DataFrame, sizes: list) -> dict[int, Index]:
    """An index for each length of vectors. sizes: d, n and longest (squared) of each; firsts: vec_id, vector and d."""
    indexes, base = {}, 0
    wanted = {r.d: max(1, int(np.ceil(max(np.sqrt(r.n), r.n / LIST_VECTORS)))) for r in sizes}
    rows = {r.d: min(r.n, max(SAMPLE_LEAST, SAMPLE_PER_LIST * wanted[r.d])) for r in sizes}
    scale = min(1.0, SAMPLE_NUMBERS / sum(r.d * rows[r.d] for r in sizes))
    shares = [(r.d, scale * rows[r.d] / r.n) for r in sizes]
    # As many rows as there are lengths.
    table = F.broadcast(firsts.sparkSession.createDataFrame(shares, "d int, share double"))
    ticket = F.pmod(F.xxhash64("vec_id", F.lit("index")), F.lit(1 << 30))
    sampled = firsts.join(table, "d").where(ticket < F.col("share") * (1 << 30)).select("d", "vec_id", "vector").orderBy("d", "vec_id").select("vector").toArrow()
    of_length = {d: matrix(b.column("vector")) for batch in sampled.combine_chunks().to_batches() for d, b in by_length(batch, "vector")}
    for r in sizes:
        sample = of_length.get(r.d, np.ones((1, r.d)))
        # A sample that the bound has cut serves fewer lists.
        indexes[r.d] = fit(sample, min(wanted[r.d], max(1, int(np.sqrt(r.n)), len(sample) // SAMPLE_PER_LIST)), float(np.sqrt(r.longest)), base)
        base += len(indexes[r.d].centroids)
    return indexes


def search(vectors: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest vectors, among all but its own row.

    vectors: vec_id long and vector array<float|double>. Vectors that are null, zero or hold a null
    or non-finite component take no part, nor do rows without vec_id. A query's candidates are the
    vectors of its own length, as there is no inner product with others. Ties go to the smaller
    vec_id. Rows that repeat vec_id and vector count as one; an id with several vectors is as many rows,
    each with a list of its own if it asks, and each a candidate of the others. With fewer candidates than neighbours,
    all are returned; with no usable row, none.
    """
    spark = vectors.sparkSession
    ensure_importable(spark)
    keep = neighbours + 1
    sound = vectors.select("vec_id", "vector", F.size("vector").alias("d")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = sound.distinct()
    firsts = first_of_equals(rows, keep)
    squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    # One row for each length of vectors.
    sizes = firsts.groupBy("d").agg(F.count("*").alias("n"), F.max(squares).alias("longest")).orderBy("d").collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexes = build(firsts, sizes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in by_length(batch, "vector"):
                at = indexes[d].base + indexes[d].list_of(matrix(rows.column(1)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at.astype(np.int32))], names=["vec_id", "vector", "list"])

    kind = vectors.schema["vector"].dataType.simpleString()
    dealt = cut(firsts.select("vec_id", "vector").mapInArrow(deal, f"vec_id long, vector {kind}, list int"))
    # One row for each list, of which the sample bounds the number.
    held = {r.list: r["count"] for r in dealt.groupBy("list").count().collect()}
    most = min(BLOCK_VECTORS, max(BLOCK_LEAST, sum(held.values()) // (4 * spark.sparkContext.defaultParallelism)))
    blocks, first = {}, 0
    for index in indexes.values():
        own = _blocks({k: n for k, n in held.items() if index.base <= k < index.base + len(index.centroids)}, most, first)
        first = max([first, *(a + n for a, n in own.values())])
        blocks |= own
    table = F.broadcast(spark.createDataFrame([(k, a, m) for k, (a, m) in blocks.items()], "list int, first_block int, in_blocks int"))
    placed = cut(dealt.join(table, "list").withColumn("block", (F.col("first_block") + F.pmod(F.xxhash64("vec_id"), F.col("in_blocks"))).cast("int")).select("block", "vec_id", "list", "vector"))
    asked = distinct_queries(rows, firsts, is_query)
    queries = asked.select("same", "vector").distinct().withColumn("bound", F.lit(float("inf")))
    home = _scan(placed, queries, indexes, held, blocks, keep, home=True)
    # A query's neighbours in its home lists: at most `keep` for each block that these lie in.
    last = home.groupBy("same").agg(F.get(F.sort_array(F.collect_list("far")), F.lit(keep - 1)).alias("bound"))
    bounded = asked.select("same", "vector").distinct().join(last, "same", "left").select("same", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    near = _scan(placed, bounded, indexes, held, blocks, keep, home=False)
    return ranked(asked, near, neighbours)


def _scan(placed: DataFrame, queries: DataFrame, indexes: dict[int, Index], held: dict[int, int], blocks: dict[int, tuple[int, int]], keep: int, home: bool) -> DataFrame:
    """same, found_id, score, far and equal (whether it is the query's own vector) of what each query finds within its bound, at most `keep` in a block.

    home: only in the nearest lists that together hold `keep` vectors, else in all that it probes.
    """

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in by_length(batch, "vector"):
                at, hit, probed = [], [], []
                for row, lists in enumerate(indexes[d].nearest_lists(matrix(rows.column("vector"))) + indexes[d].base):
                    lists, into = [k for k in lists.tolist() if k in blocks], {}
                    if home:
                        lists = lists[: int(np.searchsorted(np.cumsum([held[k] for k in lists]), keep)) + 1]
                    for k in lists:
                        for block in range(blocks[k][0], sum(blocks[k])):
                            into.setdefault(block, []).append(k)
                    at += [row] * len(into)
                    hit += into.keys()
                    probed += into.values()
                yield pa.RecordBatch.from_arrays([*rows.take(pa.array(at, pa.int64())).columns, pa.array(hit, pa.int32()), pa.array(probed, pa.list_(pa.int32()))], names=["same", "vector", "bound", "block", "probed"])

    kind = queries.schema["vector"].dataType.simpleString()
    reached = cut(queries.mapInArrow(reach, f"same long, vector {kind}, bound double, block int, probed array<int>"))
    # Tables cut before they are joined, so that Spark may split a hot block's side.
    parts = cut(reached.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts")))
    left = placed.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "list", "vector")
    right = reached.join(parts, "block").select("block", F.pmod(F.xxhash64("same"), F.col("parts")).cast("int").alias("part"), "same", "vector", "bound", "probed")

    def scan(held_here: pa.Table, asking: pa.Table) -> pa.Table:
        columns = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0, bool)]
        if len(held_here) and len(asking):
            x, q = matrix(held_here.column("vector")), matrix(asking.column("vector"))
            probed = [np.array(p, dtype=np.int64) for p in asking.column("probed").to_pylist()]
            found = scan_block(indexes[x.shape[1]], held_here.column("vec_id").to_numpy(), held_here.column("list").to_numpy(), x, q, probed, asking.column("bound").to_numpy(), keep)
            columns = [asking.column("same").to_numpy()[found.query], found.ids, found.scores, found.far, (x[found.rows] == q[found.query]).all(1)]
        return pa.table(columns, names=["same", "found_id", "score", "far", "equal"])

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(scan, "same long, found_id long, score double, far double, equal boolean")


def _blocks(sizes: dict[int, int], most: int, first: int = 0) -> dict[int, tuple[int, int]]:
    """For each list its first block and in how many blocks of at most about `most` it lies: short lists share a block, a long one is split."""
    out, block, free = {}, first - 1, 0
    for k in sorted(sizes):
        parts = -(-sizes[k] // most)
        if parts > 1 or sizes[k] > free:
            out[k] = (block + 1, parts)
            block += parts
            free = most - sizes[k] if parts == 1 else 0
        else:
            out[k] = (block, 1)
            free -= sizes[k]
    return out
