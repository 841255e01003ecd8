"""Embedding whitening with an exact covariance by polarisation.

Components become whole numbers. Over the distinct vectors, tasks add up the squares of every centred
dimension and of every sum of two centred dimensions, in whole numbers throughout: first the sums of
the dimensions give each one's mean, then deviations from the nearest whole number to it are squared,
and what that number is off is taken away exactly at the end. Half of what the square of a sum has
beyond the squares of its two dimensions is their covariance, so the variances alone give the whole
matrix. It is symmetric and exact up to one rounding a cell, and its eigenvectors are the components.

Only d * (d + 1) / 2 totals for each length d of vectors, from a fixed number of groups, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut, ensure_importable
from spanloom.llm.vectors import by_length, finite, matrix

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Components beyond which a scaled one has no long.
LARGEST = float(1 << 55)
#: Rows handled at once, and numbers whose squares add up within a long over so many rows.
ROWS_AT_ONCE, SMALL = 1_024, 1 << 25
#: Groups in which the tasks' totals are added up before the driver gets them.
MERGERS = 16
#: A component counts if its variance is more than this share of the largest one: below, it is rounding.
LEAST_SHARE = 1e-12


def integers(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x (floor of scale times each component, plus shift) of every usable row."""
    usable = finite(F.col("vector")) & (F.size("vector") > 0) & F.forall("vector", lambda c: F.abs(c.cast("double")) < LARGEST)
    return vectors.select("vec_id", "vector").where(usable).select("vec_id", F.transform("vector", lambda c: F.floor(c.cast("double") * scale) + shift).alias("x"))


def _totals(rows: DataFrame, partial: Callable[[int, np.ndarray], np.ndarray], exact: bool = True) -> dict[int, list]:
    """For each length of vectors the totals, over all rows, of what `partial` gives for a few of them; as whole numbers, or as doubles.

    A task gives its totals as one row, rows are added up in MERGERS groups, and the driver adds up these.
    """
    kind, arrow = ("decimal(38,0)", pa.decimal128(38, 0)) if exact else ("double", pa.float64())

    def held_of(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        cells = [[Decimal(int(v)) if exact else float(v) for v in t] for t in totals.values()]
        return pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.int32()), pa.array(cells, pa.list_(arrow))], names=["d", "totals"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, rows in by_length(batch, "x"):
                x = matrix(rows.column("x"), np.int64)
                for k in range(0, len(x), ROWS_AT_ONCE):
                    found = partial(d, x[k : k + ROWS_AT_ONCE])
                    held[d] = held.get(d, 0) + (found.astype(object) if exact else found)
        yield held_of(held)

    def merge(parts: pa.Table) -> pa.Table:
        totals = [np.array([int(v) if exact else v for v in t.as_py()], dtype=object if exact else float) for t in parts.column("totals")]
        return pa.Table.from_batches([held_of({parts.column("d")[0].as_py(): sum(totals)})])

    given = rows.select("x").mapInArrow(add, f"d int, totals array<{kind}>").withColumn("merger", F.spark_partition_id() % MERGERS)
    merged = given.groupBy("d", "merger").applyInArrow(lambda key, parts: merge(parts.drop_columns("merger")), f"d int, totals array<{kind}>")
    out: dict[int, list] = {}
    for r in merged.collect():
        out[r.d] = [a + b for a, b in zip(out.get(r.d, [0] * len(r.totals)), (map(int, r.totals) if exact else r.totals), strict=True)]
    return out


def _squares(y: np.ndarray) -> np.ndarray:
    """Sums over the rows of the squares of every dimension, then of every sum of two, in the order of np.triu_indices."""
    y = y if np.abs(y).max(initial=0) < SMALL else y.astype(object)
    return np.concatenate([(y**2).sum(0), *(((y[:, i : i + 1] + y[:, i + 1 :]) ** 2).sum(0) for i in range(y.shape[1] - 1))])


def polarise(n: int, sums: list[int], centre: list[int], squares: list[int]) -> tuple[np.ndarray, list[int]]:
    """The covariance, and n times the sum of squared deviations of each dimension from its mean, from squares of deviations from `centre`."""
    d = len(sums)
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    i, j = np.triu_indices(d, 1)
    # n times the squares around the mean: those around the centre without what it is off.
    own = [n * q - r * r for q, r in zip(squares[:d], left, strict=True)]
    both = [n * q - (left[a] + left[b]) ** 2 for q, a, b in zip(squares[d:], i.tolist(), j.tolist(), strict=True)]
    v = np.diag([q / (n * n) for q in own])
    v[i, j] = v[j, i] = [(q - own[a] - own[b]) / (2 * n * n) for q, a, b in zip(both, i.tolist(), j.tolist(), strict=True)]
    return v, own


@dataclass(frozen=True)
class Whitening:
    """What whitens the vectors of one length: how many distinct ones it was fitted on, sums, directions (one column a component), and shares of the variance."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of vectors, one row each."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - whole).astype(float) - part) @ self.directions

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - sum) squared, exactly; None where it doesn't fit a long."""
        most = max(abs(self.n * int(v) - s) for side in (x.max(0), x.min(0)) for v, s in zip(side, self.sums, strict=True)) if len(x) else 0
        if most * most * x.shape[1] < 1 << 63:
            return (((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(1)).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, dtype=object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in exact]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each length of vectors, from a table of distinct vectors x that is read twice."""
    ensure_importable(distinct.sparkSession)
    first = _totals(distinct, lambda d, x: np.append((x if np.abs(x).max() < 1 << 50 else x.astype(object)).sum(0), len(x)))
    centres = {d: [(2 * s + t[-1]) // (2 * t[-1]) for s in t[:-1]] for d, t in first.items()}
    as_array = {d: np.array(c, dtype=np.int64) for d, c in centres.items()}
    second = _totals(distinct, lambda d, x: _squares(x - as_array[d]))
    out = {}
    for d, t in first.items():
        v, _ = polarise(t[-1], t[:-1], centres[d], second[d])
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:components], u[:, ::-1][:, :components]
        held = e > max(0.0, LEAST_SHARE * float(e[0]))
        out[d] = Whitening(t[-1], tuple(t[:-1]), u[:, held] / np.sqrt(e[held]), e[held] / np.trace(v))
    return out


def identity_errors(distinct: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """For each length of vectors the largest absolute entry of the covariance of its whitened vectors minus the identity, measured on them all."""

    def products(d: int, x: np.ndarray) -> np.ndarray:
        # Whitened vectors are centred already; a column of ones adds up what they are off.
        w = np.column_stack([models[d].apply(x), np.ones(len(x))])
        return (w.T @ w).ravel()

    cells = _totals(distinct, products, exact=False)
    out = {}
    for d, found in cells.items():
        k = int(np.sqrt(len(found)))
        g = np.array(found).reshape(k, k) / found[-1]
        covariance = g[:-1, :-1] - np.outer(g[:-1, -1], g[:-1, -1])
        out[d] = float(np.abs(covariance - np.eye(k - 1)).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, by falling variance), n, deviation, whitened, explained and identity_error, a row for each usable vector and component.

    vectors: vec_id long and vector array<float|double>. Vectors that are null, empty or hold a null
    or non-finite entry, or one of 2^55 or more, which scaled has no long, take no part. The fit list
    is every distinct vector of whole numbers once; repeated rows and null ids give rows each on their
    own. Each length of vectors is fitted apart. A component without variance beyond rounding isn't
    given: of a single distinct vector there is none, so an empty result. deviation is null where it
    doesn't fit a long. An empty table gives none; other columns aren't read.
    """
    spark = vectors.sparkSession
    ensure_importable(spark)
    rows = integers(vectors)
    distinct = cut(rows.select("x").distinct())
    models = fit(distinct, components)
    errors = identity_errors(distinct, models)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, whole in by_length(batch, "x"):
                model, k = models[d], models[d].directions.shape[1]
                for at in range(0, whole.num_rows if k else 0, ROWS_AT_ONCE):
                    part = whole.slice(at, ROWS_AT_ONCE)
                    n, x = part.num_rows, matrix(part.column("x"), np.int64)
                    each = pa.array(np.repeat(np.arange(n), k))
                    columns = [
                        part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(each),
                        pa.array(model.apply(x).ravel()), pa.array(np.tile(model.explained, n)), pa.array(np.full(n * k, errors[d])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return rows.mapInArrow(apply, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
