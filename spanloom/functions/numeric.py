"""Array kernels over frames of logits and log-probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a lambda's variable is never inlined."""
    return F.transform(F.array(value), body)[0]


def first_bad_sample(samples: Column) -> Column:
    """Index of the first sample that isn't finite, else null."""
    bad = lambda s: s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    at = F.array_position(F.transform(samples, lambda s: F.coalesce(bad(s), F.lit(True))), F.lit(True))
    return F.when(at > 0, at - 1)


def _shifted_log_sum(frame: Column, top: Column) -> Column:
    return F.log(F.aggregate(frame, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top)))


def log_sum_exp(frame: Column) -> Column:
    """log of the summed exponentials, in double, with the largest shifted out first."""
    return let(F.array_max(frame).cast("double"), lambda top: top + _shifted_log_sum(frame, top))


def log_softmax(frame: Column) -> Column:
    """Log-probabilities of a frame of logits: the shift comes first, so a large common offset does no harm; null if a logit isn't finite."""

    def of_top(top: Column) -> Column:
        return let(_shifted_log_sum(frame, top), lambda rest: F.transform(frame, lambda x: ((x.cast("double") - top) - rest).cast("float")))

    return F.when(first_bad_sample(frame).isNull(), let(F.array_max(frame).cast("double"), of_top))


def best_nonblank(frame: Column, blank: int) -> Column:
    """Largest value of a frame outside the blank: what a wildcard emits."""
    return F.array_max(F.filter(frame, lambda x, i: i != blank))


def bad_log_prob(frame: Column) -> Column:
    """Struct (vocab, kind) of the first cell that isn't finite and at most zero, else null."""
    kind = lambda x: F.when(F.isnan(x), "nan").when(x == float("inf"), "pos_inf").when(x == float("-inf"), "neg_inf").when(x > 0, "positive")
    marked = F.filter(F.transform(frame, lambda x, i: F.struct(i.alias("vocab"), kind(x).alias("kind"))), lambda s: s["kind"].isNotNull())
    return F.get(marked, F.lit(0))


def moments(samples: Column) -> Column:
    """Struct (mean, var): the population's, in double; nulls for no sample."""
    n = F.size(samples)
    total = lambda f: F.aggregate(samples, F.lit(0.0), lambda a, x: a + f(x.cast("double")))
    mean = lambda m: F.struct(m.alias("mean"), F.try_divide(total(lambda x: (x - m) * (x - m)), n).alias("var"))
    return let(F.try_divide(total(lambda x: x), n), mean)


def standardize(samples: Column, epsilon: float = 1e-7) -> Column:
    """Samples with zero mean and unit variance, accumulated in double."""
    scaled = lambda m: F.transform(samples, lambda x: ((x.cast("double") - m["mean"]) / F.sqrt(m["var"] + epsilon)).cast("float"))
    return let(moments(samples), scaled)
