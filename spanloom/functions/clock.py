"""The analysis clock (samples at 16 kHz) and output clocks (any rational timebase), as integer column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE = 16_000
MAX_LONG = (1 << 63) - 1
MIN_LONG = -(1 << 63)


def div(a: Column, b: Column) -> Column:
    """Integer division toward zero."""
    return F.call_function("div", a, b)


def rescale(value: Column, src_num: Column, src_den: Column, dst_num: Column, dst_den: Column) -> Column:
    """value ticks of src as ticks of dst, toward zero; wide intermediates, null if the result leaves the long range."""
    wide = "decimal(38,0)"
    top = value.cast("decimal(19,0)") * (src_num * dst_den).cast("decimal(18,0)")
    return F.try_divide(top - F.call_function("mod", top, (src_den * dst_num).cast(wide)), (src_den * dst_num).cast("decimal(18,0)")).cast("decimal(20,0)").try_cast("bigint")


def sample_to_pts(sample: Column, anchor: Column, num: Column, den: Column) -> Column:
    """Output time of a sample index, always from the immutable anchor, so errors don't add up."""
    return anchor + rescale(sample, F.lit(1), F.lit(SAMPLE_RATE), num, den)


def next_expected_pts(samples_so_far: Column, anchor: Column, num: Column, den: Column) -> Column:
    """Output time at which the next contiguous packet begins."""
    return sample_to_pts(samples_so_far, anchor, num, den)


def saturating_add(a: Column, b: Column) -> Column:
    """a + b, held at the ends of the long range."""
    return F.coalesce(F.try_add(a, b), F.when(b > 0, F.lit(MAX_LONG)).otherwise(F.lit(MIN_LONG)))


def saturating_range(start: Column, end: Column, anchor: Column, num: Column, den: Column) -> Column:
    """Struct (start_pts, end_pts) of a sample range; additions saturate and end is never before start."""
    at = lambda s: saturating_add(anchor, F.coalesce(rescale(s, F.lit(1), F.lit(SAMPLE_RATE), num, den), F.lit(MAX_LONG)))
    return F.struct(at(start).alias("start_pts"), F.greatest(at(start), at(end)).alias("end_pts"))


def seconds_to_samples(seconds: Column) -> Column:
    """Nearest sample, halves upward."""
    return F.floor(seconds.cast("double") * SAMPLE_RATE + 0.5).cast("bigint")


def ms_to_samples(ms: Column) -> Column:
    """16 samples a millisecond, saturating."""
    return F.coalesce(F.try_multiply(ms, F.lit(16).cast("bigint")), F.when(ms > 0, F.lit(MAX_LONG)).otherwise(F.lit(MIN_LONG)))


def cs_to_ms(cs: Column) -> Column:
    """10 ms a centisecond, saturating."""
    return F.coalesce(F.try_multiply(cs, F.lit(10).cast("bigint")), F.when(cs > 0, F.lit(MAX_LONG)).otherwise(F.lit(MIN_LONG)))


def saturate_to_long(value: Column) -> Column:
    """An unsigned or wide integer held at the largest long."""
    return F.least(value.cast("decimal(38,0)"), F.lit(MAX_LONG).cast("decimal(38,0)")).cast("bigint")


def samples_per_frame(n_samples: Column, frames: Column, hop: int = 320) -> Column:
    """Effective samples of a frame: n / (T - 1) from two frames on, else the nominal hop."""
    return F.when(frames >= 2, n_samples.cast("double") / (frames - 1)).otherwise(F.lit(float(hop)))


def max_silent_frames(ms: int = 80, hop: int = 320) -> int:
    """Frames of the longest silent run that a word may hold."""
    return ms * 16 // hop
