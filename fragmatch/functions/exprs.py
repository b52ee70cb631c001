"""Catalyst expressions; nothing here leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dof_for(size) -> Column:
    """Degrees of freedom of a colour fit over size x size pixels: 3 s^2 - 12, 1 at least."""
    return F.greatest(F.lit(1), F.lit(3) * size * size - F.lit(12)).cast("int")


def chi2_probability(rss, size: int, sigma: float = 0.02) -> Column:
    """Chi-square survival of rss / sigma^2 for an even number of degrees, as a finite sum.

    0 for a null, negative, infinite or NaN rss. Odd numbers of degrees need ``kernels.chi2_survival``.
    """
    dof = max(1, 3 * size * size - 12)
    if dof % 2:
        raise ValueError(f"{dof} degrees of freedom: odd")
    h = rss / F.lit(2 * sigma * sigma)
    total = sum((F.exp(-h + F.lit(float(j)) * F.log(h) - F.lit(math.lgamma(j + 1))) for j in range(1, dof // 2)), F.exp(-h))
    fine = rss.isNotNull() & ~F.isnan(rss) & (rss >= 0) & (rss < F.lit(float("inf")))
    return F.when(fine & (rss == 0), F.lit(1.0)).when(fine, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))).otherwise(F.lit(0.0))


def log_bayes_factor(rss, size, sigma: float = 0.02, log_p0=None) -> Column:
    """Log likelihood of the fit less that of the prior; -inf where the fit failed, 0 as a missing prior."""
    n = F.lit(3) * size * size
    value = -rss / F.lit(2 * sigma * sigma) - n * F.lit(0.5 * math.log(2 * math.pi * sigma * sigma)) - (F.lit(0.0) if log_p0 is None else F.coalesce(log_p0, F.lit(0.0)))
    return F.when(rss.isNull() | F.isnan(rss) | (rss == F.lit(float("inf"))), F.lit(float("-inf"))).otherwise(value)


def holder_exponent(slope) -> Column:
    """(slope - 2) / 2 of the log energy against the log size; 0 without a slope."""
    return F.coalesce((slope - 2) / 2, F.lit(0.0))


def agreement(a, b, width: float = 0.4) -> Column:
    """Log likelihood that two exponents agree."""
    return F.lit(-0.5) * F.pow((a - b) / F.lit(width), F.lit(2))


def effective_size(size, scale) -> Column:
    """The side in the original image of a patch that was cut at ``scale``."""
    return (size / scale).cast("int")


def clean_id(text) -> Column:
    """Letters, digits and ``._-`` of a name."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "")


def md5_shard(text, shards: int) -> Column:
    """The MD5 of a name, as a 128-bit number, modulo ``shards``; null for null."""
    digest = F.md5(text)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    n = F.lit(shards).cast("decimal(20,0)")
    high, low = half(1) % n, half(17) % n
    carry = pow(2, 64, shards)
    return ((high * F.lit(carry).cast("decimal(20,0)") + low) % n).cast("int")


def hot_colour(value) -> Column:
    """The "hot" colours of a value in [0, 1]: red, then green, then blue come up."""
    part = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(3.0) * value - F.lit(float(k))))
    return F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))


def patch_energy(patch) -> Column:
    """Mean squared deviation of a patch's values from their mean."""
    n = F.size(patch)
    mean = F.aggregate(patch, F.lit(0.0), lambda s, x: s + x) / n
    # the mean as the element of a list, or it would be worked out for every value again
    return F.aggregate(F.array(mean), F.lit(0.0), lambda _, m: F.aggregate(patch, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))) / n


def root_normalised(histogram) -> Column:
    """Square roots of a histogram's shares, so that plain distances are Hellinger's; null where the histogram is."""
    values = F.transform(histogram, lambda x: x.cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) + F.lit(1e-7)
    return F.transform(values, lambda x: F.sqrt(x / total))


def hough_cell(dx, dy, degrees, scale, step: float = 2, turn: float = 5, octave: float = 4) -> Column:
    """The 4-D cell of a transform; halves are rounded to even."""
    log2 = F.log2(F.greatest(scale, F.lit(1e-6)))
    return F.struct(
        F.bround(dx / F.lit(float(step))).cast("int").alias("ix"), F.bround(dy / F.lit(float(step))).cast("int").alias("iy"),
        F.bround(degrees / F.lit(float(turn))).cast("int").alias("it"), F.bround(log2 * F.lit(float(octave))).cast("int").alias("is"),
    )


def hough_transform(cell, step: float = 2, turn: float = 5, octave: float = 4) -> Column:
    """The transform at a cell's centre."""
    return F.struct(
        (cell["ix"] * F.lit(float(step))).alias("dx"), (cell["iy"] * F.lit(float(step))).alias("dy"),
        F.radians(cell["it"] * F.lit(float(turn))).alias("rotation"), F.pow(F.lit(2.0), cell["is"] / F.lit(float(octave))).alias("scale"),
    )
