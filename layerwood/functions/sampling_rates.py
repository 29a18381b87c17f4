"""Keep-probabilities under which one pass over a stream draws enough rows.

A pass keeps every row independently.  Two tail bounds tell how far the number of
kept rows strays from its mean, except with probability ``MISS``:

* rows drawn with replacement follow a Poisson law; the table ``SPREADS`` gives
  the half-width in standard deviations, by mean;
* rows drawn without replacement follow a binomial law; Bernstein's inequality,
  solved for the rate, gives the half-width.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-widths below a mean, the width beyond, floors, and the chance of a miss.
SPREADS = ((6.0, 12.0), (16.0, 9.0))
WIDE_SPREAD = 6.0
LEAST_RATE = 1e-10
LEAST_MEAN = 1e-15
MISS = 1e-4


def poisson_half_width(mean: Column) -> Column:
    spread = F.lit(WIDE_SPREAD)
    for below, deviations in reversed(SPREADS):
        spread = F.when(mean < below, F.lit(deviations)).otherwise(spread)
    return spread * F.sqrt(mean)


def bernstein_half_width(rate: Column, n: Column, order: float, scale: float, miss: float) -> tuple[Column, Column]:
    """Shift and width of the rate interval: roots of (x - rate)^2 = 2 u (x - rate) + order u rate, u per row."""
    u = F.lit(scale * math.log(1 / miss)) / n
    return u, F.sqrt(u * u + order * u * rate)


def poisson_mean(size: Column, upper: bool) -> Column:
    """The largest or smallest mean that the wanted size is likely to come from."""
    width = poisson_half_width(size)
    return F.greatest(size + width, F.lit(LEAST_RATE)) if upper else F.greatest(size - width, F.lit(LEAST_MEAN))


def binomial_rate(n: Column, rate: Column, upper: bool, miss: float = MISS) -> Column:
    """The largest or smallest rate at which ``rate`` of n rows are likely to be kept."""
    if not upper:
        shift, width = bernstein_half_width(rate, n, 3.0, 2.0 / 3.0, miss)
        return rate + shift - width
    shift, width = bernstein_half_width(rate, n, 2.0, 1.0, miss)
    return F.least(F.greatest(rate + shift + width, F.lit(LEAST_RATE)), F.lit(1.0))


def keep_rate(size: Column, n: Column, with_replacement: bool) -> Column:
    """Rate that keeps at least ``size`` of n rows."""
    size, n = size.cast("double"), n.cast("double")
    return poisson_mean(size, True) / n if with_replacement else binomial_rate(n, size / n, True)
