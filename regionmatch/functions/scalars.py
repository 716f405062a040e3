"""Column helpers: null-safe ratios, logistic maps, binning, interpolation, sampling order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column) -> Column:
    """Division that is null when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def clip(v: Column, lo, hi) -> Column:
    return F.least(F.greatest(v, F.lit(lo) if not isinstance(lo, Column) else lo),
                   F.lit(hi) if not isinstance(hi, Column) else hi)


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-v))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def left_closed_bin(v: Column, edges: Sequence[float]) -> Column:
    """Number of edges that are not above ``v``."""
    return sum((F.when(v >= e, 1).otherwise(0) for e in edges), F.lit(0))


def interpolate_rank(v: Column, knots: Column, top: int) -> Column:
    """Piecewise linear position of ``v`` in a sorted knot array of ``top + 1`` values, as a share of ``top``.

    The last knot not above ``v`` starts the segment, so repeated knots map to their last index.
    """
    below = F.size(F.filter(knots, lambda k: k <= v))
    lo = F.get(knots, below - 1)
    hi = F.get(knots, below)
    inside = (below - 1 + (v - lo) / (hi - lo)) / top
    return F.when(below <= 0, F.lit(0.0)).when(below > top, F.lit(1.0)).otherwise(inside)


def sample_key(seed: int, *cols: Column) -> Column:
    """Reproducible pseudo-random order of rows that any engine with md5 can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def draw(seed: int, a: Column, b: Column, n: Column) -> Column:
    """Index in [0, n) from two counters: the leading 60 bits of an md5, modulo n.

    Even to n / 2**60, so n has no practical limit; any engine with md5 can repeat it.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), a.cast("string"), b.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n
