"""Row-wise functions on a quantile array column (values along ascending tau)."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import double_array, sdiv


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def check_quantiles(quantiles, open_interval: bool = False) -> list[float]:
    """Sorted unique levels inside [0, 1] (or (0, 1)); raises otherwise."""
    q = sorted(float(x) for x in quantiles)
    if not q:
        raise ValueError("quantiles must not be empty")
    low_bad = q[0] <= 0 if open_interval else q[0] < 0
    high_bad = q[-1] >= 1 if open_interval else q[-1] > 1
    if low_bad or high_bad:
        raise ValueError("quantiles out of range")
    if len(set(q)) != len(q):
        raise ValueError("quantiles must be unique")
    return q


def check_alpha(alpha: float) -> float:
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must be in (0, 1)")
    return float(alpha)


def align_quantiles(yq, quantiles) -> tuple[Column, list[float]]:
    """Reorder the array so that its levels ascend; returns (array, sorted levels)."""
    yq = _col(yq)
    levels = check_quantiles(quantiles)
    order = sorted(range(len(quantiles)), key=lambda i: quantiles[i])
    if order == list(range(len(quantiles))):
        return yq, levels
    return F.array(*[F.get(yq, F.lit(i)) for i in order]), levels


def monotone(yq, size: int) -> Column:
    """Running maximum along tau. `size` is the (constant) number of levels."""
    yq = _col(yq)
    values = [F.get(yq, F.lit(i)) for i in range(size)]
    out, known = [values[0]], values[0].isNotNull()
    for i in range(1, size):
        # a missing level stays missing from there on instead of being skipped
        known = known & values[i].isNotNull()
        out.append(F.when(known, F.greatest(*values[: i + 1])))
    return F.array(*out)


def crosses(yq, size: int) -> Column:
    """True when any level is below its predecessor."""
    yq = _col(yq)
    if size < 2:
        return F.lit(False)
    steps = [F.get(yq, F.lit(i + 1)) < F.get(yq, F.lit(i)) for i in range(size - 1)]
    hit = steps[0]
    for s in steps[1:]:
        hit = hit | s
    return hit


def has_missing(yq) -> Column:
    """True when the array is NULL or holds a NULL or NaN."""
    yq = _col(yq)
    return F.coalesce(F.exists(yq, lambda x: x.isNull() | F.isnan(x)), F.lit(True))


def shift_array(yq, shifts) -> Column:
    """Add a constant vector, element by element."""
    yq = _col(yq)
    return F.array(*[F.get(yq, F.lit(i)) + F.lit(float(s)) for i, s in enumerate(shifts)])


def at_level(yq, levels, tau: float) -> Column:
    """Value at level tau: the stored column if present, else linear along tau, flat outside.

    The level grid is constant, so the two weights are found on the driver and
    the row only pays one multiply-add.
    """
    yq = _col(yq)
    for i, level in enumerate(levels):
        if abs(level - tau) <= 1e-12 + 1e-5 * abs(tau):
            return F.get(yq, F.lit(i))
    return interpolate_level(yq, levels, tau)


def has_level(levels, tau: float) -> bool:
    return any(abs(level - tau) <= 1e-12 + 1e-5 * abs(tau) for level in levels)


def interpolate_level(yq, levels, tau: float) -> Column:
    yq = _col(yq)
    if tau <= levels[0]:
        return F.get(yq, F.lit(0))
    if tau >= levels[-1]:
        return F.get(yq, F.lit(len(levels) - 1))
    j = bisect_left(levels, tau)
    lo, hi = F.get(yq, F.lit(j - 1)), F.get(yq, F.lit(j))
    share = (tau - levels[j - 1]) / (levels[j] - levels[j - 1])
    return lo + (hi - lo) * F.lit(share)


def pit(y, yq, levels) -> Column:
    """Level of y inside the monotone-repaired array; 0 below it, 1 above it.

    The scan runs from the top level down and blends the two neighbours of y,
    so ties between equal levels resolve to the upper one.
    """
    y = _col(y)
    n = len(levels)
    fixed = monotone(yq, n)
    v = [F.get(fixed, F.lit(i)) for i in range(n)]
    out = F.when(y < v[0], F.lit(0.0)).when(y > v[n - 1], F.lit(1.0))
    out = out.when(y == v[n - 1], F.lit(levels[-1]))
    for i in range(n - 2, -1, -1):
        rise = sdiv(y - v[i], v[i + 1] - v[i])
        out = out.when(y >= v[i], F.lit(levels[i]) + F.lit(levels[i + 1] - levels[i]) * rise)
    return out


def bin_of(x, edges) -> Column:
    """Index of the half-open bin [e_i, e_{i+1}) holding x, for constant edges."""
    return F.size(F.filter(double_array(edges), lambda e: e <= x)) - 1
