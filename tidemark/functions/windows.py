"""Row-frame window primitives over a panel.

A `PanelWindow` names the partition keys and the order column once; every
helper uses the same partitioning and ordering, so any number of stacked
window levels needs one exchange and one sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import sdiv

#: Largest power (as a natural logarithm) that the running EWM sums may hold, below the double's.
LARGEST_LOG = 290 * math.log(10)
#: A row's weight (as a natural logarithm) from which on it no longer changes a double.
LEAST_LOG = 41.5


@dataclass(frozen=True)
class Chunks:
    """Rows of a chunk and of the run-up before it, whatever the length of a symbol."""

    rows: int
    run_up: int


def chunks_for(spans: list[int], look_back: int) -> Chunks:
    """Chunk and run-up that suit the EWM `spans` and row frames of `look_back` rows.

    The shortest span bounds the rows that one running sum may cover; the longest
    one says for how many rows a value counts. Spans of 1 have no memory.
    """
    decay = [-math.log(1.0 - 2.0 / (n + 1.0)) for n in spans if n > 1]
    if not decay:
        return Chunks(max(2000, look_back), look_back)
    most = int(LARGEST_LOG / max(decay))
    run_up = look_back + math.ceil(LEAST_LOG / min(decay))
    if most < 2 * run_up:
        raise ValueError(
            f"EWM spans {sorted(spans)} are too far apart: the longest needs {run_up} rows of "
            f"run-up, the shortest allows {most} rows in all"
        )
    return Chunks(most - run_up, run_up)


@dataclass(frozen=True)
class PanelWindow:
    keys: tuple[str, ...] = ("symbol",)
    order: str = "date"

    @property
    def spec(self):
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def last_rows(self, n: int):
        return self.spec.rowsBetween(-(n - 1), 0)

    @property
    def expanding(self):
        return self.spec.rowsBetween(Window.unboundedPreceding, 0)

    # --- shifts -------------------------------------------------------------
    def lag(self, x: str | Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.spec)

    def lead(self, x: str | Column, k: int = 1) -> Column:
        return F.lead(x, k).over(self.spec)

    def ffill(self, x: str | Column) -> Column:
        return F.last(x, ignorenulls=True).over(self.expanding)


@dataclass(frozen=True)
class Series:
    """One rolling series: its value per row, how to combine rows, and the window lengths."""

    value: Column
    windows: tuple[int, ...]
    how: str = "sum"  # sum | max | min | list


def rolling(df: DataFrame, w: PanelWindow, series: dict[str, Series]) -> DataFrame:
    """Add `{name}_{n}` for every series and window; NULL unless all n rows hold a value.

    Spark re-aggregates a sliding frame from scratch on every row. Here all
    windows are cut into blocks of their common divisor u instead: a block
    result combines u neighbouring rows (offsets 1..u-1), a window of m*u rows
    combines m block results (offsets u, 2u, ...). All series travel in one
    struct, so a row costs u-1 plus max(m)-1 offset reads however many series
    there are. Sums add the same numbers a sliding sum would, so flat windows
    are still exact; nothing is subtracted back out.
    """
    unit = math.gcd(*[n for s in series.values() for n in s.windows])
    longest = max(n for s in series.values() for n in s.windows)
    offsets = range(unit, longest, unit)
    names = list(series)

    df = df.withColumn("_row", F.struct(*[s.value.alias(n) for n, s in series.items()]))
    near = {f"_row{i}": w.lag("_row", i) for i in range(1, unit)}
    df = df.withColumns(near)
    rows = ["_row", *near]
    block = F.struct(
        *[_combine(series[n].how, [F.col(r)[n] for r in rows], lists=False).alias(n) for n in names]
    )
    df = df.withColumn("_block", block).drop(*rows)
    far = {f"_block{i}": w.lag("_block", i) for i in offsets}
    df = df.withColumns(far)
    out = {}
    for n in names:
        for length in series[n].windows:
            blocks = ["_block", *[f"_block{i}" for i in offsets if i < length]]
            out[f"{n}_{length}"] = _combine(
                series[n].how, [F.col(x)[n] for x in blocks], lists=True
            )
    return df.withColumns(out).drop("_block", *far)


def _combine(how: str, parts: list[Column], lists: bool) -> Column:
    if how == "sum":
        total = parts[0]
        for part in parts[1:]:
            total = total + part  # NULL as soon as one part is missing
        return total
    if how == "list":
        return F.flatten(F.array(*parts)) if lists else F.array(*parts)
    if len(parts) == 1:
        return parts[0]
    known = parts[0].isNotNull()
    for part in parts[1:]:
        known = known & part.isNotNull()
    return F.when(known, (F.greatest if how == "max" else F.least)(*parts))


def std_from_sums(s1: Column, s2: Column, n: int) -> Column:
    """Sample deviation from the sum and the sum of squares of n values."""
    squares = s2 - s1 * s1 / n
    # a difference of equal sums may come out just below zero; a missing one stays missing
    return F.sqrt(F.when(squares < 0, F.lit(0.0)).otherwise(squares) / (n - 1))


def moments_from_sums(s1, s2, s3, s4, n: int) -> tuple[Column, Column]:
    """Population skewness and excess kurtosis; NULL on a constant window.

    Raw power sums are accurate here because daily returns have a mean far
    below their deviation. Variance under 1e-13 of the mean square is noise of
    a constant window.
    """
    m = s1 / n
    v = s2 / n - m * m
    third = s3 / n - 3 * m * s2 / n + 2 * m * m * m
    fourth = s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m * m * m * m
    varies = v > s2 / n * 1e-13
    skew = F.when(varies, sdiv(third, v * F.sqrt(v)))
    kurt = F.when(varies, sdiv(fourth, v * v) - 3.0)
    return skew, kurt


def correlation(xs: list[Column], ys: list[Column]) -> Column:
    """Pearson correlation of two short value lists; NULL when either is constant.

    F.corr over a window raises on a constant window under ANSI, hence the
    centred sums written out.
    """
    n = len(xs)
    mx = sum(xs[1:], xs[0]) / n
    my = sum(ys[1:], ys[0]) / n
    dx, dy = [x - mx for x in xs], [y - my for y in ys]
    dot = lambda a, b: sum((p * q for p, q in zip(a[1:], b[1:])), a[0] * b[0])
    return sdiv(dot(dx, dy), F.sqrt(dot(dx, dx)) * F.sqrt(dot(dy, dy)))


def with_chunks(
    df: DataFrame, position: str, size: Chunks, keys=("symbol",), chunk: str = "_chunk"
) -> DataFrame:
    """Cut each key's rows into chunks of `size.rows`, each with a run-up.

    The last `size.run_up` rows of a chunk are repeated at the start of the next
    one, flagged `_run_up`. Every feature looks back fewer rows than that, so a chunk
    is computed on its own and the run-up rows are dropped afterwards. Keys that end
    before the first run-up are not duplicated at all.
    """
    home = F.floor(F.col(position) / size.rows).cast("int")
    tail = (F.col(position) % size.rows) >= (size.rows - size.run_up)
    copies = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn(chunk, F.explode(copies)).withColumn("_run_up", F.col(chunk) != home)


class Ewm:
    """Exponentially weighted moments (adjust=True) as plain running sums.

    With q = 1 - 2/(span+1), k the row number inside the partition and u = q^-k,
        sum_i q^(k-i) x_i  =  running_sum(x_i * u_i) / u_k,
    which one expanding window computes in O(n). Partitions are chunks of
    bounded length (`with_chunks`), so u stays inside double range. `up` is a
    column holding u (see `ewm_weight`). Weights count from the first non-null x. A
    span of 1 gives all weight to the row itself: its mean is x and, from the second
    value on, its deviation is missing.
    """

    def __init__(self, window: PanelWindow, span: int, up: str):
        self.w = window
        self.q = 1.0 - 2.0 / (span + 1.0)
        self.up = F.col(up)

    def _sum(self, x: Column) -> Column:
        return F.sum(x * self.up).over(self.w.expanding) / self.up

    def _weight(self, x: Column) -> Column:
        return F.sum(F.when(x.isNotNull(), self.up)).over(self.w.expanding) / self.up

    def mean(self, x: Column) -> Column:
        if self.q == 0.0:
            return x
        return F.when(x.isNotNull(), self._sum(x) / self._weight(x))

    def std(self, x: Column) -> Column:
        """Unbiased (reliability-weight) deviation; 0.0 at the first observation."""
        if self.q == 0.0:
            return F.when(x.isNotNull() & (F.count(x).over(self.w.expanding) == 1), F.lit(0.0))
        w1 = self._weight(x)
        # w1 = (1 - q^n) / (1 - q) gives q^n, and with it the sum of squared weights
        qn = 1.0 - w1 * (1.0 - self.q)
        w2 = (1.0 - qn * qn) / (1.0 - self.q * self.q)
        mean = self._sum(x) / w1
        biased = F.greatest(self._sum(x * x) / w1 - mean * mean, F.lit(0.0))
        first = F.count(x).over(self.w.expanding) == 1
        return F.when(
            x.isNotNull(),
            F.when(first, F.lit(0.0)).otherwise(F.sqrt(sdiv(biased * w1 * w1, w1 * w1 - w2))),
        )


def ewm_weight(span: int, position: str = "_k") -> Column:
    """q^-k for row number k, the growing weight of the running EWM sums."""
    if span == 1:
        return F.lit(1.0)
    return F.pow(F.lit(1.0 - 2.0 / (span + 1.0)), -F.col(position))
