"""Leakage-safe time splits of a labelled panel."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import require_columns

SPLITS = ["train", "val", "cal", "test"]


def distinct_dates(df: DataFrame, date_col: str = "date") -> list[dt.date]:
    """Sorted distinct dates: one row per calendar day, so small whatever the panel holds."""
    rows = df.select(F.to_date(date_col).alias("d")).distinct().where("d is not null").collect()
    return sorted(r.d for r in rows)


def cut_dates(dates: list[dt.date], fractions: tuple[float, ...]) -> tuple[dt.date, ...]:
    """Last train, validation and calibration date, by share of distinct dates."""
    if not math.isclose(sum(fractions), 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError("fractions must sum to 1")
    n = len(dates)
    if n < 10:
        raise ValueError("too few distinct dates for fractional splits")
    position, previous, cuts = 0.0, -1, []
    for share in fractions[:3]:
        # plain float sums: 0.6 + 0.1 + 0.2 stays just under 0.9
        position += share
        index = max(math.floor(n * position) - 1, previous + 1)
        cuts.append(dates[index])
        previous = index
    return tuple(cuts)


def _segment(d: Column, cuts: tuple[dt.date, ...]) -> Column:
    train_end, val_end, cal_end = (F.lit(c) for c in cuts)
    return (
        F.when(d <= train_end, "train")
        .when(d <= val_end, "val")
        .when(d <= cal_end, "cal")
        .otherwise("test")
    )


def with_holdout_split(
    df: DataFrame,
    date_col: str = "date",
    symbol_col: str = "symbol",
    *,
    fractions: tuple[float, ...] = (0.7, 0.1, 0.1, 0.1),
    cuts: tuple[dt.date, dt.date, dt.date] | None = None,
    horizon_days: int = 5,
    embargo_days: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Add `split`: train, val, cal, test or purged.

    A row's label spans [t, t + horizon). A row is purged when that span
    touches a later segment widened by the embargo: train against val, cal and
    test, val and cal against test (`strict` also checks val against cal).
    Only the distinct dates are looked up first; the split itself is a column
    expression on date literals, so it adds no shuffle.
    """
    require_columns(df, [date_col, symbol_col])
    dates = distinct_dates(df, date_col)
    if cuts is None:
        cuts = cut_dates(dates, fractions)
    embargo = horizon_days if embargo_days is None else embargo_days
    d = F.to_date(date_col)
    bounds: dict[str, tuple[dt.date, dt.date]] = {}
    for day in dates:
        name = SPLITS[sum(day > c for c in cuts)]
        lo, hi = bounds.get(name, (day, day))
        bounds[name] = (min(lo, day), max(hi, day))

    def touches(name: str) -> Column:
        if name in bounds:
            lo, hi = bounds[name]
        elif dates:
            # an empty segment degenerates to the first date with no width
            start = F.lit(dates[0])
            return (d < start) & (F.date_add(d, horizon_days) > start)
        else:
            return F.lit(False)
        start = F.lit(lo - dt.timedelta(days=embargo))
        stop = F.lit(hi + dt.timedelta(days=horizon_days + embargo))
        return (d < stop) & (F.date_add(d, horizon_days) > start)

    later = {"train": ["val", "cal", "test"], "val": ["test"], "cal": ["test"]}
    if strict:
        later["val"] = ["cal", "test"]
    segment = _segment(d, cuts)
    purged = F.lit(False)
    for name, against in later.items():
        hit = F.lit(False)
        for other in against:
            hit = hit | touches(other)
        purged = purged | ((segment == name) & hit)
    return df.withColumn("split", F.when(purged, "purged").otherwise(segment))


def modeling_sets(df: DataFrame, feature_cols: list[str], target: str, **split_args) -> DataFrame:
    """Keys, features, target and `split` without purged rows; every split must hold rows."""
    require_columns(df, ["date", "symbol", target, *feature_cols])
    columns = list(dict.fromkeys(["symbol", "date", *feature_cols, target]))
    out = with_holdout_split(df.select(*columns), **split_args).where("split <> 'purged'")
    present = {r.split for r in out.select("split").distinct().collect()}
    empty = [s for s in SPLITS if s not in present]
    if empty:
        raise ValueError(f"empty splits: {empty}")
    return out


def fold_windows(
    dates: list[dt.date], n_splits: int, span_days: int | None = None
) -> list[tuple[dt.date, dt.date]]:
    """Test windows over the sorted dates: equal parts, or anchors with a fixed span."""
    n = len(dates)
    if span_days is None:
        edge = [int(i * (n / n_splits)) for i in range(n_splits)] + [n]
        return [(dates[edge[i]], dates[edge[i + 1] - 1]) for i in range(n_splits)]
    step = (n - 1) / (n_splits - 1)
    anchors = [int(i * step) for i in range(n_splits - 1)] + [n - 1]
    span = dt.timedelta(days=span_days)
    return sorted((dates[a], min(dates[-1], dates[a] + span)) for a in anchors)


def purged_folds(
    df: DataFrame,
    n_splits: int = 5,
    date_col: str = "date",
    *,
    horizon_days: int = 5,
    embargo_days: int | None = None,
    span_days: int | None = None,
    min_train_fraction: float = 0.05,
) -> DataFrame:
    """Rows with `fold` and `role` (train or test) of a purged, embargoed time-series CV.

    Train rows end embargo + horizon days before the test window. A fold whose
    train part is below the minimum share is left out. The handful of windows
    become literals, so assigning folds is a projection, not a range join.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    require_columns(df, [date_col])
    embargo = horizon_days if embargo_days is None else embargo_days
    per_day = {
        r.d: r.n
        for r in df.groupBy(F.to_date(date_col).alias("d"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("d is not null")
        .collect()
    }
    dates, total = sorted(per_day), sum(per_day.values())
    d = F.to_date(date_col)
    roles = []
    for fold, (start, end) in enumerate(fold_windows(dates, n_splits, span_days)):
        cutoff = start - dt.timedelta(days=embargo + horizon_days)
        if sum(n for day, n in per_day.items() if day <= cutoff) < min_train_fraction * total:
            continue
        role = F.when(d.between(F.lit(start), F.lit(end)), "test").when(d <= F.lit(cutoff), "train")
        roles.append(
            F.when(role.isNotNull(), F.struct(F.lit(fold).alias("fold"), role.alias("role")))
        )
    if not roles:
        return df.withColumns({"fold": F.lit(0), "role": F.lit("")}).limit(0)
    return (
        df.withColumn("_fold", F.explode(F.array_compact(F.array(*roles))))
        .select(*df.columns, "_fold.fold", "_fold.role")
    )
