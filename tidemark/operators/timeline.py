"""Calendar densify, forward fill, calendar parts and the look-back filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import BAR_COLUMNS
from tidemark.functions.windows import PanelWindow
from tidemark.schema import require_columns
from tidemark.session import shuffle_partitions

_VALUES = ["open", "high", "low", "close", "volume"]


def unique_days(bars: DataFrame) -> DataFrame:
    """One row per (symbol, date) with `_dup`, the number of rows it stood for.

    Aggregates on the full key before anything is grouped by symbol, so a
    symbol with any number of repeated rows reaches the windows with at most
    one row per calendar day. A row without a date makes its symbol invalid.
    """
    return bars.groupBy("symbol", "date").agg(
        *[F.first(c).alias(c) for c in _VALUES], F.count(F.lit(1)).alias("_dup")
    )


def timeline_status(bars: DataFrame) -> DataFrame:
    """(symbol, timeline_ok, n_rows): false when a day occurs twice or has no date."""
    return (
        bars.groupBy("symbol", "date")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("symbol")
        .agg(
            (F.count_if((F.col("_n") > 1) | F.col("date").isNull()) == 0).alias("timeline_ok"),
            F.sum("_n").alias("n_rows"),
        )
    )


def densify(bars: DataFrame, *, fill: bool = False, unique: bool = False) -> DataFrame:
    """One row per symbol and calendar day between its first and last bar.

    Each bar is repeated over the gap up to the symbol's next bar, which needs
    the one exchange by symbol that every later window reuses, and no join
    with a calendar. Added days hold NULL values, or with `fill` the last
    known value of each column. Symbols with a repeated day are left out
    (`timeline_status` names them). `unique=True` skips the check when the
    keys are unique by construction, e.g. straight from `make_bars`.
    """
    require_columns(bars, BAR_COLUMNS, "bars")
    w = PanelWindow()
    if unique:
        days = bars.select(*BAR_COLUMNS)
        ok = F.lit(True)
    else:
        days = unique_days(bars)
        ok = F.max((F.col("_dup") > 1) | F.col("date").isNull()).over(
            Window.partitionBy("symbol")
        ) == F.lit(False)
    # Days multiply after this exchange. Coalescing by its few bytes would leave
    # most cores idle in every later window, so the partition count is fixed.
    days = days.repartition(shuffle_partitions(days.sparkSession), "symbol")
    following = w.lead("date")
    values = {c: w.ffill(c) if fill else F.col(c) for c in _VALUES}
    stretched = days.select(
        "symbol",
        F.col("date").alias("_day"),
        F.coalesce(F.date_sub(following, 1), F.col("date")).alias("_until"),
        *[v.alias(c) for c, v in values.items()],
        ok.alias("_ok"),
    ).where("_ok")
    dense = stretched.select(
        "symbol", "_day", *_VALUES, F.explode(F.sequence("_day", "_until")).alias("date")
    )
    if fill:
        return dense.select(*BAR_COLUMNS)
    known = F.col("date") == F.col("_day")
    return dense.select(
        "date", "symbol", *[F.when(known, F.col(c)).alias(c) for c in _VALUES]
    )


def forward_fill(panel: DataFrame, keys=("symbol",), order: str = "date") -> DataFrame:
    """Last non-null value of every other column, in date order within the symbol."""
    w = PanelWindow(tuple(keys), order)
    names = [c for c in panel.columns if c not in (*keys, order)]
    return panel.withColumns({c: w.ffill(c) for c in names})


def add_calendar(panel: DataFrame) -> DataFrame:
    """Year, month, ISO weekday (Monday 1 .. Sunday 7) and day of year."""
    return panel.withColumns(
        {
            "year": F.year("date"),
            "month": F.month("date"),
            "day_of_week": F.weekday("date") + 1,
            "day_of_year": F.dayofyear("date"),
        }
    )


def filled_panel(panel: DataFrame) -> DataFrame:
    """Forward fill, drop rows that still miss a value, add calendar parts."""
    return add_calendar(forward_fill(panel).dropna("any"))


def within_horizon(panel: DataFrame, past_horizon: int) -> DataFrame:
    """Rows of the last `past_horizon` days before the newest date of all symbols.

    The newest date is found first and enters as a literal: on a parquet
    source both the search and the filter use footer statistics.
    """
    if past_horizon <= 0:
        return panel
    newest = panel.agg(F.max("date")).first()[0]
    if newest is None:
        return panel
    return panel.where(F.col("date") >= F.date_sub(F.lit(newest), past_horizon))
