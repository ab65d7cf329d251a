"""Bars from a trade or event table."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import BAR_COLUMNS, INTERVALS

# Interval names with a fixed length, as Spark interval strings.
_FIXED = {
    "1m": "1 minute",
    "2m": "2 minutes",
    "5m": "5 minutes",
    "15m": "15 minutes",
    "30m": "30 minutes",
    "60m": "60 minutes",
    "90m": "90 minutes",
    "1h": "1 hour",
    "5d": "5 days",
}


_HOUR = 3_600_000_000
#: More microseconds than any bar lasts; calendar bars get a day for changes of the clock.
_LENGTHS = {
    **{k: _HOUR * 24 * (d + 1) for k, d in {"1d": 1, "1wk": 7, "1mo": 31, "3mo": 92}.items()},
    "5d": _HOUR * 24 * 5,
    "90m": _HOUR * 3 // 2,
    **dict.fromkeys(["60m", "1h"], _HOUR),
    **{f"{m}m": _HOUR // 60 * m for m in (1, 2, 5, 15, 30)},
}
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def bar_start(ts: str | Column, interval: str) -> Column:
    """Start of the bar holding `ts`. Calendar bars truncate, fixed ones tile from the epoch."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {INTERVALS}")
    if interval == "1d":
        return F.to_date(ts)
    if interval == "1wk":
        return F.date_trunc("week", ts)
    if interval == "1mo":
        return F.date_trunc("month", ts)
    if interval == "3mo":
        return F.date_trunc("quarter", ts)
    return F.window(ts, _FIXED[interval]).start


def _local_micros(at: Column) -> Column:
    """Microseconds since 1970 by the clock on the wall."""
    at = at.cast("timestamp_ntz")
    minutes = F.unix_date(at.cast("date")).cast("long") * 1440 + F.hour(at) * 60 + F.minute(at)
    seconds = F.extract(F.lit("SECOND"), at)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("long")


def packed_order(schema: T.StructType, ts: str, tie_break: list[str], interval: str) -> Column | None:
    """One number that orders the trades of a bar as (ts, *tie_break) does, nulls first.

    The digits are the microseconds since the start of the bar and the tie breakers, each from 1, or 0
    where it is null. None unless `ts` is a timestamp, all tie breakers are integers, and every value
    they can take fits a number of 38 digits: two longs do not, a long and a short do.
    """
    kinds = {f.name: type(f.dataType) for f in schema.fields}
    zoned = kinds.get(ts) is T.TimestampType
    if not zoned and kinds.get(ts) is not T.TimestampNTZType:
        return None
    if not all(kinds.get(c) in _BITS for c in tie_break):
        return None
    widths = [_BITS[kinds[c]] for c in tie_break]
    size = _LENGTHS[interval]
    for bits in widths:
        size *= 2**bits + 1
    if size >= 10**38:
        return None
    wide = size >= 2**63
    number = lambda v: F.lit(Decimal(v)) if wide else F.lit(v)
    cast = lambda c: c.cast("decimal(20,0)" if wide else "long")
    start = bar_start(ts, interval)
    if zoned:
        since = F.unix_micros(ts) - F.unix_micros(start.cast("timestamp"))
    else:
        # a calendar bar begins up to an hour late where its midnight is skipped by the session's clock
        since = _local_micros(F.col(ts)) - _local_micros(start) + (0 if interval in _FIXED else _HOUR)
    key = cast(F.coalesce(since, F.lit(0)))
    for name, bits in zip(tie_break, widths):
        digit = F.coalesce(cast(F.col(name)) + number(2 ** (bits - 1) + 1), number(0))
        key = key * number(2**bits + 1) + digit
    return key


def make_bars(
    trades: DataFrame,
    *,
    symbol: str | Column,
    ts: str,
    price: str | Column,
    quantity: str | Column,
    tie_break: list[str],
    interval: str = "1d",
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Open, high, low, close and volume per symbol and bar.

    One aggregation on (symbol, bar): partial aggregates run before the
    shuffle, so a symbol holding a large share of the trades only sends one
    row per bar and map task. `start` (inclusive) and `end` (exclusive) are
    literals on the raw time column and reach the scan. `tie_break` must order
    the trades of one instant totally; open and close then do not depend on
    the row order. With an integer trade id (see packed_order) trades are
    hash-aggregated as they are read; other orders compare structs, for which
    Spark sorts the trades of a map task first.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    if start is not None:
        trades = trades.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        trades = trades.where(F.col(ts) < F.lit(end).cast("timestamp"))
    bucket = bar_start(ts, interval)
    order = [ts, *tie_break]
    # the order of one day's trades must not contain the day itself when it is all there is
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    if tie_break and (packed := packed_order(trades.schema, ts, tie_break, interval)) is not None:
        key = packed
    name = "date" if interval == "1d" else "bar"
    picked = trades.select(
        col(symbol).alias("symbol"),
        bucket.alias(name),
        col(price).cast("double").alias("_p"),
        col(quantity).alias("_v"),
        key.alias("_o"),
    )
    return (
        picked.groupBy("symbol", name)
        .agg(
            F.min_by("_p", "_o").alias("open"),
            F.max("_p").alias("high"),
            F.min("_p").alias("low"),
            F.max_by("_p", "_o").alias("close"),
            F.sum("_v").cast("long").alias("volume"),
        )
        .select(*[name if c == "date" else c for c in BAR_COLUMNS])
    )
