"""Collection plans, metadata and history upserts, per-symbol outcome."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import BAR_COLUMNS, INTERVALS, PERIODS, QualityRules
from tidemark.operators.quality import quality_report
from tidemark.operators.timeline import densify
from tidemark.sources.tables import enforce_schema


def latest_metadata(metadata: DataFrame) -> DataFrame:
    """One row per symbol, the most recently ingested one.

    `row_number() = 1` lets Spark drop all but the best row per symbol on the
    map side, before the shuffle.
    """
    newest = Window.partitionBy("symbol").orderBy(
        F.desc_nulls_last("last_ingestion"),
        F.desc_nulls_last("max_date_recorded"),
        F.desc_nulls_last("status"),
    )
    return (
        metadata.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")
    )


def collection_plan(tickers: DataFrame, metadata: DataFrame) -> DataFrame:
    """(symbol, period, start) for every ticker that is to be collected.

    New symbols get the whole history, active ones start the day after their
    last ingestion, all others are left out.
    """
    known = latest_metadata(metadata).select(
        "symbol", "last_ingestion", "status", F.lit(True).alias("_known")
    )
    joined = tickers.select("symbol").join(known, "symbol", "left")
    return joined.where(F.col("_known").isNull() | (F.col("status") == "active")).select(
        "symbol",
        F.when(F.col("_known").isNull(), F.lit("max")).alias("period"),
        F.date_format(F.date_add("last_ingestion", 1), "yyyy-MM-dd").alias("start"),
    )


def skipped_tickers(tickers: DataFrame, metadata: DataFrame) -> DataFrame:
    """Tickers that `collection_plan` leaves out, with their status."""
    stopped = latest_metadata(metadata).where(~F.col("status").eqNullSafe("active"))
    return tickers.select("symbol").join(stopped.select("symbol", "status"), "symbol")


def validate_plans(plans: DataFrame) -> DataFrame:
    """Add `violations` (array of rule names) and `is_valid` to plan parameters.

    Columns: symbol, start, end, interval, period, all strings, NULL when not given.
    """
    given = {c: F.col(c).isNotNull() for c in ("start", "end", "interval", "period")}
    day = {c: F.try_to_date(c, "yyyy-MM-dd") for c in ("start", "end")}
    rules = [
        (~(given["start"] | given["end"] | given["interval"] | given["period"]), "no_parameter"),
        (~given["start"] & ~given["period"], "start_or_period_required"),
        (given["start"] & given["period"], "start_and_period"),
        (given["end"] & given["period"], "end_and_period"),
        (day["start"] >= day["end"], "start_not_before_end"),
        (given["start"] & given["end"] & given["interval"], "interval_with_start_and_end"),
        (given["start"] & day["start"].isNull(), "start_format"),
        (given["end"] & day["end"].isNull(), "end_format"),
        (~F.col("interval").isin(INTERVALS), "unknown_interval"),
        (~F.col("period").isin(PERIODS), "unknown_period"),
    ]
    names = [F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for broken, name in rules]
    return plans.withColumn("violations", F.array_compact(F.array(*names))).withColumn(
        "is_valid", F.size("violations") == 0
    )


def period_start(period: str, newest: dt.date) -> dt.date | None:
    """First day of a look-back period that ends at `newest`; None for the whole history."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}")
    if period == "max":
        return None
    if period == "ytd":
        return newest.replace(month=1, day=1)
    if period.endswith("d"):
        return newest - dt.timedelta(days=int(period[:-1]))
    months = int(period[:-2]) if period.endswith("mo") else 12 * int(period[:-1])
    total = newest.year * 12 + newest.month - 1 - months
    year, month = total // 12, total % 12 + 1
    last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(year, month, min(newest.day, last))


#: Up to so many plans their symbols reach the scan as a list; more are left to the join.
LISTED = 1_000


def prune_source(source: DataFrame, plans: DataFrame) -> DataFrame:
    """`source` without rows that no plan asks for, by literals that reach the scan.

    One row about the plans is looked up: the smallest start, if every plan has one, bounds
    the dates, and the symbols of a short list bound the symbols. What is left still goes
    through `planned_rows`; this only spares reading and shuffling.
    """
    start = F.to_date("start")
    seen = plans.agg(
        F.count("*").alias("n"), F.count(start).alias("dated"), F.min(start).alias("first")
    ).first()
    if seen.n and seen.n == seen.dated:
        source = source.where(F.col("date") >= F.lit(seen.first))
    if seen.n <= LISTED:
        symbols = sorted(r.symbol for r in plans.select("symbol").distinct().collect() if r.symbol is not None)
        source = source.where(F.col("symbol").isin(symbols))
    return source


def planned_rows(bars: DataFrame, plans: DataFrame) -> DataFrame:
    """Bars that the plans ask for: from `start` on, or all of them for period 'max'."""
    wanted = plans.select("symbol", F.to_date("start").alias("_start"))
    return (
        bars.join(wanted, "symbol")
        .where(F.col("_start").isNull() | (F.col("date") >= F.col("_start")))
        .drop("_start")
    )


def initial_metadata(symbols: DataFrame, run_date: dt.date) -> DataFrame:
    """Metadata of symbols about to be collected, before their outcome is known."""
    return symbols.select(
        "symbol",
        F.lit(run_date).cast("date").alias("last_ingestion"),
        F.lit(None).cast("date").alias("max_date_recorded"),
        F.lit("collection_issue").alias("status"),
    )


def symbol_status(
    plans: DataFrame,
    bars: DataFrame,
    run_date: dt.date,
    rules: QualityRules = QualityRules(),
) -> DataFrame:
    """New metadata, one row per planned symbol, naming the stage that failed.

    No bars: collection_issue; a cast failure or a repeated day: data_issue;
    a failed quality check: data_quality_issue; otherwise active.
    """
    cast = enforce_schema(bars)
    usable = cast.drop("_cast_failed")
    # one row a day, then one a symbol: all that does not need the order of the days
    facts = (
        cast.groupBy("symbol", "date")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_cast_failed").alias("_cast_failed"))
        .groupBy("symbol")
        .agg(
            (F.count_if((F.col("_n") > 1) | F.col("date").isNull()) == 0).alias("timeline_ok"),
            F.sum("_n").alias("n_rows"),
            F.max("_cast_failed").alias("_cast_failed"),
            F.max("date").alias("_newest"),
        )
    )
    # symbols with a repeated day go no further, so the days of the others need no second grouping
    whole = usable.join(facts.where("timeline_ok").select("symbol"), "symbol", "left_semi")
    quality = quality_report(densify(whole, unique=True), rules).select("symbol", "is_valid")
    facts = facts.join(quality, "symbol", "left")
    status = (
        F.when(F.col("n_rows").isNull(), "collection_issue")
        .when(~F.col("timeline_ok") | F.col("_cast_failed"), "data_issue")
        .when(~F.coalesce("is_valid", F.lit(False)), "data_quality_issue")
        .otherwise("active")
    )
    return (
        initial_metadata(plans, run_date)
        .drop("status", "max_date_recorded")
        .join(facts, "symbol", "left")
        .select("symbol", "last_ingestion", "_newest", status.alias("status"))
        .select(
            "symbol",
            "last_ingestion",
            F.when(F.col("status") == "active", F.col("_newest")).alias("max_date_recorded"),
            "status",
        )
    )


def upsert_metadata(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest row per symbol; on the same day the update wins."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(updates.withColumn("_src", F.lit(1)))
    newest = Window.partitionBy("symbol").orderBy(
        F.desc_nulls_first("last_ingestion"),
        F.desc("_src"),
        F.desc_nulls_last("max_date_recorded"),
        F.desc_nulls_last("status"),
    )
    return (
        both.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn", "_src")
    )


def upsert_history(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (symbol, date); new data wins, then the largest row.

    The row is kept whole, NULLs included. The full-row tie-break makes the
    result independent of file and task order. `row_number() = 1` is pruned
    to one row per key on the map side before the shuffle.
    """
    old = existing.select(*BAR_COLUMNS).withColumn("volume", F.col("volume").cast("long"))
    both = old.withColumn("_src", F.lit(0)).unionByName(
        new.select(*BAR_COLUMNS).withColumn("_src", F.lit(1))
    )
    ranked = Window.partitionBy("symbol", "date").orderBy(
        F.desc("_src"), *[F.desc_nulls_last(c) for c in BAR_COLUMNS[2:]]
    )
    return (
        both.withColumn("_rn", F.row_number().over(ranked)).where("_rn = 1").select(*BAR_COLUMNS)
    )


def untouched_days(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol, date), each once, of the rows that `upsert_history` takes from `existing`.

    `new` holds every day between a symbol's first and last bar (see `densify`), so the two ends
    of a symbol tell which days it replaces and none of its rows has to be moved.
    """
    spans = new.groupBy(F.col("symbol").alias("_symbol")).agg(
        F.count("*").alias("_n"), F.min("date").alias("_first"), F.max("date").alias("_last")
    )
    known = existing.select("symbol", "date").join(spans, F.col("symbol").eqNullSafe(F.col("_symbol")), "left")
    replaced = F.coalesce(F.col("date").between(F.col("_first"), F.col("_last")), F.lit(False))
    return known.where(~replaced).select("symbol", "date").distinct()


def collection_summary(
    status: DataFrame, new: DataFrame, total: DataFrame | int | None = None, untouched: DataFrame | None = None
) -> DataFrame:
    """One row: tickers processed, successes, new and total records, symbols updated.

    `status` has a row for every planned symbol. Each input is read once and cut down to one row
    a symbol or task before it is moved. `total` is the history, or its number of rows where
    that is known; instead of it `untouched` may give the rows of the history beside the new ones.
    """
    if (total is None) == (untouched is None):
        raise ValueError("give either the whole history or the rows beside the new ones")
    names = ["tickers_processed", "successful_collections", "new_records", "total_records", "symbols_updated"]
    zero = {n: F.lit(0).cast("long") for n in names}

    def part(df: DataFrame, **values) -> DataFrame:
        return df.select(*[F.coalesce(c.cast("long"), zero[n]).alias(n) for n, c in (zero | values).items()])

    per_symbol = new.groupBy("symbol").agg(F.count("*").alias("n"))
    also = {} if untouched is None else {"total_records": F.col("n")}
    rows = part(
        status,
        tickers_processed=F.lit(1),
        successful_collections=(F.col("status") == "active").cast("int"),
    ).unionByName(part(per_symbol, new_records=F.col("n"), symbols_updated=F.lit(1), **also))
    known = isinstance(total, int)
    if not known:
        counted = (untouched if total is None else total).agg(F.count("*").alias("n"))
        rows = rows.unionByName(part(counted, total_records=F.col("n")))
    out = rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    if known:
        out = out.withColumn("total_records", F.lit(total).cast("long"))
    return out.withColumn(
        "status", F.when(F.col("new_records") > 0, "success").otherwise("no_new_data")
    )
