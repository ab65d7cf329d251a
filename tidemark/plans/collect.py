"""Batch ingestion: plan, collect, check, upsert."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.config import QualityRules
from tidemark.operators.ingest import (
    collection_plan,
    collection_summary,
    planned_rows,
    prune_source,
    symbol_status,
    untouched_days,
    upsert_history,
    upsert_metadata,
)
from tidemark.operators.timeline import densify
from tidemark.session import checkpoint
from tidemark.sources import versions
from tidemark.sources.tables import overwrite_csv, read_bars, read_metadata


@dataclass
class Collected:
    plans: DataFrame
    status: DataFrame
    accepted: DataFrame
    history: DataFrame
    metadata: DataFrame
    summary: DataFrame


def collect(
    tickers: DataFrame,
    metadata: DataFrame,
    source: DataFrame,
    history: DataFrame,
    run_date: dt.date,
    rules: QualityRules = QualityRules(),
) -> Collected:
    """One ingestion run over all tickers at once.

    `source` holds the bars on offer; it is read several times, so it should be a stored table.
    Symbols that fail a stage contribute no rows and are recorded with the stage's status.
    """
    plans = collection_plan(tickers, metadata)
    bars = planned_rows(prune_source(source, plans), plans)
    status = checkpoint(symbol_status(plans, bars, run_date, rules))
    active = status.where("status = 'active'").select("symbol")
    # no day of an active symbol occurs twice
    accepted = densify(bars.join(active, "symbol", "left_semi"), unique=True)
    merged = upsert_history(history, accepted)
    return Collected(
        plans,
        status,
        accepted,
        merged,
        upsert_metadata(metadata, status),
        collection_summary(status, accepted, untouched=untouched_days(history, accepted)),
    )


def run_collection(
    spark: SparkSession,
    tickers: DataFrame,
    source: DataFrame,
    metadata_path: str,
    history_path: str,
    run_date: dt.date,
    rules: QualityRules = QualityRules(),
) -> DataFrame:
    """Run `collect` against stored tables and bring them up to date; returns the summary row.

    The history gets a new version of the months that have new bars; the others are neither read
    nor written. A table of bars without versions is taken over by the first run.
    """
    at = versions.version(spark, history_path)
    stored = read_bars(spark, history_path)
    done = collect(tickers, read_metadata(spark, metadata_path), source, stored, run_date, rules)
    accepted, metadata = checkpoint(done.accepted), checkpoint(done.metadata)
    base = None if at.number else stored
    if not accepted.isEmpty():
        total = versions.upsert(spark, history_path, accepted, upsert_history, base).total
    else:
        total = at.total if base is None else base
    summary = checkpoint(collection_summary(done.status, accepted, total))
    overwrite_csv(metadata, metadata_path)
    return summary
