"""Inference features and scored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import FeatureParams
from tidemark.operators.calibrate import ConformalInterval
from tidemark.operators.features import build_features


def inference_features(
    panel: DataFrame, p: FeatureParams = FeatureParams(), *, symbol: str | None = None, months: int = 12
) -> DataFrame:
    """Features of the last `months` months of history, rows without a target included.

    For all symbols, or one (its name is upper-cased).
    """
    if symbol is not None:
        panel = panel.where(F.col("symbol") == symbol.upper())
    newest = panel.agg(F.max("date")).first()[0]
    if newest is None:
        raise ValueError("no bars to score")
    return build_features(panel.where(F.col("date") >= F.add_months(F.lit(newest), -months)), p)


def quantile_columns(df: DataFrame, yq: str, quantiles) -> DataFrame:
    """One `pred_Q_<percent>` column per level."""
    return df.withColumns(
        {f"pred_Q_{int(t * 100)}": F.get(F.col(yq), F.lit(i)) for i, t in enumerate(quantiles)}
    )


def prediction_intervals(df: DataFrame, calibrator: ConformalInterval, y_hat: str) -> DataFrame:
    """`pred_low_quantile` and `pred_high_quantile` around the point forecast."""
    return (
        calibrator.transform(df, y_hat)
        .withColumnRenamed("lower", "pred_low_quantile")
        .withColumnRenamed("upper", "pred_high_quantile")
    )


def latest_rows(df: DataFrame, n: int = 1, where_known: str | None = None) -> DataFrame:
    """The last n rows of every symbol by date, optionally among rows where a column is known.

    Spark keeps at most n rows per symbol on the map side before the shuffle.
    """
    if where_known:
        df = df.where(F.col(where_known).isNotNull())
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def latest_forecast(df: DataFrame, low: str, mid: str, high: str, target: str) -> DataFrame:
    """Interval width and median forecast on the last labelled row of every symbol."""
    return latest_rows(df, 1, target).select(
        "symbol",
        "date",
        F.col(low).alias("low"),
        F.col(mid).alias("median"),
        F.col(high).alias("high"),
        (F.col(high) - F.col(low)).alias("width"),
    )
