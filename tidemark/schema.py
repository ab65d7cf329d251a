"""Table schemas shared by the stages."""

from __future__ import annotations

from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("last_ingestion", T.DateType()),
        T.StructField("max_date_recorded", T.DateType()),
        T.StructField("status", T.StringType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("label", T.StringType()),
    ]
)


def require_columns(df, columns, what: str = "input") -> None:
    """Raise when a column is absent; a schema check only, it runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
