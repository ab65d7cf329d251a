"""Panel time-series analytics on Spark: DataFrame in, DataFrame out."""
