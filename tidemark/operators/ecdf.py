"""Distributed order statistics: running counts per key over sorted values.

A window per key would put a whole key on one task, and one key (a feature, a
residual series, "all rows") may hold every row of the input. Here equal
values are counted first, the (key, value) pairs are range-partitioned into
pieces of similar size, and only piece subtotals cross piece boundaries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoint, shuffle_partitions


def range_pieces(df: DataFrame, order: list[str], pieces: int | None = None) -> DataFrame:
    """Range-partition by `order` and record the piece number of every row in `_piece`.

    Range bounds come from sampling and may differ when a plan runs again, so
    the numbered rows are checkpointed: what follows sees fixed pieces even if
    executors are lost.
    """
    n = pieces or shuffle_partitions(df.sparkSession)
    return checkpoint(df.repartitionByRange(n, *order).withColumn("_piece", F.spark_partition_id()))


def value_counts(df: DataFrame, key: str, value: str, counts: dict[str, Column]) -> DataFrame:
    """One row per distinct (key, value), in fixed range pieces."""
    tallied = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(key, value)
        .agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    )
    return range_pieces(tallied, [key, value])


def running_counts(pieces: DataFrame, key: str, value: str, counts: list[str]) -> DataFrame:
    """Add `cum_{c}`, `total_{c}` per count and `_next`, the key's next larger value."""
    subtotal = pieces.groupBy(key, "_piece").agg(
        *[F.sum(c).alias(f"_in_{c}") for c in counts], F.min(value).alias("_first")
    )
    by_piece = Window.partitionBy(key).orderBy("_piece")
    before = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    carried = subtotal.select(
        key,
        "_piece",
        *[F.coalesce(F.sum(f"_in_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in counts],
        *[F.sum(f"_in_{c}").over(whole).alias(f"total_{c}") for c in counts],
        F.lead("_first").over(by_piece).alias("_next_piece"),
    )
    w = Window.partitionBy(key, "_piece").orderBy(value)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return pieces.join(carried, [key, "_piece"]).select(
        key,
        value,
        *counts,
        *[(F.col(f"_before_{c}") + F.sum(c).over(upto)).alias(f"cum_{c}") for c in counts],
        *[f"total_{c}" for c in counts],
        F.coalesce(F.lead(value).over(w), F.col("_next_piece")).alias("_next"),
    )


def at_rank(value: str, count: str, rank: Column) -> Column:
    """Aggregate: the value holding 0-based `rank` among `count` copies (see running_counts)."""
    upto = F.col(f"cum_{count}")
    return F.max(F.when((upto - F.col(count) <= rank) & (rank < upto), F.col(value)))


def linear_quantiles(count: str, value: str, probs: list[float], prefix: str) -> list[Column]:
    """Aggregates `{prefix}lo{i}`, `{prefix}hi{i}`, `{prefix}at{i}` for each probability."""
    out = []
    last = F.col(f"total_{count}") - 1
    for i, p in enumerate(probs):
        pos = last * F.lit(float(p))
        out += [
            at_rank(value, count, F.floor(pos)).alias(f"{prefix}lo{i}"),
            at_rank(value, count, F.ceil(pos)).alias(f"{prefix}hi{i}"),
            F.max(pos - F.floor(pos)).alias(f"{prefix}at{i}"),
        ]
    return out


def between(prefix: str, i: int) -> Column:
    """The interpolated quantile from the aggregates of `linear_quantiles`."""
    lo, hi = F.col(f"{prefix}lo{i}"), F.col(f"{prefix}hi{i}")
    return lo + (hi - lo) * F.col(f"{prefix}at{i}")


def exact_quantiles(
    df: DataFrame, value: str, probs: list[float], key: str | None = None
) -> DataFrame:
    """(key, n, q array): linear-interpolated quantiles without a per-key task or map."""
    src = df.select(
        (F.col(key) if key else F.lit(0)).alias("_key"), F.col(value).cast("double").alias("_value")
    )
    run = running_counts(
        value_counts(src, "_key", "_value", {"n": F.lit(1)}), "_key", "_value", ["n"]
    )
    got = run.groupBy("_key").agg(
        F.max("total_n").alias("n"), *linear_quantiles("n", "_value", probs, "_q")
    )
    q = F.array(*[between("_q", i) for i in range(len(probs))]).alias("q")
    return got.select(F.col("_key").alias(key), "n", q) if key else got.select("n", q)


def conformal_quantiles(df: DataFrame, value: str, level: str, key: str) -> DataFrame:
    """(key, n, quantile): per key the k-th smallest value, k = ceil((n+1) * level) within [1, n].

    `level` is a column that is constant per key.
    """
    src = df.select(
        F.struct(F.col(key).alias("k"), F.col(level).cast("double").alias("level")).alias("_key"),
        F.col(value).cast("double").alias("_value"),
    )
    run = running_counts(
        value_counts(src, "_key", "_value", {"n": F.lit(1)}), "_key", "_value", ["n"]
    )
    n = F.col("total_n")
    k = F.greatest(F.least(F.ceil((n + 1) * F.col("_key.level")), n), F.lit(1))
    return run.groupBy("_key").agg(
        F.max(n).alias("n"), at_rank("_value", "n", k - 1).alias("quantile")
    ).select(F.col("_key.k").alias(key), "n", "quantile")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def global_rank(df: DataFrame, order: list[str]) -> DataFrame:
    """Add `_rank`, the 0-based position in the total order of `order`, without a single task."""
    pieces = range_pieces(df, order)
    sizes = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_size"))
    # one row per range piece, at most spark.sql.shuffle.partitions rows
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_piece", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    within = F.row_number().over(Window.partitionBy("_piece").orderBy(*order)) - 1
    return (
        pieces.join(offsets, "_piece")
        .withColumn("_rank", F.col("_offset") + within)
        .drop("_piece", "_offset")
    )


def with_halo(df: DataFrame, rows: int, block: int = 65_536) -> DataFrame:
    """Cut the global order into blocks and repeat each block's last `rows` rows in the next.

    Adds `_blk` and `_halo`. A frame of rows+1 rows over (`_blk`, `_rank`) is
    then complete for every row that is not halo.
    """
    block = max(block, rows)
    home = F.floor(F.col("_rank") / block)
    tail = F.col("_rank") % block >= block - rows
    copies = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_blk", F.explode(copies)).withColumn("_halo", F.col("_blk") != home)
