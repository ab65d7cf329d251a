"""Performance reports, rolling trends and the monitoring run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions.scalars import sdiv
from tidemark.operators import evaluate as E
from tidemark.operators.drift import (
    drift_rows,
    feature_drift,
    feature_drift_summary,
    prediction_drift,
    prediction_drift_summary,
    target_drift,
)
from tidemark.operators.ecdf import exact_quantiles, global_rank, union_all, with_halo


def performance_report(df: DataFrame, y: str, yq: str, quantiles) -> DataFrame:
    """(section, entity, metric, value) of quantile forecasts, rows with a missing value removed."""
    forecasts, levels = E.valid_forecasts(df, y, yq, quantiles)
    k = range(len(levels))
    loss, cov = [F.col(f"loss{i}") for i in k], [F.col(f"cov{i}") for i in k]
    err = [cov[i] - levels[i] for i in k]
    names = [f"q_{t:.2f}" for t in levels]
    cells: list[tuple[str, str | None, str, Column]] = []
    for i in k:
        cells += [
            ("pinball_losses", names[i], "loss", loss[i]),
            ("coverage", names[i], "coverage", cov[i]),
            ("coverage", names[i], "error", err[i]),
        ]
    cells += [
        ("pinball_losses", None, "mean", E._mean(loss)),
        ("pinball_losses", None, "median", E._median(loss)),
        ("pinball_losses", None, "max", E._top(loss)),
        ("coverage", None, "mean_absolute_error", E._mean([F.abs(e) for e in err])),
        ("coverage", None, "max_absolute_error", E._top([F.abs(e) for e in err])),
        ("coverage", None, "bias", E._mean(err)),
        (
            "calibration",
            None,
            "pit_ece",
            E._mean([F.abs(F.col(f"bin{b}") - 1.0 / E.PIT_BINS) for b in range(E.PIT_BINS)]),
        ),
        ("distributional", None, "crps", E.crps(loss, levels)),
        ("monotonicity", None, "violation_rate", F.coalesce("cross_rate", F.lit(0.0))),
        ("monotonicity", None, "violation_count", F.coalesce("cross_count", F.lit(0.0))),
        ("sample_info", None, "n_valid_samples", F.col("n")),
    ]
    counts = forecasts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("_ok")).alias("removed")
    )
    return union_all(
        [
            _cells(E.quantile_sums(forecasts, levels), cells),
            _cells(
                E.pit_ks(forecasts, levels),
                [("calibration", None, "pit_ks_statistic", F.col("pit_ks"))],
            ),
            _cells(
                counts,
                [
                    ("sample_info", None, "n_total_samples", F.col("total")),
                    ("sample_info", None, "n_nan_removed", F.col("removed")),
                ],
            ),
        ]
    )


def _cells(row: DataFrame, cells) -> DataFrame:
    parts = [
        F.struct(
            F.lit(s).alias("section"),
            F.lit(e).cast("string").alias("entity"),
            F.lit(m).alias("metric"),
            c.cast("double").alias("value"),
        )
        for s, e, m, c in cells
    ]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def performance_trend(
    df: DataFrame, y: str, yq: str, quantiles, *, date: str = "date", tie: str = "symbol",
    window_size: int = 30, block: int = 65_536,
) -> DataFrame:
    """Pinball loss, coverage error and CRPS over the last `window_size` rows of the whole table.

    Rows are ordered by (date, tie) over all symbols; each full window gives
    one output row. The order is cut into blocks whose first rows repeat the
    end of the previous block, so no task holds more than one block.
    """
    forecasts, levels = A.align_quantiles(yq, quantiles)
    k = range(len(levels))
    rows = df.select(
        F.col(date).alias("date"),
        F.col(tie).alias("tie"),
        F.col(y).cast("double").alias("_y"),
        forecasts.alias("_q"),
    )
    ok = F.col("date").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_y") & ~A.has_missing("_q")
    q = [F.get(F.col("_q"), F.lit(i)) for i in k]
    rows = rows.where(ok).select(
        "date",
        "tie",
        *[E.pinball(F.col("_y"), q[i], levels[i]).alias(f"loss{i}") for i in k],
        *[(F.col("_y") <= q[i]).cast("double").alias(f"cov{i}") for i in k],
    )
    ranked = with_halo(global_rank(rows, ["date", "tie"]), window_size - 1, block)
    frame = Window.partitionBy("_blk").orderBy("_rank").rowsBetween(-(window_size - 1), 0)
    means = ranked.select(
        "date",
        "tie",
        "_rank",
        "_halo",
        *[F.avg(f"loss{i}").over(frame).alias(f"loss{i}") for i in k],
        *[F.avg(f"cov{i}").over(frame).alias(f"cov{i}") for i in k],
    ).where(~F.col("_halo") & (F.col("_rank") >= window_size - 1))
    loss = [F.col(f"loss{i}") for i in k]
    return means.select(
        "date",
        F.col("tie").alias(tie),
        E._mean(loss).alias("mean_pinball_loss"),
        E._mean([F.abs(F.col(f"cov{i}") - levels[i]) for i in k]).alias("mean_coverage_error"),
        E.crps(loss, levels).alias("crps"),
    )


def _widths(df: DataFrame, lower: str, upper: str, y: str | None = None) -> DataFrame:
    """Valid rows with `width`; lower > upper fails the job."""
    cols = [F.col(c).cast("double") for c in (lower, upper, *([y] if y else []))]
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & ~F.isnan(c)
    out = df.where(ok).select(
        cols[0].alias("_lo"), cols[1].alias("_hi"), *([cols[2].alias("_y")] if y else [])
    )
    return out.withColumn("width", F.col("_hi") - F.col("_lo"))


def interval_report(
    df: DataFrame, y: str, lower: str, upper: str, confidence_level: float = 0.8
) -> DataFrame:
    """(section, entity, metric, value): coverage, widths and scores of intervals."""
    sums = E.interval_sums(df, y, lower, upper, 1.0 - confidence_level)
    spread = exact_quantiles(_widths(df, lower, upper, y), "width", [0.25, 0.5, 0.75])
    normalized = E.normalized_width()
    return union_all(
        [
            _cells(
                sums,
                [
                    ("coverage", None, "observed", F.col("covered")),
                    ("coverage", None, "target", F.lit(confidence_level)),
                    ("coverage", None, "error", F.col("covered") - confidence_level),
                    ("coverage", None, "below_lower_rate", F.col("below")),
                    ("coverage", None, "above_upper_rate", F.col("above")),
                    ("interval_width", None, "mean_width", F.col("width")),
                    ("interval_width", None, "normalized_width", normalized),
                    ("width_statistics", None, "min", F.col("width_min")),
                    ("width_statistics", None, "max", F.col("width_max")),
                    ("width_statistics", None, "mean", F.col("width")),
                    ("width_statistics", None, "std", F.col("width_std")),
                    ("scoring", None, "interval_score", F.col("score")),
                    (
                        "scoring",
                        None,
                        "efficiency_ratio",
                        F.when(normalized > 0, sdiv(F.col("covered"), normalized)),
                    ),
                    ("sample_info", None, "n_valid_samples", F.col("n")),
                    ("sample_info", None, "n_total_samples", F.col("n_total")),
                    ("sample_info", None, "n_nan_removed", F.col("n_total") - F.col("n")),
                ],
            ),
            _cells(
                spread,
                [
                    ("width_statistics", None, "q25", F.get("q", F.lit(0))),
                    ("width_statistics", None, "median", F.get("q", F.lit(1))),
                    ("width_statistics", None, "q75", F.get("q", F.lit(2))),
                ],
            ),
        ]
    )


def calibration_curve(
    df: DataFrame, y: str, lower: str, upper: str, n_bins: int = 10
) -> DataFrame:
    """(bin, mean_width, observed_coverage, n) over quantile bins of the interval width.

    The edges are a handful of numbers and enter the second pass as literals.
    """
    rows = _widths(df, lower, upper, y)
    probs = [i / n_bins for i in range(n_bins + 1)]
    found = exact_quantiles(rows, "width", probs).first()
    if found is None:
        raise ValueError("no valid interval rows")
    edges = list(found.q)
    edges[0] -= 1e-10
    edges[-1] += 1e-10
    place = F.greatest(F.least(A.bin_of(F.col("width"), edges), F.lit(n_bins - 1)), F.lit(0))
    covered = (F.col("_y") >= F.col("_lo")) & (F.col("_y") <= F.col("_hi"))
    return rows.groupBy(place.alias("bin")).agg(
        F.avg("width").alias("mean_width"),
        F.avg(covered.cast("double")).alias("observed_coverage"),
        F.count(F.lit(1)).alias("n"),
    )


def sharpness(df: DataFrame, lower: str, upper: str) -> DataFrame:
    """(metric, value): location and spread of the interval width."""
    rows = _widths(df, lower, upper)
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("width").alias("m"), F.stddev_pop("width").alias("s")
    )
    spread = exact_quantiles(rows, "width", [0.25, 0.5, 0.75, 0.9])
    q = [F.get("q", F.lit(i)) for i in range(4)]
    return union_all(
        [
            E.tidy(
                sums,
                {
                    "mean_width": F.col("m"),
                    "width_std": F.col("s"),
                    "width_cv": F.when(F.col("m") > 0, sdiv(F.col("s"), F.col("m"))),
                    "n_samples": F.col("n"),
                },
            ),
            E.tidy(
                spread,
                {
                    "median_width": q[1],
                    "width_iqr": q[2] - q[0],
                    "width_90th_percentile": q[3],
                },
            ),
        ]
    )


def median_error(df: DataFrame, y: str, yq: str, quantiles) -> DataFrame:
    """One row: MAE, RMSE and bias of the level closest to 0.5."""
    nearest = min(range(len(quantiles)), key=lambda i: abs(quantiles[i] - 0.5))
    err = F.get(F.col(yq), F.lit(nearest)) - F.col(y)
    err = F.when(~F.isnan(err), err)
    return df.agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(err).alias("bias"),
    )


# --- status labels -----------------------------------------------------------------


def coverage_status(error: Column) -> Column:
    size = F.abs(error)
    return F.when(size < 0.05, "good").when(size < 0.1, "fair").otherwise("poor")


def significance_status(p: Column) -> Column:
    return F.when(p > 0.05, "not_significant").otherwise("significant")


def coverage_band(tau: float, n: Column) -> tuple[Column, Column]:
    """95 % band of the observed coverage at level tau, clipped to [0, 1]."""
    half = 1.96 * (tau * (1.0 - tau)) ** 0.5
    return (
        F.greatest(F.lit(tau) - F.lit(half) / F.sqrt(n), F.lit(0.0)),
        F.least(F.lit(tau) + F.lit(half) / F.sqrt(n), F.lit(1.0)),
    )


def top_drifted(drift: DataFrame, n: int = 20) -> DataFrame:
    """The n entities with the largest PSI, missing values last; ties by name."""
    return drift.orderBy(F.desc_nulls_last("psi"), "entity").limit(n)


def run_monitoring(
    reference: DataFrame,
    current: DataFrame,
    *,
    features: list[str],
    target: str,
    yq: str,
    quantiles,
    lower: str = "lower",
    upper: str = "upper",
    confidence_level: float = 0.8,
    time_span: int = 196,
) -> DataFrame:
    """Every drift and performance figure of one run as (section, entity, metric, value, label).

    Both samples carry the features, the target and forecasts (`yq`, `lower`, `upper`).
    """
    shared = [f for f in features if f in reference.columns and f in current.columns]
    if not shared:
        raise ValueError("no feature in both samples")
    no_label = F.lit(None).cast("string").alias("label")
    no_entity = F.lit(None).cast("string").alias("entity")

    def named(rows: DataFrame, section: str, label: Column | None = None) -> DataFrame:
        return rows.select(
            F.lit(section).alias("section"),
            no_entity,
            "metric",
            "value",
            no_label if label is None else label.alias("label"),
        )

    def wide(row: DataFrame, section: str) -> DataFrame:
        return named(E.tidy(row, {c: F.col(c) for c in row.columns}), section)

    features_drift = feature_drift(reference, current, shared)
    predicted = prediction_drift(reference, current, yq, quantiles)
    moved = target_drift(reference, current, target)
    p_value = F.when(F.col("metric").endswith("p_value"), significance_status(F.col("value")))
    performance = performance_report(current, target, yq, quantiles).select(
        "section", "entity", "metric", "value", no_label
    )
    intervals = interval_report(current, target, lower, upper, confidence_level).select(
        F.concat(F.lit("interval_"), F.col("section")).alias("section"),
        "entity",
        "metric",
        "value",
        F.when(
            (F.col("section") == "coverage") & (F.col("metric") == "error"),
            coverage_status(F.col("value")),
        ).alias("label"),
    )
    sizes = union_all(
        [
            wide(reference.agg(F.count(F.lit(1)).alias("reference_data_samples")), "summary"),
            wide(
                current.agg(
                    F.count(F.lit(1)).alias("current_data_samples"),
                    F.lit(len(shared)).alias("total_features_analyzed"),
                    F.lit(time_span).alias("monitoring_time_span_days"),
                ),
                "summary",
            ),
        ]
    )
    return union_all(
        [
            drift_rows(features_drift, "feature_drift"),
            wide(feature_drift_summary(features_drift), "feature_drift"),
            drift_rows(predicted, "prediction_drift"),
            wide(prediction_drift_summary(predicted), "prediction_drift"),
            named(moved, "target_drift", p_value),
            performance,
            intervals,
            sizes,
        ]
    )
