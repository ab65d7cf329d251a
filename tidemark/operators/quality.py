"""Per-symbol data quality checks, all in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import PRICE_COLUMNS, QualityRules
from tidemark.functions.scalars import sdiv
from tidemark.functions.windows import PanelWindow

# Check names in the order they are reported.
CHECKS = [
    "required_columns",
    "price_positivity",
    "high_low_consistency",
    "volume_non_negative",
    "ohlc_relationships",
    "extreme_price_movements",
    "min_data_points",
]


def quality_counts(panel: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Violation counts and warning texts per symbol.

    Expects one row per (symbol, date) (see `timeline.densify`), so a symbol
    never holds more rows than calendar days. The previous known close and
    the counts share one exchange by symbol.
    """
    tol = rules.price_tolerance
    before = PanelWindow().spec.rowsBetween(Window.unboundedPreceding, -1)
    panel = panel.withColumn("_prev", F.last("close", ignorenulls=True).over(before))
    change = sdiv(F.col("close"), F.col("_prev")) - 1.0
    extreme = F.abs(change) > rules.max_daily_price_change_ratio
    text = F.format_string(
        "Extreme price movement on %s: %.1f%% change", F.col("date").cast("string"), change * 100.0
    )
    outside = lambda c: (
        (F.col(c) > F.col("high") + tol) | (F.col(c) < F.col("low") - tol)
    ) & F.col("high").isNotNull() & F.col("low").isNotNull()
    positives = [F.count_if(F.col(c) <= 0) for c in PRICE_COLUMNS]
    present = [F.count(c) > 0 for c in [*PRICE_COLUMNS, "volume"]]
    return (
        panel.groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("total_rows_checked"),
            (present[0] & present[1] & present[2] & present[3] & present[4]).alias("_present"),
            (positives[0] + positives[1] + positives[2] + positives[3]).alias("n_price_positivity"),
            F.count_if(F.col("high") < F.col("low") - tol).alias("n_high_low_consistency"),
            F.count_if(F.col("volume") < 0).alias("n_volume_non_negative"),
            (F.count_if(outside("open")) + F.count_if(outside("close"))).alias(
                "n_ohlc_relationships"
            ),
            F.count_if(extreme).alias("n_extreme_price_movements"),
            F.sort_array(F.collect_list(F.when(extreme, F.struct("date", text.alias("text"))))).alias(
                "_warnings"
            ),
        )
        .withColumn("_warnings", F.col("_warnings.text"))
    )


def quality_report(panel: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One result row per symbol.

    When a required column is entirely null the other checks are not reported.
    """
    counts = quality_counts(panel, rules)
    on = {
        "price_positivity": rules.price_positivity,
        "high_low_consistency": rules.high_low_consistency,
        "volume_non_negative": rules.volume_non_negative,
        "ohlc_relationships": rules.ohlc_relationships,
        "extreme_price_movements": rules.extreme_price_movements,
    }
    usable = F.col("_present") if rules.required_columns else F.lit(True)
    active = [c for c, enabled in on.items() if enabled]
    enough = F.col("total_rows_checked") >= rules.min_required_data_points
    failed = [F.when(usable & (F.col(f"n_{c}") > 0), F.lit(c)) for c in active]
    failed.append(F.when(usable & ~enough, F.lit("min_data_points")))
    entry = lambda name, ok: F.struct(F.lit(name).alias("check"), ok.alias("passed"))
    details = [F.when(usable, entry(c, F.col(f"n_{c}") == 0)) for c in active]
    details.append(F.when(usable, entry("min_data_points", enough)))
    if rules.required_columns:
        failed.insert(0, F.when(~usable, F.lit("required_columns")))
        details.insert(0, entry("required_columns", F.col("_present")))
    issues = F.lit(0).cast("long")
    for c in active:
        issues = issues + F.col(f"n_{c}")
    warnings = F.col("_warnings") if rules.extreme_price_movements else F.array().cast("array<string>")
    report = counts.select(
        "symbol",
        F.array_compact(F.array(*failed)).alias("failed_checks"),
        F.when(usable, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"),
        "total_rows_checked",
        F.when(usable, issues).otherwise(F.lit(0)).cast("long").alias("rows_with_issues"),
        F.map_from_entries(F.array_compact(F.array(*details))).alias("validation_details"),
    )
    return report.withColumn("is_valid", F.size("failed_checks") == 0)


def quality_gate(panel: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Keep only symbols without a failed check; with on_failure='warn' keep all, flagged."""
    verdict = quality_report(panel, rules).select("symbol", "is_valid")
    if rules.on_failure == "warn":
        return panel.join(verdict, "symbol", "left")
    return panel.join(verdict.where("is_valid"), "symbol", "left_semi")


def quality_summary(report: DataFrame) -> DataFrame:
    """Human-readable text per symbol: header, counts, at most three warnings."""
    n = F.size("warnings")
    shown = F.transform(F.slice("warnings", 1, 3), lambda t: F.concat(F.lit("    - "), t))
    lines = [
        F.concat(F.lit("Data Quality Validation for "), F.col("symbol"), F.lit(":")),
        F.concat(F.lit("  Status: "), F.when(F.col("is_valid"), "PASSED").otherwise("FAILED")),
        F.concat(F.lit("  Rows checked: "), F.col("total_rows_checked").cast("string")),
        F.concat(F.lit("  Rows with issues: "), F.col("rows_with_issues").cast("string")),
        F.when(
            F.size("failed_checks") > 0,
            F.concat(F.lit("  Failed checks: "), F.concat_ws(", ", "failed_checks")),
        ),
        F.when(n > 0, F.concat(F.lit("  Warnings: "), n.cast("string"))),
        F.when(n > 0, F.concat_ws("\n", shown)),
        F.when(
            n > 3, F.concat(F.lit("    ... and "), (n - 3).cast("string"), F.lit(" more warnings"))
        ),
    ]
    return report.select("symbol", F.concat_ws("\n", *lines).alias("summary"))
