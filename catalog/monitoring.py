"""Drift, performance reports and the rolling trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    MID_DATE,
    P,
    TAUS,
    ctes_forecasts,
    ctes_rets,
    day,
    forecasts,
    panel,
    rd,
    returns,
    sql_rd,
    with_ctes,
)
from catalog.features import CTES_TABLE, rounded, sized, sql_rounded, sql_sized
from catalog.features import TABLE as FEATURE_SPEC
from catalog.modeling import (
    _AE,
    _C,
    _E,
    _MEAN,
    _P,
    MODEL,
    SQL_CRPS,
    SQL_ECE,
    SQL_KEYS,
    sql_eval,
    sql_interval,
    sql_metric_rows,
)
from tidemark.config import GROUPED_FEATURES
from tidemark.operators import drift as D
from tidemark.operators import monitor as M
from tidemark.operators import profile as R
from tidemark.operators.features import build_features
from tidemark.plans.train import train
from tidemark.session import checkpoint

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def halves(df):
    cut = F.lit(MID_DATE).cast("date")
    return df.where(F.col("date") < cut), df.where(F.col("date") >= cut)


# All numeric model features, rounded as the feature table shows them: what is equal there is
# one value in both samples and in both systems.
SQL_LONG = f"""tb AS MATERIALIZED ({sql_rounded("ft", FEATURE_SPEC)}),
lng AS MATERIALIZED (SELECT entity, CAST(value AS DOUBLE) AS v, is_ref FROM (
  SELECT unnest([{", ".join(f"'{c}'" for c in GROUPED_FEATURES)}]) AS entity,
         unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in GROUPED_FEATURES)}]) AS value,
         CAST(date < '{MID_DATE}' AS INTEGER) AS is_ref FROM tb) WHERE value IS NOT NULL)"""

SQL_DRIFT = """sz AS (SELECT entity, CAST(sum(is_ref) AS DOUBLE) AS nr,
       CAST(sum(1 - is_ref) AS DOUBLE) AS nc, min(v) AS mn, max(v) AS mx FROM lng GROUP BY entity),
tal AS (SELECT entity, v, sum(is_ref) AS cr, sum(1 - is_ref) AS cc FROM lng GROUP BY entity, v),
cdf AS (SELECT t.entity, v, sum(cr) OVER w / nr - sum(cc) OVER w / nc AS gap,
       lead(v) OVER w - v AS step FROM tal t JOIN sz ON sz.entity = t.entity
       WINDOW w AS (PARTITION BY t.entity ORDER BY v)),
kw AS (SELECT entity, max(abs(gap)) AS ks, sum(abs(gap) * coalesce(step, 0)) AS w1
       FROM cdf GROUP BY entity),
ed AS (SELECT entity, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e
       FROM lng WHERE is_ref = 1 GROUP BY entity),
bn AS (SELECT l.entity, is_ref, len(list_filter(e, lambda x: x <= v)) AS b,
       least(CAST(floor((v - mn) * 50 / (mx - mn)) AS BIGINT), 49) AS j
       FROM lng l JOIN ed ON ed.entity = l.entity JOIN sz ON sz.entity = l.entity),
pc AS (SELECT s.entity, g.b, nr, nc, count(*) FILTER (WHERE is_ref = 1) AS cr,
       count(*) FILTER (WHERE is_ref = 0) AS cc
       FROM sz s CROSS JOIN range(10) g(b) LEFT JOIN bn ON bn.entity = s.entity AND bn.b = g.b
       GROUP BY s.entity, g.b, nr, nc),
pp AS (SELECT entity, (cr + 1e-6) / (nr + 1e-5) AS p, (cc + 1e-6) / (nc + 1e-5) AS q FROM pc),
psi AS (SELECT entity, sum((q - p) * ln(q / p)) AS psi FROM pp GROUP BY entity),
jc AS (SELECT bn.entity, j, count(*) FILTER (WHERE is_ref = 1) / max(nr) + 1e-10 AS p,
       count(*) FILTER (WHERE is_ref = 0) / max(nc) + 1e-10 AS q
       FROM bn JOIN sz ON sz.entity = bn.entity GROUP BY bn.entity, j),
js AS (SELECT entity, sqrt(sum(p * log2(p / ((p + q) / 2)) + q * log2(q / ((p + q) / 2))) / 2
       / (1 + 50 * 1e-10)) AS js FROM jc GROUP BY entity),
dr AS (SELECT sz.entity, CAST(nr AS BIGINT) AS reference_n, CAST(nc AS BIGINT) AS current_n, ks, w1,
       psi, js, CASE WHEN psi < 0.1 THEN 'no_drift' WHEN psi < 0.2 THEN 'minor_drift'
       ELSE 'major_drift' END AS label,
       CASE WHEN ks * ks * nr * nc / (nr + nc) < 0.04 THEN 1.0 ELSE greatest(least(2 * list_sum(
         list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END
         * exp(-2.0 * k * k * ks * ks * nr * nc / (nr + nc)))), 1.0), 0.0) END AS kp
       FROM sz JOIN kw USING (entity) JOIN psi USING (entity) JOIN js USING (entity))"""

CTES_DRIFT = [*CTES_TABLE, SQL_LONG, SQL_DRIFT]


def feature_drift(spark, sf):
    ref, cur = halves(checkpoint(rounded(build_features(panel(spark, sf), P), FEATURE_SPEC)))
    return D.feature_drift(ref, cur, GROUPED_FEATURES)


@query(
    "drift_ks_w1",
    with_ctes(
        CTES_DRIFT,
        f"""SELECT entity, reference_n, current_n, {sql_rd('ks')} AS ks_statistic,
  {sql_rd('kp')} AS ks_p_value, {sql_sized('w1')} AS wasserstein_distance FROM dr""",
    ),
)
def drift_ks_w1(spark, sf):
    return feature_drift(spark, sf).select(
        "entity",
        "reference_n",
        "current_n",
        *[rd(c).alias(c) for c in ("ks_statistic", "ks_p_value")],
        sized("wasserstein_distance").alias("wasserstein_distance"),
    )


@query(
    "drift_psi",
    with_ctes(CTES_DRIFT, f"SELECT entity, {sql_rd('psi')} AS psi, label AS psi_interpretation FROM dr"),
)
def drift_psi(spark, sf):
    return feature_drift(spark, sf).select("entity", rd("psi").alias("psi"), "psi_interpretation")


@query(
    "drift_profile",
    with_ctes(
        CTES_DRIFT,
        f"""SELECT entity, reference_n, current_n, {sql_rd('psi')} AS psi, label AS psi_interpretation FROM dr""",
    ),
)
def drift_profile(spark, sf):
    """Drift from a stored profile: the reference rows are not read again."""
    ref, cur = halves(checkpoint(rounded(build_features(panel(spark, sf), P), FEATURE_SPEC)))
    profile = checkpoint(R.reference_profile(ref, GROUPED_FEATURES))
    out = R.drift_from_profile(profile, cur)
    return out.select("entity", "reference_n", "current_n", rd("psi").alias("psi"), "psi_interpretation")


@query(
    "drift_js",
    with_ctes(CTES_DRIFT, f"SELECT entity, {sql_rd('js')} AS jensen_shannon_distance FROM dr"),
)
def drift_js(spark, sf):
    return feature_drift(spark, sf).select(
        "entity", rd("jensen_shannon_distance").alias("jensen_shannon_distance")
    )


@query(
    "drift_features",
    with_ctes(
        CTES_DRIFT,
        f"""SELECT {sql_rd('avg(psi)')} AS mean_psi, {sql_rd('max(psi)')} AS max_psi,
  {sql_rd('avg(CAST(psi > 0.2 AS DOUBLE))')} AS fraction_drifted_features_psi,
  {sql_sized('avg(w1)')} AS mean_wasserstein,
  {sql_rd('avg(CAST(kp < 0.05 AS DOUBLE))')} AS fraction_significant_ks,
  count(*) AS n_features_analyzed FROM dr""",
    ),
)
def drift_features(spark, sf):
    s = D.feature_drift_summary(feature_drift(spark, sf))
    others = [c for c in s.columns if c not in ("n_features_analyzed", "mean_wasserstein")]
    return s.select(
        *[rd(c).alias(c) for c in others],
        sized("mean_wasserstein").alias("mean_wasserstein"),
        "n_features_analyzed",
    )


@query(
    "top_drifted",
    with_ctes(CTES_DRIFT, f"SELECT entity, {sql_rd('psi')} AS psi FROM dr ORDER BY psi DESC, entity LIMIT 20"),
)
def top_drifted(spark, sf):
    return M.top_drifted(feature_drift(spark, sf)).select("entity", rd("psi").alias("psi"))


SQL_PRED_LONG = """lng AS (SELECT entity, v, is_ref FROM (
  SELECT unnest(['q_0.10', 'q_0.25', 'q_0.50', 'q_0.75', 'q_0.90']) AS entity, unnest(q) AS v,
         CAST(split = 'cal' AS INTEGER) AS is_ref FROM fc))"""


@query(
    "drift_predictions",
    with_ctes(
        [*ctes_forecasts(), SQL_PRED_LONG, SQL_DRIFT],
        f"""SELECT entity, {sql_rd('ks')} AS ks_statistic, {sql_rd('psi', 5)} AS psi,
  {sql_rd('w1', 8)} AS wasserstein_distance FROM dr""",
    ),
)
def drift_predictions(spark, sf):
    rows = checkpoint(forecasts(spark, sf))
    out = D.prediction_drift(rows.where("split = 'cal'"), rows.where("split = 'test'"), "yq", TAUS)
    return out.select(
        "entity",
        rd("ks_statistic").alias("ks_statistic"),
        rd("psi", 5).alias("psi"),
        rd("wasserstein_distance", 8).alias("wasserstein_distance"),
    )


SQL_TARGET = f"""lng AS (SELECT 'y' AS entity, y AS v, CAST(date < DATE '{MID_DATE}' AS INTEGER) AS is_ref
       FROM rets WHERE y IS NOT NULL)"""
SQL_TARGET_STATS = """mo AS (SELECT is_ref, CAST(count(*) AS DOUBLE) AS n, avg(v) AS m,
       stddev_pop(v) AS s, var_samp(v) AS vs, kurtosis_pop(v) AS k,
       (avg(v * v * v) - 3 * avg(v) * avg(v * v) + 2 * pow(avg(v), 3)) / pow(stddev_pop(v), 3) AS sk,
       median(v) AS med FROM lng GROUP BY is_ref),
zz AS (SELECT l.is_ref, abs(v - med) AS z FROM lng l JOIN mo ON mo.is_ref = l.is_ref),
zs AS (SELECT is_ref, count(*) AS n, avg(z) AS zm, var_pop(z) * count(*) AS ss FROM zz GROUP BY is_ref),
zg AS (SELECT avg(z) AS g FROM zz),
lev AS (SELECT (sum(n) - 2) * sum(n * pow(zm - g, 2)) / sum(ss) AS w FROM zs, zg),
a AS (SELECT * FROM mo WHERE is_ref = 1), c AS (SELECT * FROM mo WHERE is_ref = 0),
tg AS (SELECT dr.ks, dr.kp, dr.psi, dr.w1, dr.js, a.n AS an, c.n AS cn, a.m AS am, c.m AS cm,
       a.s AS as_, c.s AS cs, a.sk AS ask, c.sk AS csk, a.k AS ak, c.k AS ck,
       (a.m - c.m) / sqrt(a.vs / a.n + c.vs / c.n) AS t, w,
       pow(a.vs / a.n + c.vs / c.n, 2) / (pow(a.vs / a.n, 2) / (a.n - 1) + pow(c.vs / c.n, 2) / (c.n - 1))
         AS dof FROM dr, a, c, lev)"""


def _sql_student_p(x: str, dof: str) -> str:
    """Two-sided tail of Student's law: one less twice the density's integral, by Simpson's rule."""
    n = 4000
    weight = f"CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = (
        f"list_sum(list_transform(range({n + 1}), lambda i: ({weight}) * "
        f"pow(1 + pow(i * abs({x}) / {n}, 2) / ({dof}), -(({dof}) + 1) / 2)))"
    )
    norm = f"exp(lgamma((({dof}) + 1) / 2) - lgamma(({dof}) / 2)) / sqrt(pi() * ({dof}))"
    return f"1 - 2 * {norm} * {area} * abs({x}) / {3 * n}"


SQL_TARGET_METRICS = {
    "ks_statistic": "ks",
    "ks_p_value": "kp",
    "psi": "psi",
    "wasserstein_distance": "w1",
    "jensen_shannon_distance": "js",
    "ref_mean": "am",
    "curr_mean": "cm",
    "mean_shift": "cm - am",
    "ref_std": "as_",
    "curr_std": "cs",
    "std_ratio": "cs / as_",
    "ref_skewness": "ask",
    "curr_skewness": "csk",
    "skewness_shift": "csk - ask",
    "ref_kurtosis": "ak",
    "curr_kurtosis": "ck",
    "kurtosis_shift": "ck - ak",
    "mean_diff_t_stat": "t",
    "mean_diff_p_value": _sql_student_p("t", "dof"),
    "variance_levene_stat": "w",
    # an F test with one degree of freedom above is Student's on the root
    "variance_levene_p_value": _sql_student_p("sqrt(w)", "an + cn - 2"),
    "reference_n": "an",
    "current_n": "cn",
}


@query(
    "drift_target",
    with_ctes(
        [*ctes_rets(), SQL_TARGET, SQL_DRIFT, SQL_TARGET_STATS],
        sql_metric_rows(SQL_TARGET_METRICS, "tg"),
    ),
)
def drift_target(spark, sf):
    ref, cur = halves(checkpoint(returns(spark, sf).select("date", "y_log_returns")))
    return D.target_drift(ref, cur, "y_log_returns").select("metric", rd("value").alias("value"))


# --- performance -------------------------------------------------------------------------------

SQL_TEST = "src AS (SELECT * FROM fc WHERE split = 'test')"
_REPORT = {
    **{("pinball_losses", f"q_{t:.2f}", "loss"): p for t, p in zip(TAUS, _P)},
    **{("coverage", f"q_{t:.2f}", "coverage"): c for t, c in zip(TAUS, _C)},
    **{("coverage", f"q_{t:.2f}", "error"): e for t, e in zip(TAUS, _E)},
    ("pinball_losses", None, "mean"): _MEAN(_P),
    ("pinball_losses", None, "median"): f"list_sort([{', '.join(_P)}])[3]",
    ("pinball_losses", None, "max"): f"greatest({', '.join(_P)})",
    ("coverage", None, "mean_absolute_error"): _MEAN(_AE),
    ("coverage", None, "max_absolute_error"): f"greatest({', '.join(_AE)})",
    ("coverage", None, "bias"): _MEAN(_E),
    ("calibration", None, "pit_ks_statistic"): "d",
    ("calibration", None, "pit_ece"): SQL_ECE,
    ("distributional", None, "crps"): SQL_CRPS,
    ("monotonicity", None, "violation_rate"): "xr",
    ("monotonicity", None, "violation_count"): "xr * n",
    ("sample_info", None, "n_valid_samples"): "n",
    ("sample_info", None, "n_total_samples"): "n",
    ("sample_info", None, "n_nan_removed"): "0",
}


def _report_sql(cells, src):
    text = lambda e: "CAST(NULL AS VARCHAR)" if e is None else f"'{e}'"
    return "\nUNION ALL ".join(
        f"SELECT '{s}' AS section, {text(e)} AS entity, '{m}' AS metric, {sql_rd(x)} AS value FROM {src}"
        for (s, e, m), x in cells.items()
    )


@query(
    "performance_report",
    with_ctes([*ctes_forecasts(), SQL_TEST, *sql_eval("src")], _report_sql(_REPORT, "ev, ks")),
)
def performance_report(spark, sf):
    test = checkpoint(forecasts(spark, sf).where("split = 'test'"))
    out = M.performance_report(test, "y_log_returns", "yq", TAUS)
    return out.select("section", "entity", "metric", rd("value").alias("value"))


_ROLL_LOSS = [f"avg(greatest({t} * (y - q{i}), ({t} - 1) * (y - q{i}))) OVER w AS p{i - 1}"
              for i, t in enumerate(TAUS, 1)]
_ROLL_COV = [f"avg(CAST(y <= q{i} AS DOUBLE)) OVER w AS c{i - 1}" for i in range(1, 6)]


@query(
    "performance_trend",
    with_ctes(
        [*ctes_forecasts(),
         f"""tr AS (SELECT symbol, date, row_number() OVER (ORDER BY date, symbol) AS i,
       {', '.join(_ROLL_LOSS + _ROLL_COV)} FROM fc
       WINDOW w AS (ORDER BY date, symbol ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""],
        f"""SELECT {SQL_KEYS}, {sql_rd(_MEAN(_P), 8)} AS mean_pinball_loss,
  {sql_rd(_MEAN(_AE), 8)} AS mean_coverage_error, {sql_rd(SQL_CRPS, 8)} AS crps FROM tr WHERE i >= 30""",
    ),
)
def performance_trend(spark, sf):
    out = M.performance_trend(forecasts(spark, sf), "y_log_returns", "yq", TAUS)
    cols = ["mean_pinball_loss", "mean_coverage_error", "crps"]
    return out.select("symbol", day(), *[rd(c, 8).alias(c) for c in cols])


# --- intervals -----------------------------------------------------------------------------------

SQL_OUTER = "ov AS (SELECT *, q1 AS lo, q5 AS hi, q5 - q1 AS width FROM fc)"


def outer(spark, sf):
    """Cal and test rows with the interval between the outer forecast levels."""
    rows = forecasts(spark, sf).withColumns(
        {"lower": F.get("yq", F.lit(0)), "upper": F.get("yq", F.lit(4))}
    )
    return checkpoint(rows)


_INTERVAL = {
    ("coverage", None, "observed"): "cov",
    ("coverage", None, "target"): "0.8",
    ("coverage", None, "error"): "cov - CAST(0.8 AS DOUBLE)",
    ("coverage", None, "below_lower_rate"): "below",
    ("coverage", None, "above_upper_rate"): "above",
    ("interval_width", None, "mean_width"): "width",
    ("interval_width", None, "normalized_width"): "width / ystd",
    ("width_statistics", None, "min"): "wmin",
    ("width_statistics", None, "max"): "wmax",
    ("width_statistics", None, "mean"): "width",
    ("width_statistics", None, "std"): "wstd",
    ("width_statistics", None, "q25"): "wq[1]",
    ("width_statistics", None, "median"): "wq[2]",
    ("width_statistics", None, "q75"): "wq[3]",
    ("scoring", None, "interval_score"): "score",
    ("scoring", None, "efficiency_ratio"): "cov / (width / ystd)",
    ("sample_info", None, "n_valid_samples"): "n",
    ("sample_info", None, "n_total_samples"): "n",
    ("sample_info", None, "n_nan_removed"): "0",
}


@query(
    "interval_report",
    with_ctes(
        [*ctes_forecasts(), SQL_OUTER, sql_interval("ov"),
         "wd AS (SELECT quantile_cont(width, [0.25, 0.5, 0.75]) AS wq FROM ov)"],
        "SELECT section, metric, value FROM (" + _report_sql(_INTERVAL, "it, wd") + ")",
    ),
)
def interval_report(spark, sf):
    out = M.interval_report(outer(spark, sf), "y_log_returns", "lower", "upper", 0.8)
    return out.select("section", "metric", rd("value").alias("value"))


@query(
    "calibration_curve",
    with_ctes(
        [*ctes_forecasts(), SQL_OUTER,
         "we AS (SELECT quantile_cont(width, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])"
         " AS e FROM ov)",
         """wb AS (SELECT ov.*, greatest(least(len(list_filter(list_concat(list_concat([e[1] - 1e-10],
         e[2:10]), [e[11] + 1e-10]), lambda x: x <= width)) - 1, 9), 0) AS bin FROM ov, we)"""],
        f"""SELECT CAST(bin AS INTEGER) AS bin, {sql_rd('avg(width)', 8)} AS mean_width,
  {sql_rd('avg(CAST(y BETWEEN lo AND hi AS DOUBLE))')} AS observed_coverage, count(*) AS n
FROM wb GROUP BY bin""",
    ),
)
def calibration_curve(spark, sf):
    out = M.calibration_curve(outer(spark, sf), "y_log_returns", "lower", "upper")
    return out.select(
        "bin",
        rd("mean_width", 8).alias("mean_width"),
        rd("observed_coverage").alias("observed_coverage"),
        "n",
    )


@query(
    "sharpness",
    with_ctes(
        [*ctes_forecasts(), SQL_OUTER,
         """sh AS (SELECT avg(width) AS m, stddev_pop(width) AS s, count(*) AS n,
       quantile_cont(width, [0.25, 0.5, 0.75, 0.9]) AS q FROM ov)"""],
        sql_metric_rows(
            {
                "mean_width": "m",
                "width_std": "s",
                "width_cv": "s / m",
                "n_samples": "n",
                "median_width": "q[2]",
                "width_iqr": "q[3] - q[1]",
                "width_90th_percentile": "q[4]",
            },
            "sh",
        ),
    ),
)
def sharpness(spark, sf):
    return M.sharpness(outer(spark, sf), "lower", "upper").select("metric", rd("value").alias("value"))


@query(
    "median_error",
    with_ctes(
        ctes_forecasts(),
        f"""SELECT {sql_rd('avg(abs(q3 - y))', 8)} AS mae, {sql_rd('sqrt(avg((q3 - y) * (q3 - y)))', 8)} AS rmse,
  {sql_rd('avg(q3 - y)', 8)} AS bias FROM fc""",
    ),
)
def median_error(spark, sf):
    out = M.median_error(forecasts(spark, sf), "y_log_returns", "yq", TAUS)
    return out.select(*[rd(c, 8).alias(c) for c in ("mae", "rmse", "bias")])


@query(
    "metric_status",
    with_ctes(
        [*ctes_forecasts(), SQL_TEST, *sql_eval("src")],
        "\nUNION ALL ".join(
            f"""SELECT 'q_{t:.2f}' AS entity, CASE WHEN abs(c{i} - {t}) < 0.05 THEN 'good'
  WHEN abs(c{i} - {t}) < 0.1 THEN 'fair' ELSE 'poor' END AS status,
  {sql_rd(f'greatest({t} - 1.96 * sqrt({t} * (1 - {t}) / n), 0)')} AS band_low,
  {sql_rd(f'least({t} + 1.96 * sqrt({t} * (1 - {t}) / n), 1)')} AS band_high FROM ev"""
            for i, t in enumerate(TAUS)
        ),
    ),
)
def metric_status(spark, sf):
    """Coverage status and band per level."""
    test = forecasts(spark, sf).where("split = 'test'")
    rows = [
        F.struct(
            F.lit(f"q_{t:.2f}").alias("entity"),
            M.coverage_status(F.col(f"c{i}") - t).alias("status"),
            rd(M.coverage_band(t, F.col("n"))[0]).alias("band_low"),
            rd(M.coverage_band(t, F.col("n"))[1]).alias("band_high"),
        )
        for i, t in enumerate(TAUS)
    ]
    sums = test.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.avg((F.col("y_log_returns") <= F.get("yq", F.lit(i))).cast("double")).alias(f"c{i}")
            for i in range(5)
        ],
    )
    return sums.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


@query("monitoring_run")
def monitoring_run(spark, sf):
    """The whole monitoring run on a trained model: test split against the last 196 days."""
    from tidemark.sources.tables import last_labelled_days

    feats = checkpoint(build_features(panel(spark, sf), P))
    trained = train(feats, MODEL)
    ref = checkpoint(trained.score(trained.sets.where("split = 'test'")))
    cur = checkpoint(trained.score(last_labelled_days(feats, 196)))
    return M.run_monitoring(
        ref, cur, features=GROUPED_FEATURES, target="y_log_returns", yq="yq", quantiles=TAUS
    )


