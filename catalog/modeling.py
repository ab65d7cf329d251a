"""Splits, baseline, calibration, evaluation, models and scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import (
    FRACTIONS,
    SQL_SPLIT,
    TAUS,
    ctes_forecasts,
    ctes_rets,
    day,
    forecasts,
    panel,
    rd,
    returns,
    split_returns,
    sql_forecasts,
    sql_rd,
    with_ctes,
)
from tidemark.config import BoostParams, ModelParams
from tidemark.functions import arrays as A
from tidemark.operators import calibrate as C
from tidemark.operators import evaluate as E
from tidemark.operators import models as M
from tidemark.operators import score as S
from tidemark.operators import splits as L
from tidemark.operators.boosting import BoostedQuantiles
from tidemark.operators.features import build_features
from tidemark.operators.transforms import GroupedPca, ordered_means
from tidemark.plans import train as TR
from tidemark.session import checkpoint

QUERIES, SQL = {}, {}
Q5 = ["q1", "q2", "q3", "q4", "q5"]


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def levels(df, yq="yq"):
    """The quantile array as five rounded columns."""
    return df.select(
        "symbol", day(), *[rd(F.get(F.col(yq), F.lit(i)), 8).alias(q) for i, q in enumerate(Q5)]
    )


SQL_LEVELS = ", ".join(f"{sql_rd(q, 8)} AS {q}" for q in Q5)
SQL_KEYS = "symbol, CAST(date AS VARCHAR) AS date"

# --- splits ------------------------------------------------------------------------------


@query("holdout_split", with_ctes([*ctes_rets(), SQL_SPLIT], f"SELECT {SQL_KEYS}, split FROM splits"))
def holdout_split(spark, sf):
    return split_returns(spark, sf).select("symbol", day(), "split")


SQL_FOLDS = """d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
       FROM (SELECT DISTINCT date FROM rets)),
folds AS (SELECT f, max(CASE WHEN i = CAST(floor(f * (CAST(n AS DOUBLE) / 5)) AS BIGINT) THEN date END)
            AS w0,
       max(CASE WHEN i = CASE WHEN f = 4 THEN n ELSE CAST(floor((f + 1) * (CAST(n AS DOUBLE) / 5))
           AS BIGINT) END - 1 THEN date END) AS w1
       FROM d, range(5) t(f) GROUP BY f),
roles AS (SELECT f, r.symbol, r.date, CASE WHEN r.date BETWEEN w0 AND w1 THEN 'test'
       WHEN r.date <= w0 - 10 THEN 'train' END AS role FROM rets r, folds),
big AS (SELECT f FROM roles GROUP BY f
       HAVING count(*) FILTER (WHERE role = 'train') >= 0.05 * count(*))"""


@query(
    "purged_cv",
    with_ctes(
        [*ctes_rets(), SQL_FOLDS],
        """SELECT CAST(f AS INTEGER) AS fold, role, count(*) AS n, CAST(min(date) AS VARCHAR) AS first_date,
  CAST(max(date) AS VARCHAR) AS last_date FROM roles WHERE role IS NOT NULL
  AND f IN (SELECT f FROM big) GROUP BY f, role""",
    ),
)
def purged_cv(spark, sf):
    folds = L.purged_folds(returns(spark, sf).select("symbol", "date"), 5)
    return folds.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("date").cast("string").alias("first_date"),
        F.max("date").cast("string").alias("last_date"),
    )


# --- baseline ----------------------------------------------------------------------------


@query("quantile_baseline", with_ctes(ctes_forecasts(), f"SELECT {SQL_KEYS}, {SQL_LEVELS} FROM fc"))
def quantile_baseline(spark, sf):
    return levels(forecasts(spark, sf))


@query(
    "quantile_baseline_global",
    with_ctes(ctes_forecasts(None), f"SELECT {SQL_KEYS}, {SQL_LEVELS} FROM fc"),
)
def quantile_baseline_global(spark, sf):
    return levels(forecasts(spark, sf, None))


@query(
    "baseline_r2",
    with_ctes(
        ctes_forecasts(),
        f"""SELECT {sql_rd("1 - sum((y - q3) * (y - q3)) / (var_pop(y) * count(*))")} AS r2
FROM fc WHERE split = 'test'""",
    ),
)
def baseline_r2(spark, sf):
    test = forecasts(spark, sf).where("split = 'test'")
    return M.r2_score(test, "y_log_returns", M.median_of("yq", 5)).select(rd("r2").alias("r2"))


# --- calibration -------------------------------------------------------------------------------

SQL_RADIUS = """sc AS (SELECT abs(y - q3) AS s, row_number() OVER (ORDER BY abs(y - q3)) AS k,
       count(*) OVER () AS n FROM fc WHERE split = 'cal'),
rad AS (SELECT max(s) AS rad FROM sc WHERE k = least(greatest(CAST(ceil((n + 1) *
       (1 - CAST(0.2 AS DOUBLE))) AS BIGINT), 1), n)),
iv AS (SELECT symbol, date, y, q1, q2, q3, q4, q5, q3 - rad AS lo, q3 + rad AS hi
       FROM fc, rad WHERE split = 'test')"""


def calibrated(spark, sf):
    """Test rows with the conformal interval around the baseline median."""
    rows = checkpoint(forecasts(spark, sf).withColumn("median", M.median_of("yq", 5)))
    fitted = C.ConformalInterval(alpha=0.2).fit(
        rows.where("split = 'cal'"), "y_log_returns", "median"
    )
    return fitted.transform(rows.where("split = 'test'"), "median")


@query(
    "conformal_interval",
    with_ctes(
        [*ctes_forecasts(), SQL_RADIUS],
        f"SELECT {SQL_KEYS}, {sql_rd('lo', 8)} AS lower, {sql_rd('hi', 8)} AS upper FROM iv",
    ),
)
def conformal_interval(spark, sf):
    return calibrated(spark, sf).select(
        "symbol", day(), rd("lower", 8).alias("lower"), rd("upper", 8).alias("upper")
    )


SQL_NORMAL_RADIUS = """nsc AS (SELECT abs(y - q3) / greatest(abs(r), 1e-8) AS s FROM fc
       WHERE split = 'cal' AND r IS NOT NULL),
nrk AS (SELECT s, row_number() OVER (ORDER BY s) AS k, count(*) OVER () AS n FROM nsc),
nrad AS (SELECT max(s) AS rad FROM nrk WHERE k = least(greatest(CAST(ceil((n + 1) *
       (1 - CAST(0.4 AS DOUBLE))) AS BIGINT), 1), n))"""


@query(
    "conformal_normalized",
    with_ctes(
        [*ctes_forecasts(), SQL_NORMAL_RADIUS],
        f"""SELECT {SQL_KEYS}, {sql_rd('q3 - rad * abs(r)')} AS lower,
  {sql_rd('q3 + rad * abs(r)')} AS upper FROM fc, nrad WHERE split = 'test'""",
    ),
)
def conformal_normalized(spark, sf):
    rows = forecasts(spark, sf).withColumn("median", M.median_of("yq", 5))
    rows = checkpoint(rows.withColumn("spread", F.abs("log_returns_d")))
    fitted = C.ConformalInterval(alpha=0.4, method="normalized").fit(
        rows.where("split = 'cal'"), "y_log_returns", "median", "spread"
    )
    out = fitted.transform(rows.where("split = 'test'"), "median", "spread")
    return out.select("symbol", day(), rd("lower").alias("lower"), rd("upper").alias("upper"))


def _sql_shift(i):
    q, t = Q5[i], TAUS[i]
    return f"""(SELECT max(e) FROM (SELECT y - {q} AS e, row_number() OVER (ORDER BY y - {q}) AS k,
    count(*) OVER () AS n FROM fc WHERE split = 'cal')
    WHERE k = least(greatest(CAST(ceil((n + 1) * CAST({t} AS DOUBLE)) AS BIGINT), 1), n)) AS h{i + 1}"""


_RUNMAX = [
    "greatest(" + ", ".join(f"q{j} + h{j}" for j in range(1, i + 1)) + ")" for i in range(2, 6)
]
SQL_SHIFTED = (
    "sh AS (SELECT "
    + ", ".join(_sql_shift(i) for i in range(5))
    + "),\ncq AS (SELECT symbol, date, y, q1 + h1 AS q1, "
    + ", ".join(f"{e} AS q{i}" for i, e in enumerate(_RUNMAX, 2))
    + " FROM fc, sh WHERE split = 'test')"
)


@query(
    "conformal_quantiles",
    with_ctes([*ctes_forecasts(), SQL_SHIFTED], f"SELECT {SQL_KEYS}, {SQL_LEVELS} FROM cq"),
)
def conformal_quantiles(spark, sf):
    rows = checkpoint(forecasts(spark, sf))
    fitted = C.ConformalQuantiles(TAUS).fit(rows.where("split = 'cal'"), "y_log_returns", "yq")
    return levels(fitted.transform(rows.where("split = 'test'"), "yq", "fixed"), "fixed")


@query(
    "conformal_quantile_interval",
    with_ctes(
        [*ctes_forecasts(), SQL_SHIFTED],
        f"""SELECT {SQL_KEYS}, {sql_rd('q1 + (q2 - q1) * (0.05 / 0.15)', 8)} AS lower,
  {sql_rd('q4 + (q5 - q4) * (0.1 / 0.15)', 8)} AS upper FROM cq""",
    ),
)
def conformal_quantile_interval(spark, sf):
    rows = checkpoint(forecasts(spark, sf))
    fitted = C.ConformalQuantiles(TAUS).fit(rows.where("split = 'cal'"), "y_log_returns", "yq")
    out = fitted.interval(rows.where("split = 'test'"), "yq", 0.3)
    return out.select("symbol", day(), rd("lower", 8).alias("lower"), rd("upper", 8).alias("upper"))


def crossing(spark, sf):
    """Five columns that cross often: returns at several lags are not ordered."""
    r = returns(spark, sf).where("y_log_returns is not null and log_returns_ratio is not null")
    cells = ["log_returns_d", "y_log_returns", "log_returns_ratio"]
    arr = F.array(*[F.col(c) for c in cells], F.lit(0.0), F.col("log_returns_d") * 2)
    return r.select("symbol", "date", F.col("y_log_returns").alias("y"), arr.alias("yq"))


SQL_CROSSING = """cr AS (SELECT symbol, date, y, r AS q1, y AS q2, rr AS q3, 0.0 AS q4, r * 2 AS q5
       FROM rets WHERE y IS NOT NULL AND rr IS NOT NULL)"""
_FIX = ["greatest(" + ", ".join(Q5[:i]) + ")" for i in range(2, 6)]


@query(
    "monotone_repair",
    with_ctes(
        [*ctes_rets(), SQL_CROSSING],
        f"""SELECT {SQL_KEYS}, {sql_rd('q1', 8)} AS q1, """
        + ", ".join(f"{sql_rd(e, 8)} AS q{i}" for i, e in enumerate(_FIX, 2))
        + """, CAST(q2 < q1 OR q3 < q2 OR q4 < q3 OR q5 < q4 AS INTEGER) AS crossed FROM cr""",
    ),
)
def monotone_repair(spark, sf):
    df = crossing(spark, sf).withColumn("fixed", A.monotone("yq", 5))
    fixed = [rd(F.get("fixed", F.lit(i)), 8).alias(q) for i, q in enumerate(Q5)]
    return df.select("symbol", day(), *fixed, A.crosses("yq", 5).cast("int").alias("crossed"))


@query(
    "interval_from_quantiles",
    with_ctes(
        [*ctes_rets(), SQL_CROSSING, "fx AS (SELECT symbol, date, q1, q5, "
         + ", ".join(f"{e} AS m{i}" for i, e in enumerate(_FIX, 2)) + " FROM cr)"],
        f"""SELECT {SQL_KEYS}, {sql_rd('q1', 8)} AS exact_lower, {sql_rd('q5', 8)} AS exact_upper,
  {sql_rd('q1 + (m2 - q1) * (0.05 / 0.15)', 8)} AS lower,
  {sql_rd('m4 + (m5 - m4) * (0.1 / 0.15)', 8)} AS upper FROM fx""",
    ),
)
def interval_from_quantiles(spark, sf):
    exact = C.interval_from_quantiles(crossing(spark, sf), "yq", TAUS, 0.2)
    exact = exact.withColumnsRenamed({"lower": "exact_lower", "upper": "exact_upper"})
    out = C.interval_from_quantiles(exact, "yq", TAUS, 0.3)
    cols = ["exact_lower", "exact_upper", "lower", "upper"]
    return out.select("symbol", day(), *[rd(c, 8).alias(c) for c in cols])


# --- evaluation ---------------------------------------------------------------------------------


def sql_pit(src, y="y"):
    """PIT of y in non-decreasing q1..q5."""
    blend = ""
    for i in range(4, 0, -1):
        a, b = TAUS[i - 1], TAUS[i]
        blend += f" WHEN {y} >= q{i} THEN {a} + ({b} - {a}) * ({y} - q{i}) / (q{i + 1} - q{i})"
    return f"""pit AS (SELECT *, CAST(CASE WHEN {y} < q1 THEN 0.0 WHEN {y} > q5 THEN 1.0
       WHEN {y} = q5 THEN 0.9{blend} END AS DOUBLE) AS u FROM {src})"""


def sql_eval(src):
    """One wide row `ev` of all quantile metrics of `src`."""
    loss = [f"avg(greatest({t} * (y - {q}), ({t} - 1) * (y - {q}))) AS p{i}"
            for i, (q, t) in enumerate(zip(Q5, TAUS))]
    cov = [f"avg(CAST(y <= {q} AS DOUBLE)) AS c{i}" for i, q in enumerate(Q5)]
    bins = [f"avg(CAST(b = {b} AS DOUBLE)) AS b{b}" for b in range(20)]
    edges = "least(CAST(floor(u * 20 + 1e-9) AS INTEGER), 19)"
    return [
        sql_pit(src),
        f"pb AS (SELECT *, {edges} AS b FROM pit)",
        f"""ev AS (SELECT count(*) AS n, {', '.join(loss + cov + bins)}, avg(u) AS pm,
       stddev_pop(u) AS ps, avg(CAST(q2 < q1 OR q3 < q2 OR q4 < q3 OR q5 < q4 AS DOUBLE)) AS xr
       FROM pb)""",
        """kr AS (SELECT u, row_number() OVER (ORDER BY u) AS i, count(*) OVER () AS n FROM pit),
ks AS (SELECT max(greatest(CAST(i AS DOUBLE) / n - u, u - CAST(i - 1 AS DOUBLE) / n)) AS d FROM kr)""",
    ]


_P = [f"p{i}" for i in range(5)]
_C = [f"c{i}" for i in range(5)]
_E = [f"({c} - {t})" for c, t in zip(_C, TAUS)]
_AE = [f"abs({e})" for e in _E]
_MEAN = lambda xs: "(" + " + ".join(xs) + f") / {len(xs)}"
SQL_CRPS = "2 * (" + " + ".join(
    f"(p{i} + p{i + 1}) * ({TAUS[i + 1]} - {TAUS[i]}) / 2" for i in range(4)
) + ")"
SQL_ECE = _MEAN([f"abs(b{b} - 0.05)" for b in range(20)])
SQL_METRICS = {
    "n_samples_evaluated": "n",
    "n_rows_dropped_nan": "0",
    "mean_pinball_loss": _MEAN(_P),
    "median_pinball_loss": f"list_sort([{', '.join(_P)}])[3]",
    "max_pinball_loss": f"greatest({', '.join(_P)})",
    "mean_coverage": _MEAN(_C),
    "coverage_deviation": _MEAN(_AE),
    "mean_coverage_error": _MEAN(_AE),
    "max_coverage_error": f"greatest({', '.join(_AE)})",
    "coverage_bias": _MEAN(_E),
    "crps": SQL_CRPS,
    "monotonicity_violation_rate": "xr",
    "monotonicity_violated_rows": "xr * n",
    "pit_mean": "pm",
    "pit_std": "ps",
    "pit_ks": "d",
    "pit_ece_20bins": SQL_ECE,
}
for _i, _t in enumerate(TAUS):
    _pct = int(round(_t * 100))
    SQL_METRICS[f"pinball_loss_q{_pct}"] = f"p{_i}"
    SQL_METRICS[f"coverage_q{_pct}"] = f"c{_i}"
    SQL_METRICS[f"coverage_error_q{_pct}"] = _AE[_i]


def sql_metric_rows(metrics, src, digits=6, value="value"):
    return "\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, {sql_rd(e, digits)} AS {value} FROM {src}" for m, e in metrics.items()
    )


@query(
    "eval_quantiles",
    with_ctes(
        [*ctes_forecasts(), "src AS (SELECT * FROM fc WHERE split = 'test')", *sql_eval("src")],
        sql_metric_rows(SQL_METRICS, "ev, ks"),
    ),
)
def eval_quantiles(spark, sf):
    test = checkpoint(forecasts(spark, sf).where("split = 'test'"))
    out = E.quantile_metrics(test, "y_log_returns", "yq", TAUS)
    return out.select("metric", rd("value").alias("value"))


def sql_interval(src, y="y", lo="lo", hi="hi", alpha=0.2):
    """One wide row `it` of interval means of `src`."""
    return f"""it AS (SELECT count(*) AS n, avg({hi} - {lo}) AS width, stddev_pop({hi} - {lo}) AS wstd,
       min({hi} - {lo}) AS wmin, max({hi} - {lo}) AS wmax,
       avg({hi} - {lo} + (2 / CAST({alpha} AS DOUBLE)) * (greatest({lo} - {y}, 0)
           + greatest({y} - {hi}, 0))) AS score,
       avg(CAST({y} BETWEEN {lo} AND {hi} AS DOUBLE)) AS cov,
       avg(CAST({y} < {lo} AS DOUBLE)) AS below, avg(CAST({y} > {hi} AS DOUBLE)) AS above,
       stddev_pop({y}) AS ystd FROM {src})"""


SQL_INTERVAL_METRICS = {
    "interval_score": "score",
    "coverage_probability": "cov",
    "mean_interval_width": "width",
    "normalized_interval_width": "width / ystd",
}


@query(
    "eval_intervals",
    with_ctes(
        [*ctes_forecasts(), SQL_RADIUS, sql_interval("iv")],
        sql_metric_rows(SQL_INTERVAL_METRICS, "it"),
    ),
)
def eval_intervals(spark, sf):
    out = E.interval_metrics(calibrated(spark, sf), "y_log_returns", "lower", "upper", 0.2)
    return out.select("metric", rd("value").alias("value"))


@query(
    "pit_values",
    with_ctes(
        [*ctes_forecasts(), sql_pit("fc")], f"SELECT {SQL_KEYS}, {sql_rd('u')} AS pit FROM pit"
    ),
)
def pit_values(spark, sf):
    return forecasts(spark, sf).select(
        "symbol", day(), rd(A.pit("y_log_returns", "yq", TAUS)).alias("pit")
    )


_CMP = ["interval_score", "coverage_probability", "mean_interval_width",
        "normalized_interval_width"]
_CMP_P = ["mean_pinball_loss", "median_pinball_loss", "max_pinball_loss",
          *[f"pinball_loss_q{int(round(t * 100))}" for t in TAUS]]


def _compare_side(group):
    src = "src AS (SELECT *, q1 AS lo, q5 AS hi FROM fc WHERE split = 'test')"
    loss = [f"avg(greatest({t} * (y - {q}), ({t} - 1) * (y - {q}))) AS p{i}"
            for i, (q, t) in enumerate(zip(Q5, TAUS))]
    metrics = {**SQL_INTERVAL_METRICS, **{m: SQL_METRICS[m] for m in _CMP_P}}
    rows = "\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM it, pl"
        for m, e in metrics.items()
    )
    inner = [sql_forecasts(group), src, f"pl AS (SELECT {', '.join(loss)} FROM src)", sql_interval("src")]
    return with_ctes(inner, rows)


@query(
    "model_comparison",
    with_ctes(
        [*ctes_rets(), SQL_SPLIT, f"a AS ({_compare_side('symbol')})", f"z AS ({_compare_side(None)})"],
        f"""SELECT a.metric, {sql_rd('a.value')} AS model, {sql_rd('z.value')} AS baseline,
  {sql_rd('a.value - z.value')} AS difference,
  {sql_rd('(a.value - z.value) / abs(z.value) * 100', 4)} AS difference_pct,
  CASE WHEN a.metric IN ('pinball_loss_q25', 'pinball_loss_q75') THEN 'Difference'
       WHEN (a.metric = 'coverage_probability' AND a.value > z.value)
         OR (a.metric <> 'coverage_probability' AND a.value < z.value) THEN 'Improvement'
       ELSE 'Degradation' END AS verdict
FROM a JOIN z ON z.metric = a.metric""",
    ),
)
def model_comparison(spark, sf):
    def side(group):
        test = forecasts(spark, sf, group).where("split = 'test'")
        test = test.withColumns({"lower": F.get("yq", F.lit(0)), "upper": F.get("yq", F.lit(4))})
        return TR.forecast_metrics(checkpoint(test), ModelParams(target="y_log_returns"))

    out = E.compare_models(side("symbol"), side(None))
    cols = ["model", "baseline", "difference"]
    return out.select(
        "metric",
        *[rd(c).alias(c) for c in cols],
        rd("difference_pct", 4).alias("difference_pct"),
        "verdict",
    )


# --- latest rows ------------------------------------------------------------------------------------


@query(
    "latest_forecast",
    with_ctes(
        [*ctes_forecasts(), SQL_RADIUS],
        f"""SELECT {SQL_KEYS}, {sql_rd('lo', 8)} AS low, {sql_rd('q3', 8)} AS median,
  {sql_rd('hi', 8)} AS high, {sql_rd('hi - lo', 8)} AS width FROM iv
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""",
    ),
)
def latest_forecast(spark, sf):
    out = S.latest_forecast(calibrated(spark, sf), "lower", "median", "upper", "y_log_returns")
    cols = ["low", "median", "high", "width"]
    return out.select("symbol", day(), *[rd(c, 8).alias(c) for c in cols])


@query(
    "recent_window",
    with_ctes(
        ctes_rets(),
        f"""SELECT {SQL_KEYS}, {sql_rd('close')} AS close, {sql_rd('r', 9)} AS log_returns_d FROM rets
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 30""",
    ),
)
def recent_window(spark, sf):
    out = S.latest_rows(returns(spark, sf), 30)
    return out.select(
        "symbol", day(), rd("close").alias("close"), rd("log_returns_d", 9).alias("log_returns_d")
    )


# --- category codes and boosted trees -----------------------------------------------------------------

EMBARGO = 5


@query(
    "ordered_codes",
    with_ctes(
        ctes_rets(),
        f"""SELECT {SQL_KEYS}, {sql_rd("(coalesce(s, 0) + 20 * coalesce(ds / dn, 0)) / (coalesce(n, 0) + 20)", 8)} AS code
FROM (SELECT symbol, date, sum(y) OVER own AS s, count(y) OVER own AS n FROM rets
  WINDOW own AS (PARTITION BY symbol ORDER BY date
    RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {EMBARGO} DAYS PRECEDING))
JOIN (SELECT date, sum(sum(y)) OVER everyone AS ds, nullif(sum(count(y)) OVER everyone, 0) AS dn
  FROM rets GROUP BY date
  WINDOW everyone AS (ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {EMBARGO} DAYS PRECEDING))
USING (date)""",
    ),
)
def ordered_codes(spark, sf):
    rows = returns(spark, sf).select("symbol", "date", "y_log_returns")
    coded = ordered_means(rows, "symbol", "y_log_returns", EMBARGO)
    return coded.select("symbol", day(), rd("encoded", 8).alias("code"))


#: Few splits on plain columns, exact sketches and no drawn weights, so that SQL can repeat the fit.
STUMPS = BoostParams(
    rounds=3, learning_rate=0.5, depth=1, l2=20.0, borders=6, temperature=0.0, accuracy=10_000_000
)
STUMP_COLUMNS = {"close": "close", "log_returns_d": "r", "log_returns_ratio": "rr"}


def _sql_stumps() -> str:
    """Every round: gradients, the best of all (column, border) cuts, residual quantiles of both sides."""
    p = STUMPS
    shares = "[" + ", ".join(repr((i + 1) / (p.borders + 1)) for i in range(p.borders)) + "]"
    columns = list(STUMP_COLUMNS.values())
    x = ", ".join(f"coalesce(v.{c}, '-infinity'::DOUBLE) AS x{i}" for i, c in enumerate(columns))
    cuts = " UNION ALL ".join(
        f"SELECT {i} AS f, unnest(quantile_disc(x{i}, {shares})) AS b FROM rows_ WHERE split = 'train'"
        for i in range(len(columns))
    )
    side = f"CASE f {' '.join(f'WHEN {i} THEN x{i}' for i in range(len(columns)))} END > b"
    ctes = [
        *ctes_rets(),
        SQL_SPLIT,
        f"""rows_ AS MATERIALIZED (SELECT v.symbol, v.date, s.split, v.y, {x}
  FROM rets v JOIN splits s ON s.symbol = v.symbol AND s.date = v.date)""",
        f"cuts_ AS MATERIALIZED (SELECT DISTINCT f, b FROM ({cuts}) WHERE isfinite(b))",
    ]
    # the levels are literals, as quantile_disc takes constants only
    base = " UNION ALL ".join(
        f"SELECT {i} AS q, {t} AS tau, quantile_disc(y, {t}) AS v FROM rows_ WHERE split = 'train'"
        for i, t in enumerate(TAUS, 1)
    )
    ctes.append(f"f0 AS MATERIALIZED (SELECT r.*, q, tau, v FROM rows_ r, ({base}))")
    for k in range(p.rounds):
        leaves = " UNION ALL ".join(
            f"""SELECT {i} AS q, right_, quantile_disc(y - v, {t}) * {p.learning_rate} * count(*) / (count(*) + {p.l2}) AS add_
  FROM s{k} WHERE split = 'train' AND q = {i} GROUP BY right_"""
            for i, t in enumerate(TAUS, 1)
        )
        ctes += [
            f"""g{k} AS (SELECT f, b, q, {side} AS right_, count(*) AS w, sum(tau - CASE WHEN y < v THEN 1 ELSE 0 END) AS g
  FROM f{k}, cuts_ WHERE split = 'train' GROUP BY ALL)""",
            f"""best{k} AS MATERIALIZED (SELECT f, b FROM g{k} GROUP BY f, b HAVING count(DISTINCT right_) = 2
  ORDER BY round(sum(g * g / (w + {p.l2})), 6) DESC, f, b LIMIT 1)""",
            f"s{k} AS MATERIALIZED (SELECT f{k}.*, {side} AS right_ FROM f{k}, best{k})",
            f"""f{k + 1} AS MATERIALIZED (SELECT s.symbol, s.date, s.split, s.y, {', '.join(f's.x{i}' for i in range(len(columns)))},
  s.q, s.tau, s.v + a.add_ AS v FROM s{k} s JOIN ({leaves}) a ON a.q = s.q AND a.right_ = s.right_)""",
        ]
    shown = ", ".join(f"{sql_rd(f'vs[{i}]', 7)} AS {q}" for i, q in enumerate(Q5, 1))
    return with_ctes(
        ctes,
        f"""SELECT {SQL_KEYS}, {shown} FROM (SELECT symbol, date, list_sort(list(v)) AS vs
  FROM f{p.rounds} WHERE split IN ('cal', 'test') GROUP BY symbol, date)""",
    )


@query("boosted_stumps", _sql_stumps())
def boosted_stumps(spark, sf):
    columns = list(STUMP_COLUMNS)
    labelled = returns(spark, sf).where("y_log_returns is not null")
    rows = L.with_holdout_split(checkpoint(labelled), fractions=FRACTIONS)
    model = BoostedQuantiles(STUMPS).fit(rows.where("split = 'train'"), columns, "y_log_returns")
    scored = model.predict(rows.where("split in ('cal', 'test')"))
    return scored.select(
        "symbol", day(), *[rd(F.get("yq", F.lit(i)), 7).alias(q) for i, q in enumerate(Q5)]
    )


@query("permutation_importance")
def permutation_importance(spark, sf):
    """Growth of the test loss without each column, for the model of `boosted_stumps`."""
    labelled = returns(spark, sf).where("y_log_returns is not null")
    rows = L.with_holdout_split(checkpoint(labelled), fractions=FRACTIONS)
    model = BoostedQuantiles(STUMPS).fit(rows.where("split = 'train'"), list(STUMP_COLUMNS), "y_log_returns")
    test = rows.where("split = 'test'")
    out = model.permutation_importance(test, "y_log_returns", ["symbol", "date"])
    return out.select("feature", rd("importance", 8).alias("importance"), rd("share").alias("share"))


#: Fewer and larger steps than the default thousand, for a panel of this size.
BOOST = BoostParams(rounds=6, learning_rate=0.6, depth=3, borders=32, patience=3)


@query("boosted_quantiles")
def boosted_quantiles(spark, sf):
    trained = TR.train(_features(spark, sf), MODEL, BOOST)
    return levels(trained.score(trained.sets.where("split = 'test'")))


@query("boosted_vs_baseline")
def boosted_vs_baseline(spark, sf):
    return TR.evaluate(TR.train(_features(spark, sf), MODEL, BOOST))


# --- models: no SQL equivalent, rows only (tests check their invariants) -------------------------------


def _features(spark, sf):
    return checkpoint(build_features(panel(spark, sf)))


MODEL = ModelParams()


@query("grouped_pca")
def grouped_pca(spark, sf):
    feats = _features(spark, sf)
    fitted = GroupedPca.fit(feats.where("y_log_returns is not null"))
    out = fitted.transform(feats)
    return out.select("symbol", day(), *[rd(c, 4).alias(c) for c in fitted.output_columns])


@query("quantile_forest")
def quantile_forest(spark, sf):
    trained = TR.train(_features(spark, sf), MODEL)
    return levels(trained.score(trained.sets.where("split = 'test'")))


@query("trained_vs_baseline")
def trained_vs_baseline(spark, sf):
    return TR.evaluate(TR.train(_features(spark, sf), MODEL))


@query("feature_importance")
def feature_importance(spark, sf):
    trained = TR.train(_features(spark, sf), MODEL)
    return trained.model.importance(spark)


@query("score_quantiles")
def score_quantiles(spark, sf):
    p = panel(spark, sf)
    trained = TR.train(checkpoint(build_features(p)), MODEL)
    # scored by what another session would load; the checkpoint above has named the shared folder
    path = f"{spark.sparkContext.getCheckpointDir()}/trained-{uuid.uuid4().hex}"
    trained.save(path)
    scored = TR.Trained.load(spark, path).score(S.inference_features(p))
    out = S.quantile_columns(scored, "yq", TAUS)
    return out.select(
        "symbol", day(), *[c for c in out.columns if c.startswith("pred_Q_")], "lower", "upper"
    )
