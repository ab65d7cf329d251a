import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions.tails import f_upper_p, student_two_sided_p
from tidemark.operators import calibrate as C
from tidemark.operators import drift as D
from tidemark.operators import evaluate as E
from tidemark.operators import monitor as M
from tidemark.operators.ecdf import exact_quantiles, global_rank

TAUS = [0.1, 0.25, 0.5, 0.75, 0.9]
RNG = np.random.default_rng(0)


def frame(spark, values, name="x"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def test_exact_quantiles_with_a_hot_value_and_a_hot_key(spark):
    v = np.r_[np.zeros(400), RNG.normal(size=600)]
    keys = ["hot"] * 800 + [f"k{i % 20}" for i in range(200)]
    df = spark.createDataFrame(list(zip(keys, map(float, v))), "k string, x double")
    got = {r.k: r.q for r in exact_quantiles(df, "x", TAUS, "k").collect()}
    for k in set(keys):
        want = np.quantile(v[np.array(keys) == k], TAUS)
        np.testing.assert_allclose(got[k], want, atol=1e-12)
    np.testing.assert_allclose(exact_quantiles(df, "x", TAUS).first().q, np.quantile(v, TAUS), atol=1e-12)


def test_conformal_quantile_is_the_order_statistic(spark):
    v = RNG.normal(size=97)
    for level in (0.0, 0.1, 0.5, 0.8, 0.9, 1.0):
        k = min(max(int(np.ceil(98 * level)), 1), 97)
        assert C.score_quantile(frame(spark, v), F.col("x"), level) == np.sort(v)[k - 1]
    with pytest.raises(ValueError):
        C.score_quantile(frame(spark, v), F.col("x"), 1.5)
    with pytest.raises(ValueError):
        C.score_quantile(frame(spark, []), F.col("x"), 0.5)


def test_global_rank_is_a_permutation_in_order(spark):
    df = spark.createDataFrame([(int(i),) for i in RNG.permutation(500)], "x int")
    got = global_rank(df, ["x"]).toPandas().sort_values("_rank")
    assert list(got._rank) == list(range(500)) and list(got.x) == list(range(500))


def test_drift_against_numpy(spark):
    ref, cur = RNG.normal(size=400), RNG.normal(0.4, 1.3, size=300)
    got = D.feature_drift(frame(spark, ref), frame(spark, cur), ["x", "absent"]).first()
    allv = np.sort(np.r_[ref, cur])
    f = np.searchsorted(np.sort(ref), allv, side="right") / 400
    g = np.searchsorted(np.sort(cur), allv, side="right") / 300
    assert got.ks_statistic == pytest.approx(np.abs(f - g).max(), abs=1e-12)
    assert got.wasserstein_distance == pytest.approx((np.abs(f - g)[:-1] * np.diff(allv)).sum(), abs=1e-9)
    edges = np.percentile(ref, np.linspace(0, 100, 11))
    edges[0], edges[-1] = -np.inf, np.inf
    p = (np.histogram(ref, edges)[0] + 1e-6) / (400 + 1e-5)
    q = (np.histogram(cur, edges)[0] + 1e-6) / (300 + 1e-5)
    assert got.psi == pytest.approx(((q - p) * np.log(q / p)).sum(), abs=1e-9)
    bins = np.linspace(allv[0], allv[-1], 51)
    p, q = (np.histogram(x, bins)[0] / len(x) + 1e-10 for x in (ref, cur))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    js = np.sqrt((np.sum(p * np.log2(p / m)) + np.sum(q * np.log2(q / m))) / 2)
    assert got.jensen_shannon_distance == pytest.approx(js, abs=1e-9)
    assert got.psi_interpretation == ("major_drift" if got.psi >= 0.2 else "minor_drift")


def test_drift_edge_cases(spark):
    same = frame(spark, [1, 2, 3, 4, 5])
    got = D.feature_drift(same, same, ["x"]).first()
    assert got.ks_statistic == 0 and got.wasserstein_distance == 0 and got.ks_p_value == 1
    got = D.feature_drift(frame(spark, [1, 2, 3]), frame(spark, [4, 5, 6]), ["x"]).first()
    assert got.wasserstein_distance == pytest.approx(3.0) and got.ks_statistic == 1.0
    with pytest.raises(ValueError):
        D.feature_drift(same, same, ["absent"])


def test_target_drift_tests(spark):
    ref, cur = RNG.normal(size=200), RNG.normal(0.5, 2.0, size=150)
    got = {r.metric: r.value for r in D.target_drift(frame(spark, ref), frame(spark, cur), "x").collect()}
    t = (ref.mean() - cur.mean()) / np.sqrt(ref.var(ddof=1) / 200 + cur.var(ddof=1) / 150)
    assert got["mean_diff_t_stat"] == pytest.approx(t)
    a, b = ref.var(ddof=1) / 200, cur.var(ddof=1) / 150
    dof = (a + b) ** 2 / (a**2 / 199 + b**2 / 149)
    grid = np.linspace(abs(t), abs(t) + 200, 2_000_001)
    tail = np.trapezoid((1 + grid**2 / dof) ** (-(dof + 1) / 2), grid)
    whole = 2 * np.trapezoid((1 + (grid - abs(t)) ** 2 / dof) ** (-(dof + 1) / 2), grid)
    assert got["mean_diff_p_value"] == pytest.approx(2 * tail / whole, rel=1e-4)
    assert got["variance_levene_p_value"] < 1e-6
    assert got["reference_n"] == 200


def test_tail_probabilities():
    # reference values from standard t and F tables
    assert student_two_sided_p(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert student_two_sided_p(1.96, 1e7) == pytest.approx(0.05, abs=1e-4)
    assert f_upper_p(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert f_upper_p(0.0, 1, 10) == 1.0


def forecasts(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=n)
    yq = np.sort(rng.normal(0, 0.3, (n, 1)) + np.array([-1.3, -0.7, 0, 0.7, 1.3]) + rng.normal(0, 0.4, (n, 5)))
    yq[:20] = yq[:20, ::-1]
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i // 7) for i in range(n)]
    rows = [(d, f"s{i % 7}", float(a), [float(x) for x in b]) for i, (d, a, b) in enumerate(zip(days, y, yq))]
    return spark.createDataFrame(rows, "date date, symbol string, y double, yq array<double>"), y, yq, days


def test_quantile_metrics_against_numpy(spark):
    df, y, yq, _ = forecasts(spark)
    df = df.unionByName(df.limit(2).withColumn("y", F.lit(float("nan"))))
    got = {r.metric: r.value for r in E.quantile_metrics(df, "y", "yq", TAUS).collect()}
    assert set(got) == set(E.metric_names(TAUS))
    e = y[:, None] - yq
    loss = np.maximum(np.array(TAUS) * e, (np.array(TAUS) - 1) * e).mean(axis=0)
    assert got["mean_pinball_loss"] == pytest.approx(loss.mean())
    assert got["crps"] == pytest.approx(2 * np.trapezoid(loss, TAUS))
    assert got["monotonicity_violated_rows"] == 20 and got["n_rows_dropped_nan"] == 2
    mono = np.maximum.accumulate(yq, axis=1)
    pit = np.array([np.interp(a, r, TAUS, left=0, right=1) for a, r in zip(y, mono)])
    assert got["pit_mean"] == pytest.approx(pit.mean())
    u = np.sort(pit)
    n = len(u)
    ks = max((np.arange(1, n + 1) / n - u).max(), (u - np.arange(n) / n).max())
    assert got["pit_ks"] == pytest.approx(ks)
    ece = np.abs(np.histogram(pit, bins=20, range=(0, 1))[0] / n - 0.05).mean()
    assert got["pit_ece_20bins"] == pytest.approx(ece)


def test_levels_may_come_unsorted(spark):
    df, *_ = forecasts(spark)
    order = [2, 0, 4, 1, 3]
    mixed = df.withColumn("yq", F.array(*[F.get("yq", F.lit(i)) for i in order]))
    a = {r.metric: r.value for r in E.quantile_metrics(df, "y", "yq", TAUS).collect()}
    b = {r.metric: r.value for r in E.quantile_metrics(mixed, "y", "yq", [TAUS[i] for i in order]).collect()}
    assert a == b
    with pytest.raises(ValueError):
        A.check_quantiles([0.1, 0.1])


def test_trend_over_blocks(spark):
    df, y, yq, days = forecasts(spark)
    p = pd.DataFrame({"d": days, "s": [f"s{i % 7}" for i in range(len(y))]})
    e = y[:, None] - yq
    loss = pd.DataFrame(np.maximum(np.array(TAUS) * e, (np.array(TAUS) - 1) * e))
    cov = pd.DataFrame((y[:, None] <= yq).astype(float))
    order = p.sort_values(["d", "s"]).index
    want_loss = loss.loc[order].reset_index(drop=True).rolling(30).mean().mean(axis=1).dropna()
    want_cov = (cov.loc[order].reset_index(drop=True).rolling(30).mean() - TAUS).abs().mean(axis=1, skipna=False).dropna()
    got = M.performance_trend(df, "y", "yq", TAUS, block=64).toPandas().sort_values(["date", "symbol"])
    np.testing.assert_allclose(got.mean_pinball_loss, want_loss)
    np.testing.assert_allclose(got.mean_coverage_error, want_cov)
    assert len(got) == 271


def test_interval_report_and_errors(spark):
    df, y, yq, _ = forecasts(spark)
    df = df.withColumns({"lo": F.array_min("yq"), "hi": F.array_max("yq")})
    got = {(r.section, r.metric): r.value for r in M.interval_report(df, "y", "lo", "hi").collect()}
    w = yq.max(axis=1) - yq.min(axis=1)
    assert got["width_statistics", "median"] == pytest.approx(np.median(w))
    assert got["width_statistics", "q75"] == pytest.approx(np.percentile(w, 75))
    curve = M.calibration_curve(df, "y", "lo", "hi").toPandas()
    assert curve.n.sum() == 300 and set(curve.bin) == set(range(10))
    sharp = {r.metric: r.value for r in M.sharpness(df, "lo", "hi").collect()}
    assert sharp["width_90th_percentile"] == pytest.approx(np.percentile(w, 90))
    with pytest.raises(Exception, match="lower above upper"):
        E.interval_metrics(df, "y", "hi", "lo").collect()


def test_calibrators(spark):
    rng = np.random.default_rng(9)
    rows = [(float(a), float(b)) for a, b in zip(rng.normal(size=2000), rng.normal(0, 0.1, 2000))]
    df = spark.createDataFrame(rows, "y double, h double")
    cal = C.ConformalInterval(alpha=0.2).fit(df, "y", "h")
    assert cal.transform(df, "h").where("y between lower and upper").count() >= 1600
    assert C.ConformalInterval.from_json(cal.to_json()) == cal
    with pytest.raises(ValueError):
        C.ConformalInterval(alpha=0.2).transform(df, "h")
    with pytest.raises(ValueError):
        C.ConformalInterval(alpha=1.2)
    q, *_ = forecasts(spark)
    shifted = C.ConformalQuantiles(TAUS).fit(q, "y", "yq").transform(q, "yq", "c")
    assert shifted.where(A.crosses("c", 5)).count() == 0
    for i, t in enumerate(TAUS):
        assert shifted.where(F.col("y") <= F.get("c", F.lit(i))).count() >= 300 * t - 1


def test_compare_models(spark):
    m = spark.createDataFrame([("crps", 1.0), ("interval_score", 1.0), ("coverage_probability", 0.5)], "metric string, value double")
    b = spark.createDataFrame([("crps", 0.0), ("interval_score", 2.0), ("coverage_probability", 0.8)], "metric string, value double")
    got = {r.metric: (r.verdict, r.difference_pct) for r in E.compare_models(m, b).collect()}
    assert got["crps"] == ("Difference", 0.0) and got["interval_score"] == ("Improvement", -50.0)
    assert got["coverage_probability"][0] == "Degradation"
