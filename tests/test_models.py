import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import random_walk
from tidemark.config import FEATURE_GROUPS, MODEL_FEATURES, ModelParams
from tidemark.functions import arrays as A
from tidemark.operators import models as M
from tidemark.operators import score as S
from tidemark.operators import splits as L
from tidemark.operators import transforms as T
from tidemark.operators.features import build_features
from tidemark.operators.transforms import out_of_fold_means
from tidemark.plans.train import Trained, evaluate, train

TAUS = [0.1, 0.25, 0.5, 0.75, 0.9]
DAYS = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(100)]


def dated(spark, n=100):
    return spark.createDataFrame([(d, s, float(i)) for i, d in enumerate(DAYS[:n]) for s in "AB"], "date date, symbol string, x double")


def test_cut_dates_follow_float_sums():
    cuts = L.cut_dates(DAYS, (0.6, 0.1, 0.2, 0.1))
    assert [DAYS.index(c) for c in cuts] == [59, 69, 88]
    with pytest.raises(ValueError):
        L.cut_dates(DAYS, (0.5, 0.1, 0.2, 0.1))
    with pytest.raises(ValueError):
        L.cut_dates(DAYS[:9], (0.6, 0.1, 0.2, 0.1))


def test_holdout_split_purges_before_later_segments(spark):
    got = {r.date: r.split for r in L.with_holdout_split(dated(spark), fractions=(0.6, 0.1, 0.2, 0.1)).collect()}
    idx = {s: [DAYS.index(d) for d, v in got.items() if v == s] for s in (*L.SPLITS, "purged")}
    # train ends where [t, t+5) first touches val minus its embargo; val is not purged against cal
    assert max(idx["train"]) == 50 and min(idx["val"]) == 60 and max(idx["val"]) == 69
    assert min(idx["cal"]) == 70 and max(idx["cal"]) == 79 and min(idx["test"]) == 89
    strict = L.with_holdout_split(dated(spark), fractions=(0.6, 0.1, 0.2, 0.1), strict=True)
    assert strict.where("split = 'val'").count() < 20
    with pytest.raises(ValueError):
        L.with_holdout_split(dated(spark).drop("symbol"))


def test_modeling_sets_reject_empty_splits(spark):
    with pytest.raises(ValueError, match="empty splits"):
        L.modeling_sets(dated(spark, 12), ["x"], "x", horizon_days=5)
    with pytest.raises(ValueError):
        L.modeling_sets(dated(spark), ["nope"], "x")


def test_purged_folds(spark):
    folds = L.purged_folds(dated(spark), 5).toPandas()
    assert sorted(folds.fold.unique()) == [1, 2, 3, 4]  # the first window has no past
    for f, part in folds.groupby("fold"):
        train, test = part[part.role == "train"].date, part[part.role == "test"].date
        assert (test.min() - train.max()).days >= 10 and len(test) == 40
    spans = L.fold_windows(DAYS, 3, span_days=7)
    assert spans[0] == (DAYS[0], DAYS[7]) and spans[-1] == (DAYS[99], DAYS[99])
    with pytest.raises(ValueError):
        L.purged_folds(dated(spark), 1)


def test_baseline_with_unseen_group(spark):
    rng = np.random.default_rng(1)
    rows = [(s, float(v)) for s in "AB" for v in rng.normal(ord(s), 1, 101)]
    df = spark.createDataFrame(rows, "symbol string, y double")
    fit = M.HistoricalQuantiles(TAUS, "symbol").fit(df, "y")
    got = {r.symbol: r.yq for r in fit.predict(spark.createDataFrame([("A",), ("Z",)], "symbol string")).collect()}
    np.testing.assert_allclose(got["A"], np.quantile([v for s, v in rows if s == "A"], TAUS))
    np.testing.assert_allclose(got["Z"], np.quantile([v for _, v in rows], TAUS))
    with pytest.raises(ValueError):
        M.HistoricalQuantiles([0.0, 0.5])
    r2 = M.r2_score(df, "y", F.lit(0.0) + 65.5).first().r2
    y = np.array([v for _, v in rows])
    assert r2 == pytest.approx(1 - ((y - 65.5) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_grouped_pca_matches_numpy(spark):
    x = np.random.default_rng(2).normal(size=(200, 3)) @ np.array([[2, 1, 0], [0, 1, 1], [0, 0, 0.3]])
    rows = [tuple(float(v) for v in r) for r in x]
    rows[5] = (None, *rows[5][1:])
    df = spark.createDataFrame(rows, "a double, b double, c double")
    fit = T.GroupedPca.fit(df, {"g": (2, ["a", "b", "c"])})
    got = fit.transform(df).select("g_pca0", "g_pca1").toPandas().to_numpy()
    z = np.array([[np.nan if v is None else v for v in r] for r in rows])
    z = np.where(np.isnan(z), np.nanmean(z, axis=0), z)
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    _, _, vt = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    want = z @ vt[:2].T
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-8)
    assert T.GroupedPca.from_json(fit.to_json()) == fit
    assert sum(k for k, _ in FEATURE_GROUPS.values()) == 23 and len(MODEL_FEATURES) == 48


def test_standardize_types(spark):
    df = spark.createDataFrame([("1", "x", 1.0), ("2.5", "3", 2.0)], "a string, b string, c double")
    out, cats = T.standardize_types(df)
    assert cats == ["b"] and dict(out.dtypes)["a"] == "double"


def test_forest_is_monotone_calibrated_and_reloads(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, 3000)
    rows = [(float(a), float(b)) for a, b in zip(x, x + rng.normal(0, 0.2 + 0.5 * (x > 0)))]
    df = spark.createDataFrame(rows, "x double, y double").repartition(2)
    p = ModelParams(num_trees=8, tree_step=4)
    forest = M.QuantileForest(p).fit(df, ["x"], "y")
    scored = forest.predict(df)
    assert scored.where(A.crosses("yq", 5)).count() == 0
    for i, t in enumerate(TAUS):
        share = scored.where(F.col("y") <= F.get("yq", F.lit(i))).count() / 3000
        assert abs(share - t) < 0.05
    assert forest.best_tree_count(df, "y") in (4, 8)
    assert forest.importance(spark).first().importance == 1.0
    forest.save(str(tmp_path / "m"))
    again = M.QuantileForest.load(str(tmp_path / "m")).predict(df)
    assert again.orderBy("x").first().yq == scored.orderBy("x").first().yq


def test_latest_rows_and_columns(spark):
    df = dated(spark).withColumn("yq", F.array(*[F.lit(float(i)) for i in range(5)]))
    assert S.latest_rows(df, 30).count() == 60
    assert S.latest_rows(df.withColumn("t", F.when(F.col("x") < 50, 1)), 1, "t").first().x == 49.0
    assert "pred_Q_25" in S.quantile_columns(df, "yq", TAUS).columns


def test_out_of_fold_codes_leave_out_their_own_targets(spark):
    rows = [("A", i, float(i)) for i in range(10)] + [("B", 0, 5.0)]
    df = spark.createDataFrame(rows, "s string, d int, y double")
    got = out_of_fold_means(df, "s", "y", F.col("d") % 2, smoothing=1.0).collect()
    overall = sum(r[2] for r in rows) / len(rows)
    means = {(r.s, r.fold): r.encoded for r in got}
    assert means["A", 0] == pytest.approx((25 + overall) / 6)
    assert means["A", 1] == pytest.approx((20 + overall) / 6)
    assert means["B", 0] == pytest.approx(overall)


def test_a_trained_model_scores_alike_when_loaded(spark, make_panel, tmp_path):
    panel = make_panel({s: random_walk(i, 500) for i, s in enumerate("AB")})
    features = build_features(panel)
    trained = train(features, ModelParams(num_trees=2, tree_step=2, max_depth=2))
    trained.save(str(tmp_path / "t"))
    again = Trained.load(spark, str(tmp_path / "t"))
    assert again.params == trained.params
    test = trained.sets.where("split = 'test'")
    assert again.sets.where("split = 'test'").count() == test.count() > 0
    show = lambda t: t.score(test).select("symbol", "date", "yq", "lower", "upper")
    assert show(trained).exceptAll(show(again)).isEmpty()
    assert evaluate(again).count() == evaluate(trained).count() > 0
