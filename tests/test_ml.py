"""Stages of a pyspark.ml pipeline: persistence and purged cross-validation."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from conftest import random_walk
from tidemark import ml
from tidemark.operators.features import build_features

SMALL = dict(rounds=2, learningRate=0.5, depth=1, borders=8, patience=1)


def test_a_loaded_pipeline_scores_as_the_fitted_one(spark, make_panel, tmp_path):
    features = build_features(make_panel({s: random_walk(i, 200) for i, s in enumerate("AB")}))
    rows = features.where("y_log_returns is not null").withColumn("held", F.dayofmonth("date") > 25).cache()
    stages = [ml.PanelPreprocessor(embargoDays=7), ml.QuantileBoost(validationCol="held", **SMALL), ml.ConformalBand(alpha=0.3)]
    pipeline = Pipeline(stages=stages)
    pipeline.write().overwrite().save(str(tmp_path / "p"))
    pipeline = Pipeline.load(str(tmp_path / "p"))
    assert pipeline.getStages()[0].getOrDefault("embargoDays") == 7
    model = pipeline.fit(rows)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert [s.uid for s in again.stages] == [s.uid for s in model.stages]
    assert again.stages[1].getOrDefault("depth") == 1 and again.stages[2].getOrDefault("alpha") == 0.3
    show = lambda m: m.transform(rows).select("symbol", "date", "yq", "lower", "upper")
    assert show(model).exceptAll(show(again)).isEmpty() and show(again).count() == rows.count()
    inside = show(again).join(rows, ["symbol", "date"]).where("y_log_returns between lower and upper").count()
    assert inside / rows.count() >= 0.7
    assert ml.describe(again.stages[1]) == ml.describe(model.stages[1])


def test_cross_validation_trains_on_the_past_only(spark):
    rng = np.random.default_rng(2)
    start = dt.date(2023, 1, 1)
    x = rng.uniform(-1, 1, 600)
    rows = [("S", start + dt.timedelta(days=i // 4), float(a), float(a + 0.1 * rng.normal())) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double, y double").repartition(2)
    boost = ml.QuantileBoost(target="y", featureCols=["x"], l2=1.0, temperature=0.0, **{**SMALL, "depth": 2})
    maps = [{boost.rounds: 0}, {boost.rounds: 6}]
    evaluator = ml.PinballEvaluator(target="y")
    model, means, metrics = ml.PurgedCrossValidation(boost, maps, evaluator, 3, horizon_days=2).fit(df)
    assert len(metrics) == 2 and means[1] < means[0]
    assert model.fitted.best_round == 6 and not evaluator.isLargerBetter()
    # later rows do not change what an earlier fold measures
    spoiled = df.withColumn("y", F.when(F.col("date") > F.lit(start + dt.timedelta(days=101)), 9.0).otherwise(F.col("y")))
    _, _, other = ml.PurgedCrossValidation(boost, maps[1:], evaluator, 3, horizon_days=2).fit(spoiled)
    assert other[0][0] == pytest.approx(metrics[0][1])
    with pytest.raises(ValueError):
        ml.PurgedCrossValidation(boost, [], evaluator).fit(df)
