"""The training steps as stages of a `pyspark.ml` Pipeline, and cross-validation over purged folds.

    Pipeline(stages=[PanelPreprocessor(target="y"), QuantileBoost(target="y"), ConformalBand(target="y")])

Every stage and every fitted model is saved and loaded with the pipeline that holds it.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import BoostParams
from tidemark.operators.boosting import BoostedQuantiles
from tidemark.operators.calibrate import ConformalInterval
from tidemark.operators.evaluate import pinball
from tidemark.operators.models import Preprocessor, median_of
from tidemark.operators.splits import purged_folds
from tidemark.session import checkpoint


def _param(name: str, doc: str, convert):
    return Param(Params._dummy(), name, doc, typeConverter=convert)


class _Saved(MLWritable, MLReadable):
    """A model that keeps its fitted state in a folder beside its parameters."""

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)

    def _save_state(self, path: str) -> None:
        raise NotImplementedError

    @classmethod
    def _load_state(cls, path: str):
        raise NotImplementedError


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage._save_state(f"{path}/state")


class _Reader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind(self.kind._load_state(f"{path}/state"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


def _write_text(path: str, text: str) -> None:
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(text,)], "state string").write.mode("overwrite").parquet(path)


def _read_text(path: str) -> str:
    return SparkSession.getActiveSession().read.parquet(path).first().state


class _Shared(Params):
    target = _param("target", "label column", TypeConverters.toString)
    outputCol = _param("outputCol", "column of ascending quantiles", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(target="y_log_returns", outputCol="yq")

    def _of(self, param):
        return self.getOrDefault(param)


# --- preprocessing ---------------------------------------------------------------------


class PanelPreprocessor(_Shared, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Imputed, scaled, grouped components, calendar columns and the encoded symbol."""

    embargoDays = _param("embargoDays", "days between a row and the targets its code may know", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, target=None, embargoDays=None):
        super().__init__()
        self._setDefault(embargoDays=5)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> PanelPreprocessorModel:
        fitted = Preprocessor.fit(df, self._of(self.target), self._of(self.embargoDays))
        return self._copyValues(PanelPreprocessorModel(fitted))


class PanelPreprocessorModel(_Shared, Model, _Saved):
    """Rows outside the fit get each symbol's whole mean, rows of the fit included."""

    embargoDays = PanelPreprocessor.embargoDays

    def __init__(self, fitted: Preprocessor | None = None):
        super().__init__()
        self._setDefault(embargoDays=5)
        self.fitted = fitted

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.fitted.transform(df)

    def _save_state(self, path: str) -> None:
        self.fitted.save(path)

    @classmethod
    def _load_state(cls, path: str) -> Preprocessor:
        return Preprocessor.load(path)


# --- the quantile model ----------------------------------------------------------------


class _BoostShared(_Shared):
    featureCols = _param("featureCols", "input columns; those of the preprocessor if not given", TypeConverters.toListString)
    rounds = _param("rounds", "trees at most", TypeConverters.toInt)
    learningRate = _param("learningRate", "share of a leaf's residual quantile that is added", TypeConverters.toFloat)
    depth = _param("depth", "splits of a tree", TypeConverters.toInt)
    l2 = _param("l2", "penalty on leaf weights", TypeConverters.toFloat)
    borders = _param("borders", "borders of a feature", TypeConverters.toInt)
    patience = _param("patience", "rounds without a better validation loss", TypeConverters.toInt)
    temperature = _param("temperature", "of the Bayesian bootstrap", TypeConverters.toFloat)
    validationCol = _param("validationCol", "boolean column of rows that only stop the fit", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        p = BoostParams()
        self._setDefault(
            featureCols=[], rounds=p.rounds, learningRate=p.learning_rate, depth=p.depth, l2=p.l2, borders=p.borders,
            patience=p.patience, temperature=p.temperature, validationCol="",
        )


class QuantileBoost(_BoostShared, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, target=None, outputCol=None, featureCols=None, rounds=None, learningRate=None, depth=None,
                 l2=None, borders=None, patience=None, temperature=None, validationCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> QuantileBoostModel:
        of = self._of
        params = BoostParams(
            rounds=of(self.rounds), learning_rate=of(self.learningRate), depth=of(self.depth), l2=of(self.l2),
            borders=of(self.borders), patience=of(self.patience), temperature=of(self.temperature),
        )
        features = of(self.featureCols) or [
            c for c in df.columns if "_pca" in c or c in ("month", "day_of_week", "day_of_year", "atr", "symbol_code")
        ]
        held, target = of(self.validationCol), of(self.target)
        # read by every pass of the fit
        rows = checkpoint(df.select(*features, target, *([held] if held else [])))
        if held:
            model = BoostedQuantiles(params).fit(rows.where(~F.col(held)), features, target, rows.where(held))
        else:
            model = BoostedQuantiles(params).fit(rows, features, target)
        return self._copyValues(QuantileBoostModel(model))


class QuantileBoostModel(_BoostShared, Model, _Saved):
    def __init__(self, fitted: BoostedQuantiles | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.fitted.predict(df, self._of(self.outputCol))

    def _save_state(self, path: str) -> None:
        self.fitted.save(path)

    @classmethod
    def _load_state(cls, path: str) -> BoostedQuantiles:
        return BoostedQuantiles.load(path)


# --- calibration -----------------------------------------------------------------------


class ConformalBand(_Shared, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A band around the predicted median that covers 1 - alpha of the rows it is fitted on."""

    alpha = _param("alpha", "share of rows outside the band", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, target=None, outputCol=None, alpha=None):
        super().__init__()
        self._setDefault(alpha=0.2)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ConformalBandModel:
        scored = df.withColumn("_median", _middle(self._of(self.outputCol)))
        fitted = ConformalInterval(alpha=self._of(self.alpha)).fit(scored, self._of(self.target), "_median")
        return self._copyValues(ConformalBandModel(fitted))


class ConformalBandModel(_Shared, Model, _Saved):
    alpha = ConformalBand.alpha

    def __init__(self, fitted: ConformalInterval | None = None):
        super().__init__()
        self._setDefault(alpha=0.2)
        self.fitted = fitted

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = df.withColumn("_median", _middle(self._of(self.outputCol)))
        return self.fitted.transform(scored, "_median").drop("_median")

    def _save_state(self, path: str) -> None:
        _write_text(path, self.fitted.to_json())

    @classmethod
    def _load_state(cls, path: str) -> ConformalInterval:
        return ConformalInterval.from_json(_read_text(path))


def _middle(yq: str):
    return median_of(yq, len(BoostParams().quantiles))


# --- evaluation and cross-validation ---------------------------------------------------


class PinballEvaluator(_Shared, Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Mean pinball loss over all rows and quantiles; lower is better."""

    @keyword_only
    def __init__(self, *, target=None, outputCol=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _evaluate(self, df: DataFrame) -> float:
        taus, yq = BoostParams().quantiles, self._of(self.outputCol)
        parts = [pinball(F.col(self._of(self.target)), F.get(F.col(yq), F.lit(i)), t) for i, t in enumerate(taus)]
        return df.agg(F.avg(sum(parts[1:], parts[0]) / len(parts))).first()[0]

    def isLargerBetter(self) -> bool:
        return False


class PurgedCrossValidation:
    """Chooses among parameter maps by expanding windows that are purged and embargoed.

    pyspark's CrossValidator trains on every other fold, later ones included; here a fold trains only
    on rows that end before its test window, less horizon and embargo.
    """

    def __init__(self, estimator: Estimator, maps: list[dict], evaluator: Evaluator, n_splits: int = 5, **folds):
        self.estimator, self.maps, self.evaluator = estimator, maps, evaluator
        self.n_splits, self.folds = n_splits, folds

    def fit(self, df: DataFrame):
        """(model fitted on all rows with the best map, mean metric of each map, metrics by fold)."""
        if not self.maps:
            raise ValueError("no parameter maps to choose from")
        roles = checkpoint(purged_folds(df, self.n_splits, **self.folds))
        numbers = sorted(r.fold for r in roles.select("fold").distinct().collect())
        if not numbers:
            raise ValueError("no fold has enough rows to train on")
        metrics = []
        for fold in numbers:
            rows = roles.where(F.col("fold") == fold)
            train, test = (rows.where(F.col("role") == r).drop("fold", "role") for r in ("train", "test"))
            metrics.append([self.evaluator.evaluate(self.estimator.fit(train, m).transform(test)) for m in self.maps])
        means = [sum(m) / len(m) for m in zip(*metrics, strict=True)]
        pick = (max if self.evaluator.isLargerBetter() else min)(range(len(means)), key=means.__getitem__)
        return self.estimator.fit(df, self.maps[pick]), means, metrics


def describe(model: QuantileBoostModel) -> str:
    """The fitted parameters and trees as JSON."""
    fitted = model.fitted
    return json.dumps({"params": asdict(fitted.params), "trees": [asdict(t) for t in fitted.trees]})
