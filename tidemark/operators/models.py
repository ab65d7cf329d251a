"""Quantile models: historical baseline and a quantile forest."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import PASSTHROUGH_FEATURES, ModelParams
from tidemark.functions import arrays as A
from tidemark.functions.scalars import clean_double, double_array, sdiv
from tidemark.operators.ecdf import exact_quantiles
from tidemark.operators.evaluate import pinball
from tidemark.operators.transforms import (
    GroupedPca,
    encode_category,
    ordered_means,
    target_means,
)


@dataclass
class HistoricalQuantiles:
    """Empirical quantiles of the target, overall or per group; unseen groups use the overall ones."""

    quantiles: list[float]
    group_col: str | None = None
    overall: list[float] | None = None
    per_group: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.quantiles = A.check_quantiles(self.quantiles, open_interval=True)

    def fit(self, df: DataFrame, target: str) -> HistoricalQuantiles:
        row = exact_quantiles(df, target, self.quantiles).first()
        if row is None:
            raise ValueError("no target values to fit on")
        self.overall = list(row.q)
        if self.group_col:
            self.per_group = exact_quantiles(df, target, self.quantiles, self.group_col)
        return self

    def predict(self, df: DataFrame, out: str = "yq") -> DataFrame:
        """Add the ascending quantile array."""
        if self.overall is None:
            raise ValueError("baseline is not fitted")
        default = double_array(self.overall)
        if self.per_group is None:
            return df.withColumn(out, F.array_sort(default))
        table = self.per_group.select(self.group_col, F.col("q").alias("_group_q"))
        return (
            df.join(table, self.group_col, "left")
            .withColumn(out, F.array_sort(F.coalesce("_group_q", default)))
            .drop("_group_q")
        )


def save_baseline(baseline: HistoricalQuantiles, path: str) -> None:
    state = {
        "quantiles": list(baseline.quantiles),
        "group_col": baseline.group_col,
        "overall": baseline.overall,
    }
    _session().createDataFrame([(json.dumps(state),)], "state string").write.mode(
        "overwrite"
    ).parquet(f"{path}/state")
    if baseline.per_group is not None:
        baseline.per_group.write.mode("overwrite").parquet(f"{path}/groups")


def load_baseline(path: str) -> HistoricalQuantiles:
    spark = _session()
    state = json.loads(spark.read.parquet(f"{path}/state").first().state)
    groups = spark.read.parquet(f"{path}/groups") if state["group_col"] else None
    return HistoricalQuantiles(**state, per_group=groups)


def median_of(yq: str, n: int) -> Column:
    return F.get(F.col(yq), F.lit(n // 2))


def r2_score(df: DataFrame, y: str, prediction: Column, weight: Column | None = None) -> DataFrame:
    """One row `r2`: 1 - residual over total sum of squares, in one pass."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(F.col(y).alias("_y"), prediction.alias("_p"), w.alias("_w"))
    rows = rows.where("_y is not null and _p is not null")
    err = F.col("_y") - F.col("_p")
    sums = rows.agg(
        F.sum(F.col("_w") * err * err).alias("res"),
        F.sum("_w").alias("sw"),
        F.sum(F.col("_w") * F.col("_y")).alias("sy"),
        F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("syy"),
    )
    total = F.col("syy") - sdiv(F.col("sy") * F.col("sy"), F.col("sw"))
    return sums.select((1.0 - sdiv(F.col("res"), total)).alias("r2"))


@dataclass
class QuantileForest:
    """Conditional quantiles from a random forest.

    The forest groups similar rows into leaves; the quantiles of the targets
    in each (tree, leaf) come from mergeable sketches, so only sketches are
    shuffled. A row's forecast is the mean of its leaves' quantiles over the
    trees, sorted. The leaf table has at most trees * 2^depth rows and is a
    constant of the scoring projection: predicting neither joins nor shuffles.
    """

    params: ModelParams = ModelParams()
    feature_cols: list[str] = field(default_factory=list)
    model: RandomForestRegressionModel | None = field(default=None, repr=False)
    leaves: list[list[list[float]]] = field(default_factory=list, repr=False)
    overall: list[float] = field(default_factory=list)
    trees: int = 0

    def _vectors(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(
            inputCols=self.feature_cols, outputCol="_features", handleInvalid="error"
        ).transform(df)

    def fit(self, df: DataFrame, feature_cols: list[str], target: str, trees: int | None = None):
        p = self.params
        self.feature_cols = list(feature_cols)
        self.trees = trees or p.num_trees
        rows = self._vectors(df.where(F.col(target).isNotNull())).select("_features", target)
        forest = RandomForestRegressor(
            featuresCol="_features",
            labelCol=target,
            predictionCol="_mean",
            leafCol="_leaf",
            numTrees=self.trees,
            maxDepth=p.max_depth,
            maxBins=p.max_bins,
            minInstancesPerNode=p.min_instances,
            seed=p.seed,
        )
        self.model = forest.fit(rows)
        taus = [float(t) for t in p.quantiles]
        sketch = F.percentile_approx(target, taus, p.sketch_accuracy).alias("q")
        self.overall = list(rows.agg(sketch).first().q)
        found = (
            self.model.transform(rows)
            .select(target, F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))
            .groupBy("tree", F.col("leaf").cast("int").alias("leaf"))
            .agg(sketch)
            .collect()  # at most trees * 2^depth rows
        )
        sizes = [0] * self.trees
        for r in found:
            sizes[r.tree] = max(sizes[r.tree], r.leaf + 1)
        self.leaves = [[list(self.overall) for _ in range(n)] for n in sizes]
        for r in found:
            self.leaves[r.tree][r.leaf] = list(r.q)
        return self

    def _average(self, trees: int) -> Column:
        """Mean leaf quantiles over the first `trees` trees."""
        table = F.from_json(F.lit(json.dumps(self.leaves)), "array<array<array<double>>>")
        leaf = vector_to_array("_leaf")
        picked = F.transform(
            F.sequence(F.lit(0), F.lit(trees - 1)),
            lambda t: F.get(F.get(table, t), F.get(leaf, t).cast("int")),
        )
        zero = double_array([0.0] * len(self.overall))
        total = F.aggregate(picked, zero, lambda acc, q: F.zip_with(acc, q, lambda a, b: a + b))
        return F.array_sort(F.transform(total, lambda x: x / float(trees)))

    def predict(self, df: DataFrame, out: str = "yq") -> DataFrame:
        """Add the ascending quantile array."""
        if self.model is None:
            raise ValueError("model is not fitted")
        scored = self.model.transform(self._vectors(df))
        return scored.withColumn(out, self._average(self.trees)).drop("_features", "_leaf", "_mean")

    def best_tree_count(self, df: DataFrame, target: str) -> int:
        """Number of trees (a multiple of the step) with the lowest pinball loss on `df`."""
        if self.model is None:
            raise ValueError("model is not fitted")
        step = self.params.tree_step
        sizes = list(range(step, self.trees + 1, step)) or [self.trees]
        scored = self.model.transform(self._vectors(df.where(F.col(target).isNotNull())))
        scored = scored.select(target, *[self._average(n).alias(f"_yq{n}") for n in sizes])
        taus = self.params.quantiles

        def loss(n: int) -> Column:
            parts = [
                pinball(F.col(target), F.get(F.col(f"_yq{n}"), F.lit(i)), t)
                for i, t in enumerate(taus)
            ]
            return F.avg(sum(parts[1:], parts[0]) / len(parts)).alias(str(n))

        row = scored.agg(*[loss(n) for n in sizes]).first()
        known = [n for n in sizes if row[str(n)] is not None]
        return min(known, key=lambda n: row[str(n)]) if known else self.trees

    def importance(self, spark) -> DataFrame:
        """(feature, importance), one row per input column."""
        scores = self.model.featureImportances.toArray()
        rows = [(c, float(s)) for c, s in zip(self.feature_cols, scores)]
        return spark.createDataFrame(rows, "feature string, importance double")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/forest")
        state = {
            "feature_cols": self.feature_cols,
            "leaves": self.leaves,
            "overall": self.overall,
            "trees": self.trees,
            "quantiles": list(self.params.quantiles),
        }
        _session().createDataFrame([(json.dumps(state),)], "state string").write.mode(
            "overwrite"
        ).parquet(f"{path}/state")

    @classmethod
    def load(cls, path: str) -> QuantileForest:
        state = json.loads(_session().read.parquet(f"{path}/state").first().state)
        params = ModelParams(quantiles=tuple(state.pop("quantiles")))
        return cls(params=params, model=RandomForestRegressionModel.load(f"{path}/forest"), **state)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


@dataclass
class Preprocessor:
    """Grouped components plus pass-through columns and the encoded symbol."""

    pca: GroupedPca
    symbol_means: DataFrame = field(repr=False)
    default: float
    embargo_days: int = 5

    @classmethod
    def fit(cls, train: DataFrame, target: str, embargo_days: int = 5) -> Preprocessor:
        overall = train.agg(F.avg(target)).first()[0] or 0.0
        means = target_means(train, "symbol", target)
        return cls(GroupedPca.fit(train), means, overall, embargo_days)

    @property
    def output_columns(self) -> list[str]:
        return [*self.pca.output_columns, *PASSTHROUGH_FEATURES, "symbol_code"]

    def transform(self, df: DataFrame) -> DataFrame:
        df = self.pca.transform(df)
        df = encode_category(df, self.symbol_means, "symbol", "symbol_code", self.default)
        return self._with_plain(df)

    def transform_fitted(self, df: DataFrame, target: str) -> DataFrame:
        """The rows this was fitted on, their symbol encoded from earlier days' targets only."""
        coded = ordered_means(df, "symbol", target, self.embargo_days)
        return self._with_plain(self.pca.transform(coded).withColumnRenamed("encoded", "symbol_code"))

    def _with_plain(self, df: DataFrame) -> DataFrame:
        plain = {c: F.coalesce(clean_double(c), F.lit(0.0)) for c in PASSTHROUGH_FEATURES}
        return df.withColumns(plain)

    def save(self, path: str) -> None:
        self.symbol_means.write.mode("overwrite").parquet(f"{path}/symbols")
        state = {"pca": self.pca.to_json(), "default": self.default, "embargo_days": self.embargo_days}
        _session().createDataFrame([(json.dumps(state),)], "state string").write.mode(
            "overwrite"
        ).parquet(f"{path}/state")

    @classmethod
    def load(cls, path: str) -> Preprocessor:
        spark = _session()
        state = json.loads(spark.read.parquet(f"{path}/state").first().state)
        means = spark.read.parquet(f"{path}/symbols")
        pca = GroupedPca.from_json(state["pca"])
        return cls(pca, means, state["default"], state.get("embargo_days", 5))
