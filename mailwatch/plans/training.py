"""Training table, classifiers, random search and refit with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Model, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting
from ..operators.aggregates import class_weights, fill_numeric_nulls
from ..operators.evaluation import metrics, metrics_by
from ..operators.joins import join_sender_features, left_join_suffixed
from ..session import scratch_folder


def training_table(entities: DataFrame, features: DataFrame, senders: DataFrame | None) -> DataFrame:
    """Entities with message and sender features; clashing names keep the entity's value."""
    return join_sender_features(left_join_suffixed(entities, features, "email_id", "_feat"), senders)


def training_sets(
    train: DataFrame, test: DataFrame, features: DataFrame, senders: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    return fill_numeric_nulls(
        training_table(train, features, senders), training_table(test, features, senders)
    )


def with_weights(train: DataFrame, scheme: str = "balanced", label: str = "label", out: str = "weight") -> DataFrame:
    """Class weights: ``balanced`` is n/(2·n_c), ``positive`` is (1−r)/r for the positive class."""
    w = class_weights(train, label).first()
    negative, positive = {
        "balanced": (w["weight_0"], w["weight_1"]),
        "positive": (1.0, w["positive_weight"]),
    }[scheme]
    return train.withColumn(out, F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(negative)))


def logistic_regression(rows: int, weight: str = "weight", strength: float = 1.0) -> LogisticRegression:
    """Unit L2 penalty on the summed loss; Spark averages the loss, hence the 1/rows."""
    return LogisticRegression(
        maxIter=1000, regParam=1.0 / (strength * max(rows, 1)), standardization=False,
        featuresCol="features", labelCol="label", weightCol=weight,
    )


def random_forest(weight: str = "weight", trees: int = 100, depth: int = 15, seed: int = 42) -> RandomForestClassifier:
    """The rows' nodes are kept between passes: else every task of every pass is sent all trees grown so far, and walks them."""
    return RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label", weightCol=weight, cacheNodeIds=True
    )


@dataclass(frozen=True)
class TrialConfig:
    """One point of the search space."""

    max_depth: int
    learning_rate: float
    n_estimators: int
    min_child_weight: int
    subsample: float
    colsample: float
    gamma: float
    alpha: float = 0.0
    lambda_: float = 1.0

    def params(self) -> boosting.TreeParams:
        return boosting.TreeParams(**vars(self))

    def fault(self) -> str | None:
        """Why no model can be grown from these values, if so."""
        if self.max_depth < 1 or self.n_estimators < 1:
            return "depth and number of trees must be positive"
        if not (0 < self.subsample <= 1 and 0 < self.colsample <= 1):
            return "shares of rows and columns must be in (0, 1]"
        if min(self.learning_rate, self.min_child_weight, self.gamma, self.alpha, self.lambda_) < 0:
            return "rates, weights and penalties must not be negative"
        return None


def sample_trials(n: int = 20, seed: int = 42) -> list[TrialConfig]:
    """Seeded draws from the search space."""
    rng = random.Random(seed)
    log_uniform = lambda lo, hi: lo * (hi / lo) ** rng.random()
    return [
        TrialConfig(
            max_depth=rng.randrange(3, 12),
            learning_rate=log_uniform(0.01, 0.3),
            n_estimators=rng.randrange(50, 300),
            min_child_weight=rng.randrange(1, 10),
            subsample=rng.uniform(0.6, 1.0),
            colsample=rng.uniform(0.6, 1.0),
            gamma=rng.uniform(0.0, 1.0),
            alpha=log_uniform(1e-8, 10.0),
            lambda_=log_uniform(1e-8, 10.0),
        )
        for _ in range(n)
    ]


def boosted_trees(
    train: DataFrame, trials: Sequence[TrialConfig], validation: DataFrame | None = None, patience: int | None = None,
    key: str = "email_id", seed: int = 42,
) -> list[boosting.Ensemble]:
    """One ensemble for each trial, all grown together; rows are drawn by their ``key``."""
    cuts = boosting.cut_points(train)
    blocks = boosting.blocks_of(train, validation, cuts, key)
    return boosting.boost(blocks, cuts, [t.params() for t in trials], patience, seed)


def scored_rows(model: Transformer | boosting.Ensemble, df: DataFrame, keep: Sequence[str] = ("label",)) -> DataFrame:
    if isinstance(model, boosting.Ensemble):
        return boosting.scored(df, [model], keep).drop("model")
    p = vector_to_array("probability")[1]
    return model.transform(df).select(*keep, F.col("prediction").cast("int").alias("prediction"), p.alias("score"))


def fit(classifier, train: DataFrame) -> Model:
    """Fit with the training vectors cached (spilling to disk): every iteration reads them."""
    rows = train.select("label", "weight", "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _without_summary(classifier.fit(rows))
    finally:
        rows.unpersist()


def _without_summary(model: Model) -> Model:
    """The model without its training summary, which tasks cannot be sent.

    A summary holds the session, and a session that has observed any query, as streams do, cannot be serialized. The copy of a
    forest has no summary; that of a linear model has, but a saved one has not.
    """
    bare = model.copy()
    if bare.hasSummary:
        path = scratch_folder(SparkSession.active(), "model")
        bare.write().save(path)
        bare = type(model).load(path)
    return bare


def evaluate(model: Transformer | boosting.Ensemble, test: DataFrame) -> Mapping[str, float]:
    return metrics(scored_rows(model, test)).first().asDict()


def random_search(
    train: DataFrame, validation: DataFrame, trials: Sequence[TrialConfig], patience: int | None = 10, key: str = "email_id"
) -> tuple[DataFrame, list[boosting.Ensemble | None]]:
    """Grows all trials together and measures them on the validation rows.

    A trial ends early when its validation loss has not fallen for ``patience`` trees. One that cannot be grown is reported
    without measures. Returns the trial table, one row a trial, and the models.
    """
    faults = [t.fault() for t in trials]
    good = [n for n, f in enumerate(faults) if f is None]
    grown = boosted_trees(train, [trials[n] for n in good], validation, patience, key)
    scores = boosting.scored(validation, grown).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scores.count()  # first, as the jobs that measure would each make them
        found = {good[r["model"]]: r for r in metrics_by(scores, ["model"]).collect()}
    finally:
        scores.unpersist()
    models: dict[int, boosting.Ensemble] = dict(zip(good, grown))
    measures = ("f1", "precision", "recall", "auc_roc")
    rows = [
        (n, *vars(t).values(), len(models[n].trees) if n in models else None, *(found[n][m] if n in found else None for m in measures), faults[n])
        for n, t in enumerate(trials)
    ]
    schema = (
        "trial int, max_depth int, learning_rate double, n_estimators int, min_child_weight int, subsample double, "
        "colsample double, gamma double, reg_alpha double, reg_lambda double, trees int, "
        + ", ".join(f"{m} double" for m in measures) + ", error string"
    )
    return train.sparkSession.createDataFrame(rows, schema), [models.get(n) for n in range(len(trials))]


def refit_best(train: DataFrame, trials: Sequence[TrialConfig], table: DataFrame, key: str = "email_id") -> boosting.Ensemble:
    """Refit on the same training split with the best trial's parameters, all of its trees."""
    best = table.where(F.col("f1").isNotNull()).orderBy(F.col("f1").desc(), "trial").first()
    return boosted_trees(train, [trials[best["trial"]]], key=key)[0]


def feature_importances(spark: SparkSession, model: Model | boosting.Ensemble, names: Sequence[str]) -> DataFrame:
    """(feature, importance): one row per feature of the vector."""
    if isinstance(model, boosting.Ensemble):
        values = model.importances()
    else:
        values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    rows = [(n, abs(float(values[i]))) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, importance double")
