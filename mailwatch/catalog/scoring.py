"""Training and scoring jobs with Spark ML over the mails."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TfidfConfig
from ..functions.features import PROFILES, SCALARS, SENDER
from ..functions.labels import encode_label
from ..operators import ranking, scaling, split, tfidf
from ..operators.aggregates import scoring_summary, sender_features
from ..plans import scoring, training
from .features import SQL_PROFILES
from .joins import SENDERS_SQL
from .textual import _sql as tfidf_sql
from .views import EMAILS_SQL, JOB_TIME, emails, moment, table, with_views

NAMES = SCALARS + SENDER


def _labelled(spark, sf, html: bool = True):
    return emails(spark, sf, html=html).where(F.col("label").isNotNull())


def _kept(small: DataFrame) -> DataFrame:
    """A result of a few rows, computed now, so that what it was made from can be released."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def _measured(model, test: DataFrame) -> DataFrame:
    """The measures of a model. Each of the jobs that find them reads the scores, so these are made once."""
    scored = training.scored_rows(model, test).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        scored.count()  # first, as jobs that run side by side would wait for each other's rows
        return _kept(training.metrics(scored))
    finally:
        scored.unpersist()


@contextmanager
def _sets(spark, sf, scheme: str = "balanced"):
    """Weighted training rows and test rows of the labelled mails, scaled on the training split.

    Scaling, weighting, splitting and fitting each read the features again, so they are cached and
    released at the end.
    """
    mails = _labelled(spark, sf)
    rows = scoring.full_features(mails, sender_features(_labelled(spark, sf, html=False)), None, "batch", keep=("email_id", "label"))
    rows = rows.withColumn("label", encode_label("label")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        marked = split.stratified_split(scoring.vectors(rows)).select("email_id", "label", "is_test", "features")
        scaled = scaling.fit_vector_scaler(marked.where(~F.col("is_test"))).transform(marked)
        yield training.with_weights(scaled.where(~F.col("is_test")), scheme), scaled.where("is_test")
    finally:
        rows.unpersist()


def _metrics_of(classifier):
    def run(spark, sf):
        with _sets(spark, sf) as (train, test):
            return _measured(training.fit(classifier(train.count()), train), test)

    return run


def _assembled(spark, sf):
    """The full vector with the TF-IDF block; one row per mail with its length and mass."""
    mails = emails(spark, sf)
    model = tfidf.fit(table(spark, sf, "documents"), "text", TfidfConfig())
    rows = scoring.full_features(mails, sender_features(emails(spark, sf, html=False)), model, "batch")
    mass = F.aggregate("features.values", F.lit(0.0), lambda a, x: a + x)
    cells = scoring.sparse_cells(rows, TfidfConfig().max_features)
    return cells.select("email_id", F.col("features.size").alias("length"), F.round(mass, 4).alias("mass"))


def _assembled_sql() -> str:
    cells = [f"coalesce(CAST({SQL_PROFILES['batch'][c]} AS DOUBLE), 0)" for c in SCALARS]
    cells += [f"coalesce(CAST(s.{c} AS DOUBLE), {v!r}e0)" for c, v in PROFILES["batch"].sender.items()]
    weights = tfidf_sql("SELECT CAST(doc_id AS VARCHAR) AS email_id, sum(weight) AS mass FROM weights GROUP BY 1")
    return with_views(
        EMAILS_SQL, SENDERS_SQL,
        body=f"""SELECT email_id, {len(NAMES) + TfidfConfig().max_features} AS length, round({" + ".join(cells)} + coalesce(t.mass, 0), 4) AS mass
                 FROM emails LEFT JOIN senders s USING (sender_domain) LEFT JOIN ({weights}) t USING (email_id)""",
    )


def _boosted(spark, sf):
    with _sets(spark, sf, "positive") as (train, test):
        model = training.boosted_trees(train, training.sample_trials()[:1], test, patience=10)[0]
        return _measured(model, test)


def _searched(spark, sf) -> DataFrame:
    """The trials of the documented search space with their measures."""
    with _sets(spark, sf, "positive") as (train, test):
        return training.random_search(train, test, training.sample_trials())[0]


def _refit(spark, sf):
    with _sets(spark, sf, "positive") as (train, test):
        trials = training.sample_trials()
        model = training.refit_best(train, trials, training.random_search(train, test, trials)[0])
        return _measured(model, test)


def _importances(spark, sf):
    with _sets(spark, sf) as (train, _):
        return training.feature_importances(spark, training.fit(training.random_forest(), train), NAMES)


def _score(spark, sf):
    """All mails scored on the full vector by the documented forest, fitted on the labelled ones; vectors are made once."""
    mails = emails(spark, sf)
    words = tfidf.fit(table(spark, sf, "documents"), "text")
    rows = scoring.full_features(mails, sender_features(emails(spark, sf, html=False)), words, "batch", keep=("email_id", "label"))
    stored = scoring.stored_vectors(rows, len(words.terms))
    train = stored.where(F.col("label").isNotNull()).select(encode_label("label").alias("label"), "features")
    scaler = scaling.fit_vector_scaler(train)
    model = training.fit(training.random_forest(), training.with_weights(scaler.scale_only(train)))
    return scoring.scored_vectors(stored, model, scaler, moment(JOB_TIME), "1")


QUERIES = {
    "c26_feature_vectors": (_assembled, _assembled_sql()),
    "h06_logistic_regression": (_metrics_of(training.logistic_regression), None),
    "h07_random_forest": (_metrics_of(lambda rows: training.random_forest()), None),
    "h08_boosted_trees": (_boosted, None),
    "h09_random_search": (lambda spark, sf: ranking.leaderboard(_searched(spark, sf)), None),
    "h10_refit_best": (_refit, None),
    "h16_feature_importances": (_importances, None),
    "i01_spam_probability": (lambda spark, sf: _score(spark, sf).select("email_id", "spam_probability"), None),
    "i03_stamped_predictions": (
        lambda spark, sf: _score(spark, sf).select("email_id", "prediction_label", "prediction_timestamp", "model_version"),
        None,
    ),
    "i06_scoring_job": (lambda spark, sf: scoring_summary(_score(spark, sf)), None),
    "s01_top_features": (lambda spark, sf: ranking.top_features(_importances(spark, sf), 20), None),
    "s03_best_trial": (lambda spark, sf: ranking.best_trial(_searched(spark, sf)), None),
    "s05_leaderboard": (lambda spark, sf: ranking.leaderboard(_searched(spark, sf)).select("trial", "max_depth", "f1"), None),
}
