"""The queries that fit models, run with small forests; their rows are held to what any fit must satisfy."""

from dataclasses import replace

import pytest

import __spark_entry__ as entry
from mailwatch.catalog import scoring
from mailwatch.plans import training
from tests.oracle import connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def small_models(monkeypatch):
    trials, forest = training.sample_trials, training.random_forest
    few = [replace(t, n_estimators=3, max_depth=2 + i) for i, t in enumerate(trials(3))]
    monkeypatch.setattr(training, "sample_trials", lambda *_, **__: few)
    monkeypatch.setattr(training, "random_forest", lambda *_, **__: forest(trees=5, depth=3))


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: entry.queries()[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", ["h06_logistic_regression", "h07_random_forest", "h08_boosted_trees", "h10_refit_best"])
def test_metrics(run, name):
    row = run(name).iloc[0]
    assert all(0 <= row[c] <= 1 for c in ("accuracy", "precision", "recall", "f1"))
    harmonic = 2 * row["precision"] * row["recall"] / (row["precision"] + row["recall"]) if row["precision"] + row["recall"] else 0
    assert row["f1"] == pytest.approx(harmonic)


def test_search_is_ordered_and_repeatable(run):
    board = run("h09_random_search")
    assert len(board) == 3 and board["f1"].dropna().is_monotonic_decreasing and board["error"].isna().all()
    assert run("s03_best_trial").iloc[0]["trial"] == board.iloc[0]["trial"]
    again = run("s05_leaderboard")
    assert list(again["trial"]) == list(board["trial"]) and list(again["f1"]) == list(board["f1"])


def test_importances(run):
    found = run("h16_feature_importances")
    assert len(found) == len(scoring.NAMES) and found["importance"].sum() == pytest.approx(1)
    top = run("s01_top_features")
    assert top["importance"].is_monotonic_decreasing and len(top) == min(20, len(found))


def test_scores(spark, run):
    mails = connect(SF).execute("SELECT count(*) FROM documents").fetchall()[0][0]
    scores = run("i01_spam_probability")
    assert len(scores) == mails == scores["email_id"].nunique() and scores["spam_probability"].between(0, 1).all()
    stamped = run("i03_stamped_predictions").set_index("email_id")["prediction_label"]
    spam = scores.set_index("email_id")["spam_probability"] >= 0.7
    assert (stamped.loc[spam.index] == spam.map({True: "spam", False: "ham"})).all()
    assert len(run("i06_scoring_job")) == 1


def test_nothing_stays_cached(spark, run):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    for name in ("h06_logistic_regression", "g24_detection_report", "i06_scoring_job"):
        run(name)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_vectors_have_their_length(run):
    rows = run("c26_feature_vectors")
    assert (rows["length"] == 528).all() and rows["mass"].notna().all()


def test_scores_are_made_once(spark, run, monkeypatch):
    """All measures of a model are found from scores that are kept, not from the model again."""
    levels, metrics = [], training.metrics

    def seen(scored):
        levels.append(scored.storageLevel.useMemory)
        return metrics(scored)

    monkeypatch.setattr(training, "metrics", seen)
    assert len(run("h07_random_forest")) == 1 and levels == [True]
