import random
from datetime import datetime

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import Observation
from pyspark.sql import functions as F

from mailwatch.config import DriftConfig
from mailwatch.operators import aggregates, evaluation, gates, ranking, scaling, split, tfidf
from mailwatch.plans import alerting, detection, scoring, training


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, prediction int, score double")


def test_auc_ties_single_class_and_cross_check(spark):
    flat = scored(spark, [(1, 1, 0.5), (0, 1, 0.5), (0, 1, 0.5)])
    assert evaluation.auc(flat).first()["auc_roc"] == 0.5
    assert evaluation.auc(scored(spark, [(1, 1, 0.2), (1, 1, 0.9)])).first()["auc_roc"] is None
    rng = random.Random(5)
    rows = [(rng.randrange(2), 1, round(rng.random(), 2)) for _ in range(500)]
    df = scored(spark, rows)
    pos, neg = ([s for y, _, s in rows if y == k] for k in (1, 0))
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    for ranges in (1, 7):
        assert evaluation.auc(df, ranges=ranges).first()["auc_roc"] == pytest.approx(wins)
    ml = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(df)
    assert ml == pytest.approx(wins, abs=1e-9)


def test_metrics_and_curves(spark):
    df = scored(spark, [(1, 1, 0.9), (1, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1)])
    m = evaluation.metrics(df).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"], m["auc_roc"]) == (0.5, 0.5, 0.5, 0.5, 0.75)
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in evaluation.roc_curve(df).collect()}
    assert roc[0.9] == (0.0, 0.5) and roc[0.1] == (1.0, 1.0)
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in evaluation.precision_recall_curve(df).collect()}
    assert pr[0.6] == (0.5, 0.5)
    none = evaluation.metrics(scored(spark, [(1, 0, 0.1), (0, 0, 0.2)])).first()
    assert (none["precision"], none["f1"]) == (0.0, 0.0)


def test_split_is_exact_and_reproducible(spark):
    df = spark.createDataFrame([(str(i), "spam" if i % 3 == 0 else "ham") for i in range(1000)], "email_id string, label string")
    a = split.stratified_split(df).where("is_test")
    counts = {r["label"]: r["count"] for r in a.groupBy("label").count().collect()}
    assert counts == {"spam": 67, "ham": 133}
    again = split.stratified_split(df.repartition(7)).where("is_test")
    assert {r[0] for r in a.collect()} == {r[0] for r in again.collect()}
    other = split.stratified_split(df, seed=1).where("is_test")
    assert {r[0] for r in a.collect()} != {r[0] for r in other.collect()}
    train, test = split.train_test(df)
    assert train.count() + test.count() == 1000 and train.join(test, "email_id").count() == 0


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, float("nan"))], "a double, b double")
    s = scaling.fit_scaler(df.na.fill(5.0), ["a", "b"])
    assert s.mean == (2.5, 5.0) and s.std == (pytest.approx(1.25**0.5), 1.0)
    v = scaling.assemble(df, ["a"], None, ["b"])
    w = scaling.fit_vector_scaler(v)
    assert w.std[0] == pytest.approx(1.25**0.5) and w.mean[1] == pytest.approx(3.75)
    z = w.transform(v).first()["features"]
    assert z[0] == pytest.approx(-1.5 / 1.25**0.5)
    assert scaling.Scaler.from_frame(s.to_frame(spark)) == s
    with pytest.raises(ValueError):
        scaling.check_length(w, 3)
    odd = spark.createDataFrame([(float("inf"), None)], "a double, b double")
    assert scaling.assemble(odd, ["a"], None, ["b"]).first()["features"].toArray().tolist() == [0.0, 0.0]


@pytest.fixture(scope="module")
def sets(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        y = i % 3 == 0
        rows.append((int(y), Vectors.dense([rng.gauss(2 if y else 0, 0.7), rng.gauss(0, 1), rng.random()])))
    df = spark.createDataFrame([(f"m{i}", *r) for i, r in enumerate(rows)], ["email_id", "label", "features"])
    df = training.with_weights(df.repartition(2)).cache()
    return df, df


def test_weights_are_balanced(sets):
    w = {r["label"]: r["w"] for r in sets[0].groupBy("label").agg(F.first("weight").alias("w")).collect()}
    assert w == {0: pytest.approx(240 / 320), 1: pytest.approx(240 / 160)}


def test_models_learn_and_rank(spark, sets):
    train, test = sets
    for classifier in (training.logistic_regression(240), training.random_forest(trees=5, depth=4)):
        model = training.fit(classifier, train)
        assert training.evaluate(model, test)["f1"] > 0.85
    top = ranking.top_features(training.feature_importances(spark, model, ["signal", "noise", "flat"]), 1).first()
    assert top["feature"] == "signal"
    p = scoring.probability(model, test)
    assert p.where("spam_probability < 0 or spam_probability > 1").count() == 0


def test_models_score_in_a_session_that_has_observed(spark, sets):
    """A stream or an observed query leaves the session with a part that cannot be sent to tasks."""
    train, test = sets
    seen = Observation()
    train.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 240
    for classifier in (training.logistic_regression(240), training.random_forest(trees=3, depth=3)):
        model = training.fit(classifier, train)
        assert not model.hasSummary and training.scored_rows(model, test).count() == 240
        assert training.evaluate(model, test)["f1"] > 0.8


def test_saved_model_scores_alike(spark, sets, tmp_path):
    from pyspark.ml.classification import RandomForestClassificationModel

    train, _ = sets
    model = training.fit(training.random_forest(trees=3, depth=3), train)
    model.write().save(str(tmp_path / "model"))
    again = RandomForestClassificationModel.load(str(tmp_path / "model"))
    rows = train.withColumn("id", F.monotonically_increasing_id()).cache()
    a, b = (training.scored_rows(m, rows, ("id",)) for m in (model, again))
    parity = evaluation.score_parity(a, b, "id").first()
    assert parity["passed"] and parity["max_diff"] == 0.0 and parity["label_match_rate"] == 1.0


def test_positive_weights(sets):
    w = training.with_weights(sets[0].drop("weight"), "positive").groupBy("label").agg(F.first("weight").alias("w"))
    assert {r["label"]: r["w"] for r in w.collect()} == {0: 1.0, 1: pytest.approx(2.0)}


def test_scoring_job_end_to_end(spark):
    """Training text, vocabulary, full vector, forest and decision as one plan; every mail scored once."""
    cols = "email_id string, label string, body_text string, body_html string, subject string, sender_email string, sender_domain string, x_mailer string, received_hop_count int, date timestamp"
    rows = []
    for i in range(60):
        spam = i % 2 == 0
        body = "win free money now, click here! unsubscribe" if spam else "meeting notes about the release plan attached"
        rows.append((f"e{i}", "spam" if spam else "ham", f"{body} {i}", None, "FREE" if spam else "Re: plan", "a@b.c", "b.c", None, 1, datetime(2024, 1, 3, i % 24)))
    mails = spark.createDataFrame(rows, cols)
    senders, words = aggregates.sender_features(mails), tfidf.fit(mails)
    full = scoring.full_features(mails, senders, words, keep=("email_id", "label"))
    train = scoring.stored_vectors(full, len(words.terms)).withColumn("label", (F.col("label") == "spam").cast("int")).cache()
    first = train.first()["features"]
    assert type(first).__name__ == "SparseVector" and first.size == 24 + len(words.terms) + 4 and all(first.values != 0)
    scaler = scaling.fit_vector_scaler(train)
    scaling.check_length(scaler, 24 + len(words.terms) + 4)
    model = training.fit(training.random_forest(trees=5, depth=3), training.with_weights(scaler.scale_only(train)))
    out = scoring.score_table(mails, model, senders, words, scaler, F.lit("2024-02-01").cast("timestamp"), "7", threshold=0.5)
    got = {r["email_id"]: r for r in out.collect()}
    assert len(got) == 60 and got["e0"]["model_version"] == "7" and got["e0"]["prediction_timestamp"].startswith("2024-02-01T")
    assert all(got[r[0]]["prediction_label"] == r[1] for r in rows)


def test_random_search_skips_failures(spark, sets):
    from dataclasses import replace

    train, test = sets
    trials = [replace(t, n_estimators=2, max_depth=2) for t in training.sample_trials(2)]
    trials.append(replace(trials[0], max_depth=-1))
    table, models = training.random_search(train, test, trials)
    rows = {r["trial"]: r for r in table.collect()}
    for n in (0, 1):
        alone = evaluation.metrics(training.scored_rows(models[n], test)).first()
        assert all(rows[n][m] == pytest.approx(alone[m]) for m in ("f1", "precision", "recall", "auc_roc"))
    assert rows[2]["f1"] is None and rows[2]["error"] and models[2] is None
    best = ranking.best_trial(table.where("f1 is not null")).first()
    assert best["f1"] == max(rows[0]["f1"], rows[1]["f1"])
    assert [r["trial"] for r in ranking.leaderboard(table).collect()][-1] == 2
    assert training.evaluate(training.refit_best(train, trials, table), test)["f1"] == pytest.approx(best["f1"], abs=0.1)


def test_search_space_is_seeded():
    a, b = training.sample_trials(20), training.sample_trials(20)
    assert a == b and len({t.learning_rate for t in a}) == 20
    assert all(3 <= t.max_depth <= 11 and 0.01 <= t.learning_rate <= 0.3 and 50 <= t.n_estimators <= 299 for t in a)
    assert all(1e-8 <= x <= 10 for t in a for x in (t.alpha, t.lambda_))


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


def test_gates_at_their_thresholds(spark):
    edge = one(spark, f1=0.85, auc_roc=0.90, precision=0.80, recall=0.80)
    assert [r["passed"] for r in gates.quality_gate(edge).collect()] == [True] * 4
    assert not gates.latency_gate(one(spark, p95_latency_ms=10.01)).first()["passed"]
    assert gates.latency_gate(one(spark, p95_latency_ms=10.0)).first()["passed"]
    same = scored(spark, [(1, 1, 0.9), (0, 1, 0.9)])
    assert not gates.sanity_gate(same).first()["passed"]
    base = one(spark, f1=0.75, auc_roc=0.75)
    assert gates.compare_models(one(spark, f1=0.75, auc_roc=0.72), base).first()["passed"]
    worse = gates.compare_models(one(spark, f1=0.65, auc_roc=0.9), base).first()
    assert not worse["passed"] and worse["f1_regression"] == pytest.approx(0.1)
    first = gates.compare_models(one(spark, f1=0.6, auc_roc=0.7), None).first()
    assert first["passed"] and first["f1_improvement"] == pytest.approx(0.6)
    decision = gates.promotion_decision(gates.quality_gate(edge.withColumn("f1", F.lit(0.1))), gates.compare_models(edge, None)).first()
    assert not decision["promoted"] and decision["blocking_reasons"] == "validation failed"
    at = F.lit("2024-01-01").cast("timestamp")
    assert gates.registry_row(edge, "m", "3", 0.85, at).first()["test_f1"] == 0.85
    assert gates.registry_row(edge, "m", "3", 0.86, at).count() == 0


def report(spark, score, drifted=0, missing=0.0, outside=0.0, psi=0.0):
    return spark.createDataFrame(
        [("r", score, psi, drifted, [f"f{i}" for i in range(drifted)], missing, outside, missing > 5 or outside > 1)],
        "report_id string, drift_score double, prediction_psi double, features_drifted_count long, features_drifted_names array<string>, "
        "missing_values_pct double, out_of_range_pct double, issues_detected boolean",
    )


DRIFT = "report_id string, feature string, psi double, drift_detected boolean, baseline_mean double, current_mean double"


def test_alert_rules(spark):
    drift = spark.createDataFrame([("r", "word_count", 0.35, True, 150.0, 250.0), ("r", "ks_only", 0.1, True, 1.0, 1.0)], DRIFT)
    alerts = alerting.generate_alerts(report(spark, 0.6, 3, 6.0, 2.0, 0.3), drift).orderBy("rule_order").collect()
    assert [(a["rule_order"], a["severity"], a["metric_name"]) for a in alerts] == [
        (1, "critical", "drift_score"), (2, "critical", "prediction_psi"), (3, "warning", "features_drifted_count"),
        (4, "warning", "feature_psi"), (5, "warning", "missing_values_pct"), (6, "warning", "out_of_range_pct"),
    ]
    assert alerts[0]["message"] == "Critical drift detected: overall drift score 60.00% exceeds threshold 50%"
    assert alerts[3]["recommendation"].endswith("Mean shifted from 150.000 to 250.000")
    mild = alerting.generate_alerts(report(spark, 0.25), drift.where("false")).collect()
    assert [a["severity"] for a in mild] == ["warning"]
    assert alerting.generate_alerts(report(spark, 0.1), drift.where("false")).count() == 0
    quiet = alerting.generate_alerts(report(spark, 0.1, 3), drift.where("false"), DriftConfig(drifted_features=4))
    assert quiet.count() == 0


def test_status_without_reports_is_unknown(spark):
    models = one(spark, model_name="m")
    rows = [("r", "m", datetime(2024, 1, 1), 0.6, True)]
    reports = spark.createDataFrame(rows, "report_id string, model_name string, generated_at timestamp, drift_score double, overall_drift_detected boolean")
    assert detection.status_of(models, reports).first()["status"] == "critical"
    assert detection.status_of(models, reports.where("false")).first()["status"] == "unknown"


def test_fill_and_slice_report(spark):
    train = spark.createDataFrame([(1, None), (None, "x")], "n int, s string")
    filled, other = aggregates.fill_numeric_nulls(train, train)
    assert filled.where("n is null").count() == 0 and other.where("n is null").count() == 0 and filled.where("s is null").count() == 1
    untouched, gaps = aggregates.fill_numeric_nulls(train.na.drop(), train)
    assert gaps.where("n is null").count() == 1
    good = scored(spark, [(1, 1, 0.9)] * 4 + [(0, 0, 0.1)] * 5 + [(0, 1, 0.9)])
    r = aggregates.slice_report(good).first()
    assert r["passed"] and r["overall_accuracy"] == 0.9 and r["false_positive_rate"] == pytest.approx(1 / 6)
    assert aggregates.target_distribution(train.where("false").select("s"), "s").first()["total_samples"] == 0


def test_paging(spark):
    rows, info = ranking.page(spark.range(25).toDF("id"), ["id"], 20, 10)
    assert [r["id"] for r in rows.collect()] == [20, 21, 22, 23, 24]
    assert tuple(info.first()) == (25, 5, False)


def test_forest_keeps_the_nodes_of_rows_and_grows_the_same_trees(spark):
    rng = random.Random(8)
    rows = [(float(rng.randrange(2)), rng.choice([1.0, 2.0]), Vectors.dense([rng.random() for _ in range(6)])) for _ in range(300)]
    train = spark.createDataFrame(rows, ["label", "weight", "features"])
    forest = training.random_forest(trees=6, depth=9)
    assert forest.getCacheNodeIds()
    plain = forest.copy({forest.cacheNodeIds: False})
    assert training.fit(forest, train).toDebugString.split("\n")[1:] == training.fit(plain, train).toDebugString.split("\n")[1:]
