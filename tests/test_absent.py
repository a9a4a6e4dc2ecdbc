"""Features that a log window never names, and the token class of word features."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailwatch.operators import tfidf
from mailwatch.plans.baseline import generate_baseline
from mailwatch.plans.detection import run_detection

AT = dt.datetime(2024, 1, 2, 12)


@pytest.fixture(scope="module")
def found(spark):
    """A baseline of a and b; of 60 log rows all name a, one without a value, and none names b."""
    base = spark.range(400).select(
        (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
        F.when(F.col("id") % 3 == 0, "spam").otherwise("ham").alias("prediction"), ((F.col("id") % 10) / 10).alias("spam_probability"),
    )
    stored = generate_baseline(base, ["a", "b"], "m", "1", F.lit(AT), label="prediction", probability="spam_probability")
    value = F.when(F.col("id") == 5, F.lit("null")).otherwise((F.col("id") % 20).cast("string"))
    log = spark.range(60).select(
        F.lit(AT).alias("timestamp"), F.lit("ham").alias("prediction"), ((F.col("id") % 10) / 10).alias("spam_probability"),
        F.concat(F.lit('{"a": '), value, F.lit("}")).alias("features_json"),
    )
    result = run_detection(stored, log, ["a", "b"], F.lit(AT), F.lit(AT), "r", "m", "1")
    yield result
    result.close()


def test_absent_feature_is_counted_and_left_out(found):
    report = found.report.first()
    assert report["null_features_count"] == 1
    assert report["missing_values_pct"] == pytest.approx(100 / 60)
    assert not report["issues_detected"] and report["num_samples"] == 60
    assert [r["feature"] for r in found.feature_drift.collect()] == ["a"]
    assert found.alerts.where("metric_name = 'missing_values_pct'").count() == 0


def test_tokens_are_letters_and_numbers_of_every_kind(spark):
    text = "10² café a² ab_c x é́é ١٢"
    got = spark.createDataFrame([(text,)], "t string").select(tfidf.tokens("t").alias("w")).first()["w"]
    assert got == ["10²", "café", "a²", "ab_c", "١٢"]
    apart = spark.createDataFrame([("cafés",)], "t string").select(tfidf.tokens("t").alias("w")).first()["w"]
    assert apart == ["cafe"]
